"""Readers and writers of text formats, on Spark's own sources: JSON lines with comments, CSV with typed cells, sectioned settings, XML.

All are stateless per record or per file, so files are read in parallel and filters and columns reach the scan where the
format allows it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DELIMITERS = (",", "\t", ";", "|")


def json_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """A VARIANT a record; blank lines and lines that begin with # or // are no records; a bad line gives NULL."""
    s = F.trim(F.col(column))
    return lines.where((s != "") & ~s.startswith("#") & ~s.startswith("//")).withColumn("document", F.try_parse_json(s))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark.read.text(path))


def typed(cell: Column) -> Column:
    """struct(kind, text): how an unquoted cell reads: empty, null and ~ are null, then boolean, integer, float, string."""
    s = F.trim(cell)
    k = (
        F.when(cell.isNull() | s.isin("", "null", "~"), "null")
        .when(F.lower(s).isin("true", "false"), "boolean")
        .when(s.rlike(r"^[+-]?\d+$"), "integer")
        .when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & s.rlike(r"[.eE]"), "float")
        .otherwise("string")
    )
    text = F.when(k == "null", None).when(k == "boolean", F.lower(s)).when(k == "string", cell).otherwise(s)
    return F.struct(k.alias("kind"), text.alias("text"))


def typed_cells(line: Column, delimiter: str = ",") -> Column:
    """array<struct(kind, text)> of one line's cells; a quoted cell is always a string, "" inside quotes is a quote."""
    d = re.escape(delimiter)
    raw = F.regexp_extract_all(F.concat(line, F.lit(delimiter)), F.lit(rf'("(?:[^"]|"")*"|[^{d}]*){d}'), F.lit(1))
    inside = lambda c: F.replace(F.substr(c, F.lit(2), F.char_length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda c: F.when(c.rlike('(?s)^".*"$'), F.struct(F.lit("string").alias("kind"), inside(c).alias("text"))).otherwise(typed(c)))


def column_kinds(df: DataFrame) -> DataFrame:
    """(column, kind): the narrowest kind that holds all cells, by one aggregation over all rows."""
    order = {"boolean": 1, "integer": 2, "float": 3, "string": 4}
    ranks = [F.max(F.coalesce(*[F.when(typed(F.col(c))["kind"] == k, r) for k, r in order.items()], F.lit(0))).alias(c) for c in df.columns]
    mixed = [F.count_if(typed(F.col(c))["kind"] == "boolean").alias(f"{c}_boolean") for c in df.columns]
    one = df.agg(*ranks, *mixed)
    names = F.array(*[F.lit(k) for k in ("null", "boolean", "integer", "float", "string")])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.when((F.col(c).isin(2, 3)) & (F.col(f"{c}_boolean") > 0), "string").otherwise(F.element_at(names, F.col(c) + 1)).alias("kind")) for c in df.columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """All cells as text; typing is explicit, by typed() or casts, so no second pass infers a schema."""
    return spark.read.option("sep", delimiter).option("header", header).option("escape", '"').option("multiLine", True).csv(path)


def sniffed(lines: DataFrame, column: str = "value", sample: int = 10) -> DataFrame:
    """(delimiter, score) best first: occurrences in the first lines, 1000 more if every line has as many."""
    s = F.col(column)
    first = lines.where((F.trim(s) != "") & ~s.startswith("#")).limit(sample)
    counts = [F.struct(F.lit(d).alias("delimiter"), F.sum(F.char_length(s) - F.char_length(F.replace(s, F.lit(d), F.lit("")))).alias("n"), F.count_distinct(F.char_length(s) - F.char_length(F.replace(s, F.lit(d), F.lit("")))).alias("distinct")) for d in DELIMITERS]
    out = first.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return out.select("delimiter", (F.col("n") + F.when((F.col("distinct") == 1) & (F.col("n") > 0), 1000).otherwise(0)).alias("score")).orderBy(F.desc("score"), "delimiter")


def settings(lines: DataFrame, file: str, number: str, column: str = "value") -> DataFrame:
    """(file, section, key, value) of sectioned key-value text: [section], key = value or key : value, # and ; comments.

    A key without a value is true; quoted values keep their text; the last of equal keys wins. A section reaches to the next one in its file,
    by a window over the file's lines.
    """
    s = F.trim(F.col(column))
    section = F.when(s.rlike(r"^\[.*\]$"), F.trim(F.substr(s, F.lit(2), F.char_length(s) - 2)))
    so_far = Window.partitionBy(file).orderBy(number)
    rows = lines.withColumn("section", F.coalesce(F.last(section, ignorenulls=True).over(so_far), F.lit("")))
    rows = rows.where((s != "") & ~s.rlike(r"^[#;]") & section.isNull())
    key, raw = F.trim(F.regexp_extract(s, r"^([^=:]*)", 1)), F.trim(F.regexp_extract(s, r"^[^=:]*[=:](.*)$", 1))
    quoted = raw.rlike("^(\".*\"|'.*')$")
    value = F.when(~s.rlike("[=:]"), "true").when(quoted, F.substr(raw, F.lit(2), F.char_length(raw) - 2)).otherwise(F.trim(F.regexp_replace(raw, r"\s[#;].*$", "")))
    last = F.row_number().over(Window.partitionBy(file, "section", "key").orderBy(F.desc(number)))
    return rows.withColumns({"key": key, "value": value}).withColumn("_last", last).where("_last = 1").select(file, "section", "key", "value")


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """A row an element; attributes as @name and text beside attributes as #text."""
    return spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "@").option("valueTag", "#text").load(path)


def write(df: DataFrame, path: str, kind: str, **options: str) -> None:
    """json, csv, tsv, xml, parquet, orc or text, through Spark's own writers."""
    sep = {"tsv": "\t"}.get(kind)
    writer = df.write.options(**options)
    writer = writer.option("sep", sep) if sep else writer
    writer = writer.option("header", True) if kind in ("csv", "tsv") else writer
    writer = writer.option("rowTag", options.get("rowTag", "row")) if kind == "xml" else writer
    writer.format({"tsv": "csv"}.get(kind, kind)).save(path)


def read(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options: str) -> DataFrame:
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema else reader
    reader = reader.option("header", True) if kind in ("csv", "tsv") else reader
    reader = reader.option("sep", "\t") if kind == "tsv" else reader
    reader = reader.option("rowTag", options.get("rowTag", "row")) if kind == "xml" else reader
    return reader.format({"tsv": "csv"}.get(kind, kind)).load(path)


#: Formats by file extension and by MIME type.
EXTENSIONS = {"json": "json", "jsonl": "json", "ndjson": "json", "csv": "csv", "tsv": "tsv", "tab": "tsv", "xml": "xml", "parquet": "parquet", "orc": "orc", "txt": "text", "log": "text"}
MIME = {"application/json": "json", "application/x-ndjson": "json", "text/csv": "csv", "text/tab-separated-values": "tsv", "application/xml": "xml", "text/xml": "xml", "application/vnd.apache.parquet": "parquet", "text/plain": "text"}


def kind_of(name: str) -> str:
    """The format of a file name (also compressed), an extension or a MIME type."""
    if name.split(";")[0].strip().lower() in MIME:
        return MIME[name.split(";")[0].strip().lower()]
    parts = name.lower().rstrip("/").rsplit("/", 1)[-1].split(".")
    parts = parts[:-1] if parts[-1] in ("gz", "bz2", "zst", "lz4", "snappy") else parts
    if parts[-1] not in EXTENSIONS:
        raise ValueError(f"no format for {name!r}; there are {', '.join(sorted(set(EXTENSIONS.values())))}")
    return EXTENSIONS[parts[-1]]


def read_any(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """A file by its extension."""
    return read(spark, path, kind_of(path), schema, **options)


def read_bytes(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """(path, length, content) of the files of a folder, at any depth, with this extension; only their listing if content is not selected."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", True).load(folder)
    return found.select("path", "length", "content")

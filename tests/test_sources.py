"""Files in several formats, written and read back."""

import pytest
from pyspark.sql import functions as F

from loomtree.functions import text
from loomtree.plans import convert
from loomtree.sources import text_tables

def test_kinds_by_name(spark, tmp_path):
    assert [text_tables.kind_of(x) for x in ("a/b.CSV", "x.ndjson.gz", "tsv", "text/xml; charset=utf-8", "d/t.parquet/")] == ["csv", "json", "tsv", "xml", "parquet"]
    with pytest.raises(ValueError):
        text_tables.kind_of("a.xyz")
    (tmp_path / "a.csv").write_text("k,v\n1,x\n")
    (tmp_path / "b.bin").write_bytes("\ufeffé\r\n".encode("utf-16-le"))
    assert text_tables.read_any(spark, f"{tmp_path}/a.csv").collect()[0].asDict() == {"k": "1", "v": "x"}
    found = text_tables.read_bytes(spark, str(tmp_path), "bin")
    assert [r["t"] for r in found.select(text.decoded(F.col("content")).alias("t")).collect()] == ["é\n"]


def test_quoted_cells_are_text(spark):
    lines = spark.createDataFrame([('1,"1",,"a ""b"", c",x',), ("",), ('"",true',)], "value string")
    rows = lines.select(text_tables.typed_cells(F.col("value")).alias("c")).collect()
    assert [(c["kind"], c["text"]) for c in rows[0]["c"]] == [("integer", "1"), ("string", "1"), ("null", None), ("string", 'a "b", c'), ("string", "x")]
    assert [(c["kind"], c["text"]) for c in rows[1]["c"]] == [("null", None)]
    assert [(c["kind"], c["text"]) for c in rows[2]["c"]] == [("string", ""), ("boolean", "true")]


@pytest.mark.parametrize("kind", ["json", "csv", "tsv", "xml", "parquet", "orc"])
def test_round_trip(spark, tmp_path, kind):
    schema = "n_nationkey int, n_name string, n_regionkey int"
    nation = spark.read.schema(schema).parquet("/root/testdata/sf0.001/nation.parquet")
    text_tables.write(nation, f"{tmp_path}/x", kind)
    back = text_tables.read(spark, f"{tmp_path}/x", kind, schema)
    assert sorted(back.collect()) == sorted(nation.collect())


@pytest.mark.parametrize("source", convert.COLUMN_FORMATS)
@pytest.mark.parametrize("target", convert.COLUMN_FORMATS)
def test_column_conversions(spark, source, target):
    schema = "a int, b string"
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    text = df.select("a", convert.format_as(source, F.struct("a", "b")).alias("t"))
    back = text.select("a", convert.parse_as(target, convert.convert_column(F.col("t"), source, target, schema), schema).alias("r"))
    assert [r["a"] for r in back.select("r.a").collect()] == [1, 2]

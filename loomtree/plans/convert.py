"""Conversions between formats: as columns of text, and as files, always by way of typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtree.functions.text import decoded
from loomtree.sources import text_tables

COLUMN_FORMATS = ("json", "csv", "xml", "variant")


def parse_as(kind: str, text: Column, schema: str) -> Column:
    """A struct of this schema from a text column."""
    if kind == "json":
        return F.from_json(text, schema)
    if kind == "csv":
        return F.from_csv(text, schema)
    if kind == "xml":
        return F.from_xml(text, F.lit(schema))
    if kind == "variant":
        return F.try_variant_get(F.try_parse_json(text), "$", f"struct<{schema}>")
    raise ValueError(f"no column format {kind!r}; there are {', '.join(COLUMN_FORMATS)}")


def format_as(kind: str, row: Column) -> Column:
    if kind in ("json", "variant"):
        return F.to_json(row)
    if kind == "csv":
        return F.to_csv(row)
    if kind == "xml":
        return F.to_xml(row)
    raise ValueError(f"no column format {kind!r}; there are {', '.join(COLUMN_FORMATS)}")


def convert_column(text: Column, source: str, target: str, schema: str) -> Column:
    return format_as(target, parse_as(source, text, schema))


def convert_bytes(raw: Column, source: str, target: str, schema: str) -> Column:
    """The same for bytes of any encoding with a byte order mark, or UTF-8."""
    return F.encode(convert_column(decoded(raw), source, target, schema), "UTF-8")


def convert_files(spark: SparkSession, source: str, source_kind: str, target: str, target_kind: str, schema: str | None = None) -> DataFrame:
    """Writes what source holds in another format and returns it as read back."""
    df = text_tables.read(spark, source, source_kind, schema)
    text_tables.write(df, target, target_kind)
    return text_tables.read(spark, target, target_kind, schema)

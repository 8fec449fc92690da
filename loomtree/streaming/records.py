"""Streams of records: the same stateless operators on readStream, and windowed totals with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtree.functions.paths import at_pointer
from loomtree.functions.values import number
from loomtree.operators.schema import is_valid


def documents(stream: DataFrame, text: str) -> DataFrame:
    """Adds the document of a JSON text column; a bad text gives NULL."""
    return stream.withColumn("document", F.try_parse_json(F.col(text)))


def valid_only(stream: DataFrame, schema: object, document: str = "document") -> DataFrame:
    return stream.where(F.col(document).isNotNull() & is_valid(F.col(document), schema))


def windowed_totals(stream: DataFrame, time: str, key: Column, pointer: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of one number of the documents by event-time window and key; state goes with the watermark."""
    value = number(at_pointer(F.col("document"), pointer))
    rows = stream.select(F.col(time).cast("timestamp").alias(time), key.alias("key"), value.alias("value")).withWatermark(time, late)
    out = rows.groupBy(F.window(time, length), "key").agg(F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))
    return out.select(F.col("window.start").alias("start"), "key", "n", "total")

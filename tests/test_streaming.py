"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from loomtree.streaming import records

DATA = "/root/testdata/sf0.001/events.parquet"


def test_windowed_totals(spark, tmp_path):
    batch = spark.read.parquet(DATA)
    batch.write.parquet(f"{tmp_path}/in")
    stream = records.documents(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in"), "props")
    stream = records.valid_only(stream, {"required": ["k"]})
    out = records.windowed_totals(stream, "ts", F.col("event_type"), "/k")
    q = out.writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", f"{tmp_path}/check").start()
    q.processAllAvailable()
    q.stop()
    want = records.windowed_totals(records.documents(batch, "props"), "ts", F.col("event_type"), "/k")
    key = lambda r: (r["start"], r["key"])
    assert sorted(spark.table("totals").collect(), key=key) == sorted(want.collect(), key=key)

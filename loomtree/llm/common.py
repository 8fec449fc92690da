"""Shared helpers of the training-data operators: tables, written intermediates and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what setCheckpointDir() was given; a temporary one in local mode alone."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/loomtree-checkpoints"
        context.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/loomtree/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go when it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors. The shuffle files behind it go."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files behind a table of written() that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def salted_join(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, by: str, how: str = "inner", most: int = 4096) -> DataFrame:
    """left and right joined by key, where some keys have very many rows of left: sizes gives (key, n).

    A key of more than most rows is split into parts of about as many, by a hash of the column by, and right's rows of that key are repeated for each part.
    """
    split = sizes.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("_parts"))
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))
    parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    left, right = left.join(split, key, "left").withColumn("_part", part), right.join(split, key, "left").withColumn("_part", parts)
    return left.drop("_parts").join(right.drop("_parts"), [key, "_part"], how).drop("_part")


def rest_of(df: DataFrame, *made: str) -> list[str]:
    """The columns of df but for those of these names, in any case, as Spark's names have none: an operator's own columns replace them."""
    names = {c.lower() for c in made}
    return [c for c in df.columns if c.lower() not in names]


def hex_bucket(key: Column, digits: int) -> Column:
    """The first hex digits of a string's MD5 as an integer; the same in any SQL dialect."""
    return F.conv(F.substring(F.md5(key), 1, digits), 16, 10).cast("long")


# -- Arrow texts as flat byte buffers ---------------------------------------------------------------------------------


def flat_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]] if len(offsets) else flat[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def pieces(batch: pa.RecordBatch, text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about most_bytes of text each; a longer text is a run of its own."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if k > start and total + size > most_bytes:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += int(size)
    if start < len(sizes):
        yield batch.slice(start, len(sizes) - start)


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, 1 << 16), dtype=np.uint64)
        out[1:] = np.uint64(base % (1 << 64))
        with np.errstate(over="ignore"):
            _powers[base] = have = np.multiply.accumulate(out)
    return have[:n]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(flat: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row: (hashes, offsets of the rows' words, words' first bytes, ends)."""
    n = len(flat)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    if lower:
        flat = _LOWER[flat]
    inside = ~_IS_SPACE[flat]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][(offsets[:-1] < n)]
    begins[first] |= inside[first]
    starts = np.flatnonzero(begins)
    # a word ends at the next space, the next row or the end
    stops = np.flatnonzero(np.concatenate([inside[:-1] & (~inside[1:] | begins[1:]), inside[-1:]])) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
        hashes = mixed((sums[stops] - sums[starts]) * powers(_INVERSE, n)[starts], 1)
    return hashes, np.searchsorted(starts, offsets), starts, stops

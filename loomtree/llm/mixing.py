"""Mixing sources to target weights by systematic sampling.

Targets: sources in code-point order, null last, weigh by a repeating list and share a multiple of all sizes; a target
stops at a multiple of its source's size and the excess is shared by weight among the rest until none is above. This is
min(cap, rate * weight) with one rate, found by ordering the sources by cap / weight.

Sampling: each document of a source expects target / source size copies. The expected copies are summed along an order of
the source's documents, one random offset is added, and a document is taken once for each integer that its stretch
crosses. The order runs by size class, so that the sizes taken follow the target closely.

Positions need no sort of a whole source: a cell is a (source, size class, hash bucket); cells are counted first, their
counts are summed in order, and rows are numbered within their cells. A source has at most 512 size classes times
BUCKETS cells however many documents it has.

Targets are found by windows over all sources, a row each, in one task: this is for sources in their thousands, not for one a host.

Defined results: null text has size 0; documents of size 0 keep their copies but take no words; a source of size 0 has target
0; repeated rows are sampled one by one; an empty table gives no rows; other columns pass through, but for names that
the operator writes itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtree.llm.common import WORD, hex_bucket, rest_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
BUCKETS = 256


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From (source_null, source_key, source_size), one row a source: with target."""
    order = Window.orderBy("source_null", "source_key")
    place = (F.row_number().over(order) - 1) % len(weights)
    df = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    df = df.withColumn("cap", F.col("source_size") * cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    every, below = Window.partitionBy(), Window.orderBy("ratio", "source_null", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    rate = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    df = df.withColumn("rate", rate)
    level = F.min(F.when(F.col("rate") <= F.col("ratio"), F.struct("ratio", "source_null", "source_key", "rate"))).over(every)["rate"]
    target = F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap"))
    return df.select("source_null", "source_key", "source_size", target.alias("target"))


def offset(source_key: Column, seed: int) -> Column:
    """A number in [0, 1) of each source, the same in every run."""
    return hex_bucket(F.concat(F.lit(f"{seed}/"), source_key), 8) / F.lit(float(1 << 32))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 7) -> DataFrame:
    """docs with size, source_size, target, copies, taken: how often the mix takes each document, and its words so taken."""
    made = ["size", "source_size", "target", "copies", "taken"]
    rest = rest_of(docs, *made)
    # flat, so that columns that nobody reads afterwards, like texts, are not shuffled
    df = docs.select(*[docs[c].alias(f"_rest{k}") for k, c in enumerate(rest)], docs[doc_id].alias("id"), n_words(docs[text].cast("string")).alias("size"), docs[source].cast("string").alias("source"))
    size_class = F.when(F.col("size") == 0, -1).otherwise(F.floor(F.log2(F.col("size").cast("double")) * 8)).cast("int")
    df = df.withColumns({
        "source_null": F.col("source").isNull(),
        "source_key": F.coalesce("source", F.lit("")),
        "size_class": size_class,
        "bucket": hex_bucket(F.coalesce(F.col("id").cast("string"), F.lit("")), 2) % BUCKETS,
    })
    key = ["source_null", "source_key"]
    cell = [*key, "size_class", "bucket"]
    cells = df.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    targets = source_targets(cells.groupBy(*key).agg(F.sum("words").alias("source_size")), weights, share, cap)
    before = Window.partitionBy(*key).orderBy("size_class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n", "words").join(targets, key)
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("size", "id")) + F.col("before")
    df = df.join(cells, cell).withColumn("place", place)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    df = df.withColumn("each", each).withColumn("offset", offset(F.col("source_key"), seed))
    copies = F.floor(F.col("place") * F.col("each") + F.col("offset")) - F.floor((F.col("place") - 1) * F.col("each") + F.col("offset"))
    df = df.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return df.select(*[F.col(f"_rest{k}").alias(c) for k, c in enumerate(rest)], *made)

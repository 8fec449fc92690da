"""A training corpus from documents: quality rules, near-dedup, repeated passages, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all rows that the stage before kept.

Defined results: a stage reads doc_id, text, lang, source and n_chars; further columns, whatever their names, end with the first stage. A null in any
column is kept as it is; a document without an id is a document like others. Null, empty and blank texts have no words and go with
the quality rules. Rows are judged one by one there; near-dedup keeps one row of a class, the one of least doc_id (nulls last), and other texts
under the same id stay; in suffix-array dedup rows equal in doc_id and text are one document; in mixing and packing they count one by one. n_chars follows the text.
A document that suffix-array dedup empties stays, with an empty text. An empty table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtree.llm.common import table, written
from loomtree.llm.minhash import digested, near_classes
from loomtree.llm.mixing import mix_sources
from loomtree.llm.packing import best_fit_packing
from loomtree.llm.quality_rules import quality_rules
from loomtree.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEY = ["_unknown", "_id", "_node"]


def _documents(df: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with this text."""
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that failed."""
    return _documents(quality_rules(docs).where("kept"), "clean_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document of least doc_id (nulls last), then of least digest of its words, stays: one row, that of least text."""
    order = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("node")]
    least = near_classes(docs).groupBy("root").agg(F.min(F.struct(*[c.alias(n) for c, n in zip(order, KEY, strict=True)])).alias("least"))
    rows = digested(docs).select(*[c.alias(n) for c, n in zip(order, KEY, strict=True)], *COLUMNS)
    once = Window.partitionBy(*KEY).orderBy("text", "lang", "source", "n_chars")
    rows = rows.withColumn("_row", F.row_number().over(once)).where("_row = 1")
    return rows.join(least.select("least.*"), KEY, "left_semi").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of their later places; a character that a cut splits goes with it."""
    return _documents(remove_repeats(docs, as_text=True), "kept")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_sources(docs).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs)


STAGES = [("quality rules", rules), ("near-dedup", near_dedup), ("suffix-array dedup", repeats), ("mixing", mix), ("packing", pack)]

#: Near-dedup, suffix order and tokenization are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Nulls, empty tables, ties, repeated rows, long texts and clashing column names for every operator."""

import pytest
from helpers import DOCUMENT, docs, odd_rows
from pyspark.sql import functions as F

from loomtree.llm import lm_score, media, minhash, mixing, packing, quality_classifier, quality_rules, suffix_dedup, token_file


def classified(df):
    return quality_classifier.classify(df, quality_classifier.fit_on(df, df.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade"))))


OPERATORS = {
    "classifier": classified,
    "media": lambda df: media.index_media(media.to_media(df)),
    "suffix": suffix_dedup.remove_repeats,
    "mixing": mixing.mix_sources,
    "minhash": minhash.near_duplicates,
    "tokens": lambda df: token_file.read_tokens(token_file.write_tokens(df)),
    "lm": lm_score.pseudo_likelihood,
    "packing": packing.best_fit_packing,
    "rules": quality_rules.quality_rules,
}
#: Names that operators make or use inside.
CLASHING = "_row _text _hash _id _known _marks _firsts _words _lines row id size target each offset place bucket n sketch node root class_id kept n_bytes n_removed media payload feature codec ids start length piece sequence_id copies taken n_tokens log_prob expected_grade tail_prob clean_text n_words _rank _bucket before".split()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCUMENT)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    rows = odd_rows()
    out = OPERATORS[name](docs(spark, rows, source=None)).collect()
    if name == "packing":
        out = [r for r in out if r["piece"] == 0]
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_only_nulls(spark, name):
    out = OPERATORS[name](spark.createDataFrame([(None, None, None, None, None)] * 3, DOCUMENT)).collect()
    assert len(out) == 3


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    plain = docs(spark, odd_rows())
    crowded = plain.withColumns({c: F.lit("x") for c in CLASHING})
    want, got = OPERATORS[name](plain), OPERATORS[name](crowded)
    assert set(want.columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    shared = want.columns
    assert sorted(map(str, got.select(*shared).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_rerun_on_other_partitions(spark, name):
    df = docs(spark, odd_rows())
    first, second = (OPERATORS[name](df.repartition(n)) for n in (1, 6))
    columns = [c for c in first.columns if c not in ("sequence_id", "offset", "log_prob", "mean_log_prob")]
    assert sorted(map(str, first.select(*columns).collect())) == sorted(map(str, second.select(*columns).collect()))


def test_very_long_text(spark):
    long = " ".join(f"word{k % 997}x{k % 89}" for k in range(250_000))
    df = docs(spark, [(1, long), (2, long), (3, long[:1000])])
    for name in ("media", "suffix", "mixing", "minhash", "packing", "rules"):
        assert OPERATORS[name](df).count() >= 3

"""Near-dedup of the pipeline with null ids, repeated ids with other texts, and repeated rows."""

import random

from helpers import docs, prose

import corpus_pipeline


def kept(spark, rows):
    out = corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()
    return sorted(((r["doc_id"], r["text"]) for r in out), key=str)


def test_survivors_are_rows(spark):
    rng = random.Random(21)
    a, b, c, d, e, f = (prose(rng, 60) for _ in range(6))
    near = a + " end"
    rows = [(None, b), (None, c), (None, c), (None, f + " end"), (1, f)]  # null ids: other texts stay, copies do not
    rows += [(3, a), (5, near), (5, "zz " + d), (6, "zz " + d)]  # 5's copy of 3 goes, its own text stays
    rows += [(7, e), (7, e), (8, e)]
    assert kept(spark, rows) == sorted([(None, b), (None, c), (1, f), (3, a), (5, "zz " + d), (7, e)], key=str)
    # of one class with null ids only, one row stays
    assert len(kept(spark, [(None, a), (None, near), (None, near)])) == 1

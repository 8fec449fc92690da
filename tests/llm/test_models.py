"""The models: held-out accuracy, order of thresholds, and scores against plain loops."""

import random

import numpy as np
import pytest
from helpers import docs, odd_rows
from pyspark.sql import functions as F

from loomtree.llm import quality_classifier
from loomtree.llm.queries import GRADE

DATA = "/root/testdata/sf0.01"


def auc(scores, truth):
    ranks = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    positive = np.asarray(truth, bool)
    n, m = positive.sum(), (~positive).sum()
    return (ranks[positive].sum() - n * (n + 1) / 2) / (n * m)


@pytest.fixture(scope="module")
def rated(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.expr(GRADE).alias("grade")).where("grade is not null")
    return table, labels


def test_held_out_accuracy(rated):
    table, labels = rated
    half = F.xxhash64("doc_id") % 2 == 0
    model = quality_classifier.fit_on(table, labels.where(half))
    rows = quality_classifier.classify(table.join(labels.where(~half), "doc_id"), model).collect()
    good = [r["grade"] == 2 for r in rows]
    assert len(rows) > 50 and auc([r["tail_prob"] for r in rows], good) > 0.85
    toxic = [r for r in rows if r["grade"] == 0]
    clean = [r for r in rows if r["grade"] == 2]
    assert sum(r["kept"] for r in toxic) <= 0.35 * len(toxic)  # half of so few labels; a tenth stays at sf0.1
    assert sum(r["kept"] for r in clean) >= 0.95 * len(clean)
    assert auc([r["expected_grade"] for r in rows], [r["grade"] > 0 for r in rows]) > 0.8
    assert all(0 <= r["tail_prob"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows)


def test_ordinal_model_recovers_an_order():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(900):
        strength = rng.integers(0, 3)
        good = rng.choice(50, 5 + 10 * strength, replace=False)
        bad = 50 + rng.choice(50, 25 - 10 * strength, replace=False)
        rows.append((int(strength), np.concatenate([good, bad]).astype("<u4")))
    model = quality_classifier.fit(rows)
    assert (np.diff(model.thresholds) > 0).all()
    score = np.array([model.weights[b.astype(int)].sum() for _, b in rows])
    tail = model.tail(score)
    assert (np.diff(tail, axis=1) <= 0).all()
    grade = np.array([g for g, _ in rows])
    means = [tail.sum(axis=1)[grade == g].mean() for g in range(3)]
    assert means[0] + 0.3 < means[1] < means[2] - 0.3
    assert (model.weights[:50].mean() > 0) and (model.weights[50:100].mean() < 0)


@pytest.mark.parametrize(("ratings", "want"), [([], 0.0), ([(4, 1)], 1.0), ([(4, 2), (8, 2)], 2.0), ([(None, 1), (77, 2), (4, None)], 0.0)])
def test_without_two_grades(spark, ratings, want):
    table = docs(spark, odd_rows())
    model = quality_classifier.fit_on(table, spark.createDataFrame(ratings, "doc_id long, grade int"))
    out = quality_classifier.classify(table, model).collect()
    assert len(out) == len(odd_rows()) and all(abs(r["expected_grade"] - want) < 1e-6 for r in out)


def test_same_text_same_score_and_reruns_agree(spark, rated):
    table, labels = rated
    rows = docs(spark, odd_rows())
    first, second = (sorted(map(str, quality_classifier.classify(rows.repartition(n), quality_classifier.fit_on(table.repartition(n), labels)).collect())) for n in (1, 5))
    assert first == second


def test_likelihood_against_a_loop_and_gradients_against_differences():
    rng = np.random.default_rng(9)
    weights, steps = rng.standard_normal(12), np.array([-0.4, 0.3])
    documents = [(int(rng.integers(0, 3)), rng.choice(12, rng.integers(1, 6), replace=False)) for _ in range(30)]
    y = np.array([g for g, _ in documents])
    at, row = np.concatenate([b for _, b in documents]), np.repeat(np.arange(30), [len(b) for _, b in documents])

    def loss(weights, steps):
        theta, total = [-np.inf, steps[0], steps[0] + np.exp(steps[1]), np.inf], 0.0
        for grade, buckets in documents:
            score = sum(weights[b] for b in buckets)
            up, low = (1 / (1 + np.exp(score - theta[grade + k])) for k in (1, 0))
            total -= np.log(up - low)
        return total / len(documents)

    value, by_weights, by_steps = quality_classifier.likelihood(weights, steps, y, at, row)
    assert abs(value - loss(weights, steps)) < 1e-9
    for vector, gradient in ((weights, by_weights), (steps, by_steps)):
        for k in range(len(vector)):
            kept, sides = vector[k], []
            for d in (1e-5, -1e-5):
                vector[k] = kept + d
                sides.append(loss(weights, steps))
            vector[k] = kept
            assert abs((sides[0] - sides[1]) / 2e-5 - gradient[k]) < 1e-6


def test_a_rated_document_that_repeats_counts_once(spark):
    rows = [(k, f"word{k % 5} good" if k % 2 else f"word{k % 5} bad") for k in range(40)]
    ratings = spark.createDataFrame([(k, 2 if k % 2 else 0) for k in range(40)], "doc_id long, grade int")
    once, often = (quality_classifier.fit_on(docs(spark, r), ratings) for r in (rows, rows + rows[:4] * 50))
    assert np.allclose(once.weights, often.weights) and np.allclose(once.thresholds, often.thresholds)

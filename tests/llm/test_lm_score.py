"""The language model: gradients against differences, scores against a loop over words, what training and word order change."""

import random
from collections import Counter

import numpy as np
from helpers import WORD, docs, odd_rows, prose
from pyspark.sql import functions as F

from loomtree.llm import lm_score

DATA = "/root/testdata/sf0.01"


def weights(rng, counts):
    """Weights in double precision with no zeros."""
    return {k: x.astype(np.float64) + rng.standard_normal(x.shape) * 0.3 for k, x in lm_score.fresh(counts).items()}


def loss(w, ids):
    return -lm_score.log_probabilities(w, ids).sum()


def test_gradient_against_differences():
    rng = np.random.default_rng(4)
    ids = np.concatenate([[0, 0], rng.choice([5, 9, 70, 71, 300, 4090], 40), [0, 0]]).astype(np.int32)
    w = weights(rng, np.ones(lm_score.SIZE))
    moved = {k: x.copy() for k, x in w.items()}
    seen = {k: np.full_like(x, 1e12) for k, x in w.items()}  # steps are 1e-6 times the gradient
    lm_score.train_step(moved, seen, ids, np.flatnonzero(ids), rate=1.0)
    for name in w:
        gradient = (w[name] - moved[name]) * 1e6
        flat = np.abs(gradient).ravel()
        for at in [*np.argsort(flat)[-3:], *rng.choice(np.flatnonzero(flat > flat.max() / 100), 3)]:
            place = np.unravel_index(at, w[name].shape)
            sides = []
            for d in (1e-4, -1e-4):
                other = {k: x.copy() for k, x in w.items()}
                other[name][place] += d
                sides.append(loss(other, ids))
            assert abs((sides[0] - sides[1]) / 2e-4 - gradient[place]) < 1e-2 * (1e-1 + abs(gradient[place])), name


def test_scores_against_a_loop(spark):
    """Every word: probability of its group times that within the group, and for words without an id their share of the shape."""
    rows = [*odd_rows(), *((k, " ".join(f"w{n}x" for n in range(k, 6000, 3))) for k in range(20, 24))]
    table = docs(spark, rows).select(F.concat_ws("|", "doc_id", "text").alias("doc_id"), "text")
    counted = lm_score.count_words(table)
    vocabulary, counts = lm_score.frequent_words(counted)
    words = Counter(w.lower() for _, t in rows for w in WORD.findall(t or ""))
    w = lm_score.train(table, vocabulary, counts)
    assert len(vocabulary) == lm_score.WORDS < len(words) and counts.sum() == sum(words.values())

    def number(word):
        return int(lm_score.token_ids(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]), vocabulary)[0][2])

    shaped = Counter()
    for x, n in words.items():
        shaped[number(x)] += n
    assert all(counts[i] == n for i, n in shaped.items())

    def score(text):
        found = [x.lower() for x in WORD.findall(text or "")]
        ids, total = [0, 0, *map(number, found), 0, 0], 0.0
        for k, x in enumerate(found, 2):
            h = np.tanh(np.concatenate([w["places"][p][ids[k + d]] for p, d in enumerate((-2, -1, 1, 2))]) @ w["inner"] + w["shift"])
            for z, at in ((h @ w["group"] + w["group_bias"], ids[k] // 64), (h @ w["word"][ids[k] // 64] + w["word_bias"][ids[k] // 64], ids[k] % 64)):
                total += float(z[at] - np.log(np.exp(z.astype(float)).sum()))
            total += np.log(words[x] / shaped[ids[k]]) if ids[k] > lm_score.WORDS else 0.0
        return len(found), total

    out = sorted((r["doc_id"], r["n_tokens"], r["log_prob"]) for r in lm_score.pseudo_likelihood(table).collect())
    want = sorted(("|".join(str(x) for x in r if x is not None), *score(r[1])) for r in rows)
    assert len(out) == len(rows)
    for (i, n, got), (j, m, exact) in zip(out, want, strict=True):
        assert (i, n) == (j, m) and abs(got - exact) < 1e-4 * (1 + abs(exact))


def test_training_learns_what_neighbours_tell(spark):
    """A word that is the sum of its neighbours, left and right, is learnt far beyond its share; two places away counts too."""
    rng = random.Random(2)
    rows = []
    for k in range(2500):
        line = []
        for _ in range(40):
            a, b = rng.randrange(5), rng.randrange(5)
            line += [f"a{a}", f"sum{(a + b) % 5}", f"b{b}", "stop"]
        rows.append((k, " ".join(line)))
    table = docs(spark, rows).select("doc_id", "text").repartition(2).cache()
    vocabulary, counts = lm_score.frequent_words(lm_score.count_words(table))
    trained = lm_score.train(table, vocabulary, counts)
    flat = np.frombuffer(rows[0][1].encode(), np.uint8)
    ids, _ = lm_score.token_ids(flat, np.array([0, len(flat)]), vocabulary)
    before = lm_score.log_probabilities(lm_score.fresh(counts), ids)
    after = lm_score.log_probabilities(trained, ids)
    sums = np.arange(3, len(ids) - 2, 4)
    assert after[sums].mean() > before[sums].mean() + 1.0
    assert after.sum() > before.sum()


def test_natural_order_scores_above_shuffled_words(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars > 400").select("doc_id", "text")
    rng = random.Random(0)
    rows = [(r["doc_id"], r["text"]) for r in table.orderBy("doc_id").limit(60).collect()]
    mixed = [(i + 10**9, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in rows]
    both = spark.createDataFrame(mixed, "doc_id long, text string")
    out = {r["doc_id"]: r["mean_log_prob"] for r in lm_score.pseudo_likelihood(table.unionByName(both)).collect()}
    assert sum(out[i] > out[i + 10**9] for i, _ in rows) >= 54


def test_gibberish_of_the_same_shapes_scores_lower(spark):
    rng = random.Random(5)
    rows = [(k, prose(rng, 80)) for k in range(60)]
    other = WORD.sub(lambda m: "".join(rng.choice("qxzjkv") if c.isalpha() else c for c in m[0]), rows[0][1])
    out = {r["doc_id"]: r["mean_log_prob"] for r in lm_score.pseudo_likelihood(docs(spark, [*rows, (900, other)])).collect()}
    assert out[900] < min(out[k] for k, _ in rows) - 0.5


def test_texts_that_occur_twice_score_higher(spark):
    rng = random.Random(6)
    texts = [" ".join(f"q{rng.randrange(10**9)}" for _ in range(30)) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t) for k, t in enumerate(texts[:20])]
    out = {r["doc_id"]: r["mean_log_prob"] for r in lm_score.pseudo_likelihood(docs(spark, rows)).collect()}
    assert min(out[k] for k in range(20)) > max(out[k] for k in range(20, 40))


def test_reruns(spark):
    """The same partitions give the same scores; others nearly the same."""
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")

    def scores(n):
        return np.array([r["log_prob"] for r in lm_score.pseudo_likelihood(table.repartition(n, "doc_id")).orderBy("doc_id").collect()])

    first = scores(3)
    assert (first == scores(3)).all()
    assert np.corrcoef(first, scores(5))[0, 1] > 0.999


class Watched(np.ndarray):
    """Notes the axes along which it is reduced."""

    def __array_ufunc__(self, ufunc, method, *inputs, **more):
        if method == "reduce":
            self.axes.append(more.get("axis"))
        plain = {k: tuple(x.view(np.ndarray) for x in v) if k == "out" and v else v for k, v in more.items()}
        return getattr(ufunc, method)(*(x.view(np.ndarray) if isinstance(x, Watched) else x for x in inputs), **plain)


def test_softmax_goes_along_rows_only_out_of_range():
    """Reductions of short rows cost as much as the exponentials: outputs as they come have none."""
    for great, rows in ((50, 0), (1000, 1)):
        z = np.array([[1, great, 3], [0, 0, 0]], np.float32)
        for share in (lm_score._softmax, lambda x: lm_score._log_share(x, np.array([0, 1]))):
            watched = z.copy().view(Watched)
            watched.axes = []
            share(watched)
            assert watched.axes.count(1) == rows


def test_softmax_where_outputs_leave_the_range():
    z = np.array([[1000, 999, 0], [-1000, -1001, -3000], [1, 2, 3], [-60, 60, 60]], np.float32)
    share = z.astype(np.float64) - z.max(axis=1, keepdims=True)
    share -= np.log(np.exp(share).sum(axis=1, keepdims=True))
    for rows in (slice(0, 4), slice(2, 3), slice(3, 4)):
        assert np.allclose(lm_score._softmax(z[rows].copy()), np.exp(share[rows]), atol=1e-6)
        for at in range(3):
            assert np.allclose(lm_score._log_share(z[rows].copy(), at), share[rows, at], rtol=1e-6, atol=1e-5)


def test_ids_of_words_that_share_their_upper_bits():
    """Words of the vocabulary that differ only below the bits by which they are looked up, the last ones too."""
    words = np.array([(1 << 64) - 1, (1 << 64) - 2, 7, (1 << 64) - 3, 5, 1 << 50], np.uint64)
    flat = np.frombuffer(b"a" * len(words), np.uint8)
    found = words, np.array([0, len(words)]), np.arange(len(words)), np.arange(len(words)) + 1
    ids, _ = lm_score.token_ids(flat, np.array([0, len(words)]), words[[1, 4, 0, 2]], found)
    assert ids[2:-2].tolist() == [3, 1, 4, 1 + lm_score.WORDS, 2, 1 + lm_score.WORDS]

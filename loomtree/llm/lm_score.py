"""Masked pseudo-likelihood: each token's log-probability given its neighbours on both sides, summed over a document.

Tokens are lower-cased words. The WORDS most frequent words of the corpus have ids of their own, all others the id of their shape (by length
and by kinds of bytes); id 0 stands before the first and after the last. Frequencies are counted over all documents.

The network sees REACH tokens on either side: an embedding for each id and place, one tanh layer, and a softmax in two steps, first over
groups of GROUP ids of like frequency, then over the ids of the group, so that a token costs 2 * 64 outputs and not 4,096. It is trained on
every token of every document, in rounds: each task starts from the shared weights, goes once through its documents of the round by
Adagrad steps, and gives its change of the weights; the changes, weighted by tokens, are averaged in two shuffles of pieces of the weights, and
the mean (1.1 MB, whatever the corpus) begins the next round. The first round is a sixteenth of the documents, by a hash of the text, the last three quarters.

A word without an id of its own scores as its shape given the neighbours times its own share of the shape: log(count of the word / count
of the shape), from the counts of all words, joined to the words of the documents. That table grows with the corpus and stays distributed.

Defined results: a null or empty text has no tokens, scores 0 and has no mean; repeated rows all count; an empty table gives no rows; other
columns pass through, but for names that the operator writes itself. A run on the same files and partitions repeats; other partitions train on
other orders, and move scores slightly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from loomtree.llm.common import dropped, flat_bytes, pieces, rest_of, word_hashes, written

GROUP = 64
SIZE = GROUP * GROUP
SHAPES = 32
WORDS = SIZE - SHAPES - 1
REACH = 2
WIDTH = 12
HIDDEN = 24
STEP = 8192
RATE = 0.2
#: Documents whose hash modulo the last number lies below each number and not below the one before make a round.
ROUNDS = (1, 4, 16)
#: The weights travel in so many pieces, and are added up in so many parts first.
CHUNKS = 16
PARTS = 32
#: Logarithms of counts are added as whole numbers of 1 / UNIT, so that no order of rows changes a sum.
UNIT = 10**8

Weights = dict[str, np.ndarray]


def shapes(flat: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """0 to SHAPES - 1 for each word: its length in four classes, by digits, other ASCII marks and bytes beyond ASCII."""
    if not len(starts):
        return np.zeros(0, np.int64)
    kinds = np.zeros(256, np.uint8)
    kinds[48:58] = 1
    kinds[33:48] = kinds[58:65] = kinds[91:97] = kinds[123:127] = 2
    kinds[128:] = 4
    edges = np.stack([starts, stops], axis=1).ravel()
    found = np.bitwise_or.reduceat(np.append(kinds[flat], np.uint8(0)), edges)[::2].astype(np.int64)
    return np.searchsorted([3, 6, 10], stops - starts, side="left") * 8 + found


def token_ids(flat: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray, found: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words with REACH zeros before and after each row, and the offsets of the rows in that array; found: their word_hashes()."""
    words, rows, starts, stops = found or word_hashes(flat, offsets, lower=True)
    ids = 1 + WORDS + shapes(flat, starts, stops)
    if len(vocabulary) and len(words):
        # by the upper 16 bits, of which few words of the vocabulary share any
        order = np.argsort(vocabulary)
        shared = np.bincount((vocabulary >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
        first = (np.cumsum(shared) - shared)[(words >> np.uint64(48)).astype(np.int64)]
        for k in range(shared.max()):
            at = order[np.minimum(first + k, len(vocabulary) - 1)]
            ids = np.where(vocabulary[at] == words, 1 + at, ids)
    counts = np.diff(rows)
    out = np.zeros(len(ids) + 2 * REACH * len(counts), np.int32)
    out[np.arange(len(ids)) + REACH * (2 * np.repeat(np.arange(len(counts)), counts) + 1)] = ids
    return out, rows + 2 * REACH * np.arange(len(rows))


def neighbours(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids around each of the places at: 2 * REACH columns."""
    return ids[at[:, None] + np.array([*range(-REACH, 0), *range(1, REACH + 1)])]


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, shape, n): the hash of each lower-cased word of the corpus and how often it occurs; summed in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for part in pieces(batch, "text"):
                flat, offsets = flat_bytes(part.column(0))
                found, _, starts, stops = word_hashes(flat, offsets, lower=True)
                words.append(found)
                kinds.append(shapes(flat, starts, stops))
            found, first, counts = np.unique(np.concatenate(words), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.concatenate(kinds)[first]), pa.array(counts.astype(np.int64))], ["word", "shape", "n"])

    found = docs.select(docs[text].cast("string").alias("text")).mapInArrow(run, "word long, shape long, n long")
    return found.groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


def frequent_words(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words that have ids, of the table of count_words(), and how often each id occurs (at most SIZE rows come here)."""
    top = counted.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    counts = np.zeros(SIZE, np.int64)
    counts[1 : len(top) + 1] = [r["n"] for r in top]
    shaped = np.zeros(SHAPES, np.int64)
    for r in counted.groupBy("shape").agg(F.sum("n").alias("n")).collect():
        shaped[r["shape"]] = r["n"]
    for r in top:
        shaped[r["shape"]] -= r["n"]
    counts[1 + WORDS : 1 + WORDS + SHAPES] = shaped
    return np.array([r["word"] for r in top], np.int64).view(np.uint64), counts


def fresh(counts: np.ndarray, seed: int = 3) -> Weights:
    """Weights that give each id its share of the counts, whatever its neighbours."""
    rng = np.random.default_rng(seed)
    share = np.maximum(counts, 0.1).reshape(GROUP, GROUP)
    return {
        "places": (rng.standard_normal((2 * REACH, SIZE, WIDTH)) * 0.2).astype(np.float32),
        "inner": (rng.standard_normal((2 * REACH * WIDTH, HIDDEN)) * 0.15).astype(np.float32),
        "shift": np.zeros(HIDDEN, np.float32),
        "group": np.zeros((HIDDEN, GROUP), np.float32),
        "group_bias": np.log(share.sum(axis=1) / share.sum()).astype(np.float32),
        "word": np.zeros((GROUP, HIDDEN, GROUP), np.float32),
        "word_bias": np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and where each begins."""
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return sorted_[first], first


def _by_group(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return at[np.argsort((ids[at] // GROUP).astype(np.uint8), kind="stable")]


def outputs(w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """The weights of the two softmaxes, each with its bias as a last row, which meets a hidden value that is 1."""
    return np.concatenate([w["group"], w["group_bias"][None]]), np.concatenate([w["word"], w["word_bias"][:, None]], axis=1)


def forward(w: Weights, out: tuple[np.ndarray, np.ndarray], around: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """For tokens sorted by group: embeddings, hidden values and a 1, outputs for groups and for the ids in each token's group, and the runs of groups."""
    group, word = out
    x = w["places"].reshape(-1, WIDTH).take(around + SIZE * np.arange(2 * REACH), axis=0).reshape(len(token), -1)
    h = np.empty((len(token), HIDDEN + 1), x.dtype)
    np.tanh(x @ w["inner"] + w["shift"], out=h[:, :HIDDEN])
    h[:, HIDDEN] = 1
    within = np.empty((len(token), GROUP), x.dtype)
    which, first = _runs(token // GROUP)
    runs = list(zip(which.tolist(), first.tolist(), [*first[1:].tolist(), len(token)], strict=True))
    for g, a, b in runs:
        np.matmul(h[a:b], word[g], out=within[a:b])
    return x, h, h @ group, within, runs


def _in_range(z: np.ndarray) -> np.ndarray:
    """z, moved in place so that the greatest value of each row is 0 if exp could leave the range of the numbers; a softmax is the same after that."""
    if z.size and max(z.max(), -z.min()) > 60:
        z -= z.max(axis=1, keepdims=True)
    return z


def _sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], z.dtype)


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(_in_range(z), out=z)
    z /= _sums(z)[:, None]
    return z


def _log_share(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax of each row at one place."""
    chosen = _in_range(z)[np.arange(len(z)), at]
    return chosen - np.log(_sums(np.exp(z, out=z)))


def log_probabilities(w: Weights, ids: np.ndarray) -> np.ndarray:
    """Of each place of ids; 0 at the edges of rows."""
    found = np.zeros(len(ids))
    every, out = np.flatnonzero(ids), outputs(w)
    for k in range(0, len(every), STEP):
        at = _by_group(ids, every[k : k + STEP])
        token = ids[at]
        _, _, groups, within, _ = forward(w, out, neighbours(ids, at), token)
        found[at] = _log_share(groups, token // GROUP) + _log_share(within, token % GROUP)
    return found


def train_step(w: Weights, seen: Weights, ids: np.ndarray, at: np.ndarray, rate: float = RATE) -> None:
    """One Adagrad step on the tokens at these places; seen holds the sums of squared gradients."""
    at = _by_group(ids, at)
    token, around = ids[at], neighbours(ids, at)
    group, word = out = outputs(w)
    x, h, groups, within, runs = forward(w, out, around, token)
    row = np.arange(len(at))
    dg, dw = _softmax(groups), _softmax(within)
    dg[row, token // GROUP] -= 1
    dw[row, token % GROUP] -= 1
    dh, words = np.empty((len(at), HIDDEN), h.dtype), np.zeros_like(word)
    for g, a, b in runs:
        np.matmul(dw[a:b], word[g, :HIDDEN].T, out=dh[a:b])
        np.matmul(h[a:b].T, dw[a:b], out=words[g])
    dh += dg @ group[:HIDDEN].T
    groups = h.T @ dg
    h = h[:, :HIDDEN]
    dz = dh * (1 - h * h)
    dx = (w["inner"] @ dz.T).astype(np.float64).reshape(2 * REACH, WIDTH, -1)
    places = np.empty((2 * REACH, WIDTH, SIZE), h.dtype)
    for k, near in enumerate(around.T.astype(np.intp, order="C")):
        for j in range(WIDTH):
            places[k, j] = np.bincount(near, dx[k, j], SIZE)

    def move(name: str, gradient: np.ndarray) -> None:
        """By the gradient; where it is 0 nothing changes."""
        total = gradient * gradient
        total += seen[name]
        seen[name] = total
        total = np.sqrt(total)
        gradient = gradient * rate
        gradient /= total
        w[name] -= gradient

    move("word", np.ascontiguousarray(words[:, :HIDDEN]))
    move("word_bias", words[:, HIDDEN])
    move("group", groups[:HIDDEN])
    move("group_bias", groups[HIDDEN])
    move("inner", x.T @ dz)
    move("shift", dz.sum(axis=0))
    move("places", np.ascontiguousarray(places.transpose(0, 2, 1)))


def _flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _shaped(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


_CHANGE = "chunk int, part int, tokens long, change binary"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of equal chunk and part, each times its tokens, added up; held are a few chunks of the weights."""
    total: dict[tuple[int, int], list] = {}
    for batch in batches:
        for chunk, part, n, raw in zip(*(batch.column(c).to_pylist() for c in ("chunk", "part", "tokens", "change")), strict=True):
            at = total.setdefault((chunk, part), [0, 0.0])
            at[0], at[1] = at[0] + n, at[1] + np.frombuffer(raw, np.float64)
    rows = [(c, p, n, x.tobytes()) for (c, p), (n, x) in sorted(total.items())]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["chunk", "part", "tokens", "change"])


def train_round(texts: DataFrame, vocabulary: np.ndarray, w: Weights) -> Weights:
    """The weights after one pass of every task over its rows of texts (one column), averaged by tokens."""
    context = texts.sparkSession.sparkContext
    shared = context.broadcast((vocabulary, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = shared.value
        mine, tokens = {k: x.copy() for k, x in start.items()}, 0
        seen = {k: np.ones_like(x) for k, x in start.items()}
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, _ = token_ids(*flat_bytes(part.column("text")), known)
                every = np.flatnonzero(ids)
                for k in range(0, len(every), STEP):
                    train_step(mine, seen, ids, every[k : k + STEP])
                tokens += len(every)
        if tokens:
            change = np.array_split((_flat(mine) - _flat(start)).astype(np.float16).astype(np.float64) * tokens, CHUNKS)
            part = TaskContext.get().partitionId() % PARTS
            made = [pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array([part] * CHUNKS, pa.int32()), pa.array([tokens] * CHUNKS, pa.int64()), pa.array([c.tobytes() for c in change], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["chunk", "part", "tokens", "change"])

    parts = texts.mapInArrow(run, _CHANGE).repartition("chunk", "part").mapInArrow(_added, _CHANGE)
    whole = parts.select("chunk", F.lit(0).alias("part"), "tokens", "change").repartition("chunk").mapInArrow(_added, _CHANGE)
    rows = sorted(whole.collect(), key=lambda r: r["chunk"])  # CHUNKS rows, the weights once
    shared.destroy()
    return _shaped(_flat(w) + np.concatenate([np.frombuffer(r["change"], np.float64) / r["tokens"] for r in rows]), w) if rows else w


def train(docs: DataFrame, vocabulary: np.ndarray, counts: np.ndarray, text: str = "text") -> Weights:
    """The network after all rounds: every document is in one."""
    texts = docs.select(docs[text].cast("string").alias("text")).where("text <> ''")
    turn, w, below = F.pmod(F.xxhash64("text"), F.lit(ROUNDS[-1])), fresh(counts), 0
    for above in ROUNDS:
        w, below = train_round(texts.where((turn >= below) & (turn < above)), vocabulary, w), above
    return w


def pseudo_likelihood(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with n_tokens, log_prob (sum over tokens, each word with its own probability) and mean_log_prob (null without tokens)."""
    spark = docs.sparkSession
    counted = written(count_words(docs, text), "words")
    vocabulary, counts = frequent_words(counted)
    shared = spark.sparkContext.broadcast((vocabulary, train(docs, vocabulary, counts, text), np.log(np.maximum(counts, 1))))
    rest = rest_of(docs, text, "n_tokens", "log_prob", "mean_log_prob")
    rows = docs.select(F.monotonically_increasing_id().alias("_key"), F.struct(*[docs[c] for c in rest]).alias("_rest"), docs[text].cast("string").alias("_text"))
    schema = rows.select("_key", "_rest").schema.add("_n", "long").add("_score", "double").add("_words", ArrayType(LongType())).add("_times", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, classes = shared.value
        for batch in batches:
            for part in pieces(batch, "_text"):
                flat, offsets = flat_bytes(part.column("_text"))
                found = word_hashes(flat, offsets, lower=True)
                ids, at = token_ids(flat, offsets, known, found)
                n, value = np.diff(at) - 2 * REACH, log_probabilities(weights, ids)
                score = np.add.reduceat(value, at[:-1]) if len(n) else np.zeros(0)
                token = ids[ids > 0]
                rare = np.flatnonzero(token > WORDS)
                row = np.repeat(np.arange(len(n)), n)[rare]
                score = score - np.bincount(row, classes[token[rare]], minlength=len(n))
                order = np.lexsort((found[0][rare], row))
                row, words = row[order], found[0][rare][order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (words[1:] != words[:-1])])) if len(row) else row
                times = np.diff(np.append(first, len(row)))
                edges = pa.array(np.searchsorted(row[first], np.arange(len(n) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (words[first].view(np.int64), times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column("_key"), part.column("_rest"), pa.array(n), pa.array(score), *lists], schema.names)

    scored = written(rows.mapInArrow(run, schema), "scored")
    # a word that occurs once has logarithm 0
    own = counted.where("n > 1").select("word", F.round(F.ln("n") * UNIT).cast("long").alias("log"))
    held = scored.select("_key", F.explode(F.arrays_zip("_words", "_times")).alias("w")).select("_key", F.col("w._words").alias("word"), F.col("w._times").alias("times"))
    added = held.join(own, "word").groupBy("_key").agg(F.sum(F.col("times") * F.col("log")).alias("_log"))
    added = written(added, "added")
    dropped(spark, counted)
    total = F.col("_score") + F.coalesce(F.col("_log"), F.lit(0)) / F.lit(float(UNIT))
    out = scored.drop("_words", "_times").join(added, "_key", "left").withColumn("_total", total)
    mean = F.when(F.col("_n") > 0, F.col("_total") / F.col("_n"))
    return out.select(*[F.col("_rest")[c].alias(c) for c in rest], F.col("_n").alias("n_tokens"), F.col("_total").alias("log_prob"), mean.alias("mean_log_prob"))

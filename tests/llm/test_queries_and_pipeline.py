"""The registered queries: SQL where there is SQL, plain loops where there is none; the pipeline stage by stage."""

import glob
import hashlib
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import DOCUMENT, classes, docs, prose, removed, runs, word_similarity

import corpus_pipeline
from loomtree.llm import media, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    result = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert columns == sorted(names)
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())


def test_op3(spark, documents):
    out = {r["doc_id"]: r for r in queries.op3_media_columns(spark, DATA).collect()}
    assert len(out) == len(documents)
    for i, text in documents:
        raw = (text or "").encode()
        body = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = media.mux(body)
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_op4(spark, documents):
    rows = sorted(documents)
    raw = [(t or "").encode() for _, t in rows]
    want = set()
    for (i, _), text, gone in zip(rows, raw, removed(raw), strict=True):
        kept = bytes(np.frombuffer(text, np.uint8)[~np.array(gone, bool)]) if text else b""
        want.add((i, len(text), sum(gone), runs(gone), hashlib.sha256(kept).hexdigest()))
    assert {tuple(r) for r in queries.op4_suffix_dedup(spark, DATA).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()} == want


def test_op6_against_all_pairs(spark, documents):
    """All pairs of similar length, long documents too; a link that only the sketch could lose would show here."""
    words = {i: Counter((t or "").split()) for i, t in documents}
    rows = sorted((i, t or "") for i, t in documents)
    links = [(a, b) for b in range(len(rows)) for a in range(b) if (words[rows[a][0]] & words[rows[b][0]]).total() >= 0.7 * max(words[rows[a][0]].total(), words[rows[b][0]].total()) > 0 and word_similarity(rows[a][1], rows[b][1]) >= 0.8]
    root = classes(len(rows), links)
    chosen = docs(spark, rows)
    from loomtree.llm.minhash import near_duplicates

    out = {r["doc_id"]: r["class_id"] for r in near_duplicates(chosen).collect()}
    blank = {i for i, t in rows if not t.strip()}
    assert {i: c for i, c in out.items() if i not in blank} == {rows[k][0]: rows[c][0] for k, c in enumerate(root) if rows[k][0] not in blank}


def test_op7_and_op9_cover_all_ids(spark, documents):
    tokens = {r["doc_id"]: r for r in queries.op7_token_file(spark, DATA).collect()}
    assert len(tokens) == len(documents)
    at = 0
    for i in sorted(tokens):
        assert tokens[i]["start"] == at
        at += tokens[i]["n_tokens"]
    pieces: dict[int, list] = {}
    sequences: dict[int, list] = {}
    for r in queries.op9_best_fit_packing(spark, DATA).collect():
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, found in pieces.items():
        assert sum(n for _, _, n in found) == tokens[i]["n_tokens"]
        assert [p for p, _, _ in sorted(found)] == list(range(len(found)))
    for found in sequences.values():
        ends = [a + n for a, n in sorted(found)]
        assert [a for a, _ in sorted(found)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= -(-at // 2048) + 1


def test_all_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 11))
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "suffix-array dedup", "mixing", "packing"]


def corpus():
    """Clean documents, rejected ones, near copies, exact copies and a shared passage."""
    rng = random.Random(12)

    def clean(n):
        return "\n".join(" ".join(f"{rng.choice('river stone house light road'.split())}{rng.randrange(10**5)}" for _ in range(12)) + "." for _ in range(n))

    shared = clean(6)
    rows = [(k, clean(rng.randrange(3, 9))) for k in range(20)]
    rows += [(30, rows[3][1]), (31, rows[4][1].replace("river", "rivers", 1)), (32, "too short"), (33, None), (34, "buy now " * 40), (35, clean(3) + "\n" + shared), (36, clean(4) + "\n" + shared + "\n" + clean(2)), (37, "Home | About us | Contact\n" + clean(5))]
    return [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in rows]


def test_pipeline_stage_by_stage(spark):
    docs_ = spark.createDataFrame(corpus(), DOCUMENT)
    text = {i: t for i, t, *_ in corpus()}
    state, out = docs_, []
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, DATA)
        if name != "packing":
            assert state.columns == docs_.columns
        state = spark.createDataFrame(state.collect(), state.schema)
        out.append(state.collect())
    rules, near, repeats, mixed, packed = out
    assert {r["doc_id"] for r in rules} == set(text) - {32, 33, 34}
    assert all(r["text"] == text[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in rules if r["doc_id"] < 30)
    assert next(r["text"] for r in rules if r["doc_id"] == 37) == text[37].split("\n", 1)[1]
    assert {r["doc_id"] for r in near} == {r["doc_id"] for r in rules} - {30, 31}
    order = sorted((r["doc_id"], r["text"]) for r in near)
    raw = [t.encode() for _, t in order]
    cut = {i: bytes(b for b, g in zip(t, gone, strict=True) if not g).decode() for (i, _), t, gone in zip(order, raw, removed(raw), strict=True)}
    assert {r["doc_id"]: r["text"] for r in repeats} == cut and len(cut[36]) < len(text[36]) and cut[35] == text[35]
    assert {r["doc_id"] for r in mixed} <= set(cut) and all(r["text"] == cut[r["doc_id"]] for r in mixed)
    size = {s: sum(len(r["text"].split()) for r in repeats if r["source"] == s) for s in "ab"}
    taken = {s: sum(len(r["text"].split()) for r in mixed if r["source"] == s) for s in "ab"}
    assert taken["a"] == 2 * size["a"] or abs(taken["a"] - 1.5 * sum(size.values()) * 5 / 7) < 250
    assert sum(r["piece"] == 0 for r in packed) == len(mixed)


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_prose_helper_is_stable():
    assert prose(random.Random(1), 5) == prose(random.Random(1), 5)

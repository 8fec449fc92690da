import hashlib
import random

import numpy as np
import pytest
from helpers import docs, prose, removed, runs

from loomtree.llm import suffix_dedup
from loomtree.llm.suffix_dedup import remove_repeats


def expected(rows):
    """By doc_id (nulls first): the kept bytes and spans. doc_ids are distinct."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    raw = [(rows[k][1] or "").encode() for k in order]
    out = {}
    for k, text, gone in zip(order, raw, removed(raw), strict=True):
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out[rows[k][0]] = (len(text), sum(gone), runs(gone), hashlib.sha256(kept).hexdigest())
    return out


def found(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()}


def passages():
    rng = random.Random(11)
    common = [prose(rng, n) for n in (12, 25, 60)]
    rows = [(None, "no id. " + common[1]), (0, None), (1, ""), (2, "a" * 350), (3, "ab" * 130), (4, common[0] * 3)]
    for k in range(5, 40):
        parts = [prose(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 4))]
        for c in rng.sample(common, rng.randrange(0, 3)):
            cut = rng.randrange(0, len(c) // 2)
            parts.insert(rng.randrange(len(parts) + 1), c[cut:] if rng.random() < 0.5 else c)
        rows.append((k, rng.choice(["", " ", "é漢🙂"]).join(parts)))
    rows += [(100, rows[20][1]), (101, rows[20][1]), (102, "漢字" * 200)]
    return rows


@pytest.mark.parametrize("hot,most", [(4096, 1 << 27), (2, 1 << 27), (4096, 3000), (2, 500)])
def test_against_brute_force(spark, hot, most):
    """Also with hot anchors dealt by content, and with all records by way of files."""
    rows = passages()
    assert found(remove_repeats(docs(spark, rows[::-1]), hot=hot, most=most)) == expected(rows)


def test_files_go_with_the_task(spark, tmp_path, monkeypatch):
    folder = tmp_path / "shared"
    monkeypatch.setattr(suffix_dedup, "new_path", lambda spark, name: f"file://{folder}/{name}")
    assert found(remove_repeats(docs(spark, passages()), most=1000)) == expected(passages())
    assert folder.is_dir() and not list(folder.glob("suffix-files/*"))


def test_columns_of_the_transform():
    """Order and prefixes after all rounds are those of a plain sort of the reads of a group."""
    rng = np.random.default_rng(4)
    reads = rng.integers(97, 99, (40, suffix_dedup.COLUMNS)).astype(np.uint8)
    reads[20:, 10:] = reads[:20, 10:]
    n, begin = len(reads), suffix_dedup.STARTS - 1
    mask = suffix_dedup.first_windows(np.zeros(n, int), np.full(n, begin), np.full(n, suffix_dedup.STARTS), reads)
    for c in range(suffix_dedup.STARTS):
        seen = set()
        for k in range(n):
            window = reads[k, c : c + suffix_dedup.SPAN].tobytes()
            assert bool(mask[k] >> np.uint64(c) & np.uint64(1)) == (window not in seen)
            seen.add(window)


def test_lengths_around_the_span(spark):
    base = prose(random.Random(5), 60)
    rows = [(1, base[:300]), (2, "\x01" + base[50:149] + "\x02"), (3, "\x03" + base[50:150] + "\x04"), (4, "\x05" + base[50:151] + "\x06"), (5, base[:100]), (6, base[:99])]
    out = found(remove_repeats(docs(spark, rows)))
    assert out == expected(rows)
    assert [out[k][1] for k in (2, 3, 4, 5, 6)] == [0, 100, 101, 100, 0]


def test_as_text_drops_cut_characters(spark):
    shared = "é" * 60
    out = {r["doc_id"]: r["kept"] for r in remove_repeats(docs(spark, [(1, "a" + shared), (2, "漢" + shared + "字")]), as_text=True).collect()}
    assert out[1].startswith("aé") and out[2] == "漢字"


def test_repeated_rows_are_one_document(spark):
    text = prose(random.Random(6), 50)
    out = remove_repeats(docs(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in out) == [(1, 0), (1, 0), (2, len(text))]


def test_random_small_alphabet(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.randrange(90, 130))) * rng.randrange(1, 3)) for k in range(60)]
    assert found(remove_repeats(docs(spark, rows))) == expected(rows)

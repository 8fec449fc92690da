import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import docs, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtree.llm import token_file
from loomtree.llm.packing import best_fit_packing, pack_pieces, plan
from loomtree.llm.tokens import Encoder, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(texts):
    t = Tokenizer.from_file(PATH)
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'st \n\t.,1é漢 　\x1c\x85🙂|<>")) | st.characters(codec="utf-8"), max_size=40), max_size=6))
def test_encoder_gives_the_tokenizers_ids(texts):
    flat, counts = encoder(PATH).ids(texts)
    want = [x[:-1] for x in ids_of(texts)]
    assert counts.tolist() == [len(x) for x in want]
    assert flat.tolist() == [i for x in want for i in x]


def test_encoder_with_control_strings_and_other_vocabularies():
    texts = ["a <|endoftext|> b", "it's  we'll\n\nok", None, "", "Hello  World\n foo"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
        flat, counts = Encoder(public_tokenizers.path(name)).ids(texts)
        assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.data())
def test_bit_packing_round_trip(bits, values, data):
    ids = np.array(values, np.uint64) & np.uint64((1 << bits) - 1)
    raw = token_file.pack(ids.astype(np.uint32), bits)
    assert len(raw) == -(-len(ids) * bits // 8)
    first = data.draw(st.integers(0, len(ids) - 1))
    n = data.draw(st.integers(0, len(ids) - first))
    assert token_file.unpack(raw, first, n, bits).tolist() == ids[first : first + n].tolist()


def test_minimum_bits():
    assert [token_file.bits_for(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_random_access(tmp_path):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50000, 40_000).astype(np.uint32)
    w = token_file.Writer(f"file://{tmp_path}/x.ltb", 17)
    w.add(np.arange(4), np.zeros(4), ids, np.array([0, 10_000, 29_999, 1]))
    w.close()
    r = token_file.Reader(f"file://{tmp_path}/x.ltb")
    assert r.starts.tolist() == [0, 0, 10_000, 39_999, 40_000]
    for a, b in ((0, 1), (8191, 8193), (12_345, 39_999), (0, 40_000), (5, 5)):
        assert r.ids(a, b).tolist() == ids[a:b].tolist()


def test_token_file_against_the_tokenizer(spark):
    rows = odd_rows()
    out = [tuple(r) for r in token_file.read_tokens(token_file.write_tokens(docs(spark, rows).repartition(5))).orderBy("start").collect()]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1] is not None, (rows[k][1] or "").encode()))
    ids = ids_of([rows[k][1] for k in order])
    start, want = 0, []
    for k, x in zip(order, ids, strict=True):
        want.append((rows[k][0], start, len(x), crc(x)))
        start += len(x)
    assert out == want


def checked(rows, out, size):
    """Pieces are those of the cutting rule, and sequences are gapless."""
    want = []
    for (i, _), x in zip(rows, ids_of([t for _, t in rows]), strict=True):
        n = -(-len(x) // size)
        first = len(x) - (n - 1) * size
        edges = [0, *(first + k * size for k in range(n))]
        want += [(i, k, a, b - a, crc(x[a:b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    assert sorted(str(tuple(r)[:5]) for r in out) == sorted(map(str, want))
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_packing(spark):
    rng = random.Random(7)
    rows = odd_rows() + [(100 + k, prose(rng, rng.choice([3, 30, 30, 200, 900]))) for k in range(120)]
    out = best_fit_packing(docs(spark, rows)).collect()
    n = checked(rows, out, 2048)
    lengths = Counter(r["length"] for r in out)
    assert n <= best_fit_count(lengths, 2048)


def best_fit_count(counts, size):
    """Plain best fit, piece by piece: longest first, each into the tightest gap."""
    gaps = [0] * size
    n = 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            gap = next((g for g in range(length, size) if gaps[g]), size)
            if gap == size:
                n += 1
            else:
                gaps[gap] -= 1
            if gap > length:
                gaps[gap - length] += 1
    return n


@pytest.mark.parametrize("lengths", [range(1, 2049), range(600, 1101), range(200, 1201), range(683, 2049, 7)])
def test_never_more_sequences_than_best_fit(lengths):
    rng = random.Random(3)
    counts = {n: rng.randrange(1, 50) for n in lengths}
    found = plan(counts)
    assert sum(n for _, n in found) <= best_fit_count(counts, 2048)
    used: dict[int, int] = {}
    for pattern, times in found:
        for length, each in pattern:
            used[length] = used.get(length, 0) + each * times
    assert used == counts


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=40))
def test_plan_uses_every_piece_once(counts):
    used: dict[int, int] = {}
    n = 0
    for pattern, times in plan(counts, 64):
        assert sum(length * each for length, each in pattern) <= 64 and times > 0
        n += times
        for length, each in pattern:
            used[length] = used.get(length, 0) + each * times
    assert used == counts
    assert n <= best_fit_count(counts, 64)


def test_exact_complements_are_found():
    assert plan({60: 5, 4: 5}, 64) == [([(60, 1), (4, 1)], 5)]
    assert sum(times for _, times in plan({30: 2, 20: 2, 14: 2}, 64)) == 2
    assert sum(times for _, times in plan({25: 3, 19: 3, 11: 3, 9: 3}, 64)) == 3


def test_a_hot_length(spark):
    found = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 3 == 0, 2000).otherwise(48).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    out = pack_pieces(found)
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("places"), F.count("*").alias("pieces"))
    assert per.where("n > 2048 or places <> pieces").count() == 0
    assert per.count() == 6667 + -(-(13333 - 6667) // 42)


@pytest.mark.parametrize("size", [1, 7])
def test_small_sequences(spark, size):
    rows = [(1, "one two three four five six seven eight nine"), (2, None), (3, "x")]
    checked(rows, best_fit_packing(docs(spark, rows), size=size).collect(), size)


def test_equal_ids_stand_in_the_order_of_their_texts(spark):
    """One id for all rows, over many partitions."""
    rng = random.Random(8)
    rows = [(None if k % 2 else 7, prose(rng, 3)) for k in range(300)]
    df = docs(spark, rows).repartition(6)
    out = [tuple(r)[:1] + tuple(r)[2:] for r in token_file.read_tokens(token_file.write_tokens(df)).orderBy("start").collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[1].encode()))
    assert out == [(i, len(x), crc(x)) for (i, _), x in zip(order, ids_of([t for _, t in order]), strict=True)]

"""Packing pieces into sequences: exact complements by hashing sums of lengths, then best fit for what is left.

The plan needs only how many pieces there are of each length, at most `size` numbers however large the corpus. From the
longest length down, counts are consumed in combinations that fill a sequence exactly: one piece that fills the gap, then two
whose lengths sum to it, from an index of the sums of pairs, then three. What is left goes, longest first, into the tightest open gap. All steps
move counts, not pieces, and each uses up a length or a gap, so a plan has a few thousand entries at most.

Every piece then gets its rank among the pieces of its length, from counts of (length, hash bucket) cells and numbers
within cells, and the plan maps (length, rank) to a sequence and an offset. No task holds a whole length.

Defined results: null text is the end id alone; a document longer than a sequence is cut so that all pieces but the first
are full; repeated rows are packed one by one; an empty table gives no rows; other columns are ignored, and pack_pieces() replaces
columns named sequence_id and offset in any case.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtree.llm.common import hex_bucket, pieces, rest_of, written
from loomtree.llm.tokens import encoder, vocabulary_file

SIZE = 2048
BUCKETS = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, size: int = SIZE, text: str = "text", doc_id: str = "doc_id", vocabulary: str = "", end_id: int = 0) -> DataFrame:
    """The pieces of each document's ids: PIECES."""
    tokenizer = vocabulary_file(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for part in pieces(batch, "text"):
                flat, counts = coder.ids(part.column("text").to_pylist())
                ids = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
                totals = counts + 1
                n_pieces = -(-totals // size)
                first = totals - (n_pieces - 1) * size
                row = np.repeat(np.arange(len(totals)), n_pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                length = np.where(number == 0, first[row], size)
                start = np.where(number == 0, 0, first[row] + (number - 1) * size)
                ends = np.cumsum(length)
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(ends - length, ends, strict=True)]
                arrays = [part.column("doc_id").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, PIECES)


Pattern = tuple[list[tuple[int, int]], int]


def pair_sums(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An index of sums: the larger parts of all pairs of these lengths below size, by sum and longest first, and where each sum begins."""
    row, column = np.triu_indices(len(lengths))
    small, large = lengths[row], lengths[column]
    total = small + large
    inside = total < size
    order = np.lexsort((-large[inside], total[inside]))
    return large[inside][order], np.searchsorted(total[inside][order], np.arange(size + 1))


def exact_fits(left: np.ndarray, size: int, most: int) -> list[Pattern]:
    """Consumes from left the combinations that fill a sequence exactly: a head and a gap of one, two, up to most pieces.

    All heads, longest first, take single complements before any takes a pair, and pairs before triples, so that the
    short pieces that fill gaps alone aren't used up three at a time.
    """
    out: list[Pattern] = []
    large, begins = pair_sums(np.flatnonzero(left), size)

    def take(*combination: int) -> None:
        """Consumes a combination as often as the counts allow."""
        need: dict[int, int] = defaultdict(int)
        for x in combination:
            need[x] += 1
        times = min(int(left[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                left[x] -= k * times
            out.append((sorted(need.items(), reverse=True), times))

    def pairs(total: int) -> list[int]:
        found = large[begins[total] : begins[total + 1]]
        return found[(left[found] > 0) & (left[total - found] > (2 * found == total))].tolist() if total > 1 else []

    for depth in range(most + 1):
        for head in np.flatnonzero(left)[::-1].tolist():
            gap = size - head
            if depth == 0 and not gap:
                take(head)
            elif depth == 1 and 0 < gap <= head:
                take(head, gap)
            elif depth == 2:
                for b in pairs(gap):
                    if not left[head]:
                        break
                    take(head, b, gap - b)
            elif depth == 3:
                for d in np.flatnonzero(left[: max(0, min(head, gap - 2) + 1)])[::-1].tolist():
                    for b in pairs(gap - d):
                        if not left[head]:
                            break
                        take(head, d, b, gap - d - b)
                    if not left[head]:
                        break
    return out


def best_fits(left: np.ndarray, size: int) -> list[Pattern]:
    """Longest first, each piece goes into the tightest open gap."""
    gaps: dict[int, list[Pattern]] = defaultdict(list)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fits = [g for g in gaps if g >= length]
            gap = min(fits) if fits else size
            pattern, open_ = gaps[gap].pop() if fits else ([], n)
            if fits and not gaps[gap]:
                del gaps[gap]
            each = gap // length
            full = min(open_, n // each)
            if full:
                gaps[gap - each * length].append(([*pattern, (length, each)], full))
                n, open_ = n - full * each, open_ - full
            if open_ and n and n < each:
                gaps[gap - n * length].append(([*pattern, (length, n)], 1))
                n, open_ = 0, open_ - 1
            if open_ and pattern:
                gaps[gap].append((pattern, open_))
    return [x for found in gaps.values() for x in found]


def plan(counts: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """Patterns and how many sequences follow each: a pattern is a list of (length, times) that sums to at most size.

    Of the plans with complements of up to three, two, one and no pieces, all with best fit for what is left, the one of
    fewest sequences: never more than best fit alone.
    """
    best: list[Pattern] = []
    for most in (3, 2, 1, 0):
        left = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            left[length] += n
        found = exact_fits(left, size, most)
        found += best_fits(left, size)
        if not best or sum(n for _, n in found) < sum(n for _, n in best):
            best = found
    return best


def placed(patterns: list[tuple[list[tuple[int, int]], int]], size: int = SIZE) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset, pieces a sequence) in the order of ranks."""
    rank: dict[int, int] = defaultdict(int)
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            rows[length].append((rank[length], sequence, offset, each))
            rank[length] += each * times
            offset += each * length
        sequence += times
    return {length: np.array(x, np.int64) for length, x in rows.items()}


def pack_pieces(found: DataFrame, size: int = SIZE) -> DataFrame:
    """found (PIECES and any further columns, lengths from 1 to size) with sequence_id and offset."""
    spark = found.sparkSession
    names = rest_of(found, "sequence_id", "offset")
    df = found.select(*names, hex_bucket(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string")), 3).alias("_bucket") % BUCKETS)
    df = df.toDF(*names, "_bucket")
    cells = df.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    where = spark.sparkContext.broadcast(placed(plan(counts, size), size))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start")) - 1
    df = df.join(cells, ["length", "_bucket"]).select(*names, (number + F.col("_before")).cast("long").alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                table = where.value[int(length)]
                entry = table[np.searchsorted(table[:, 0], ranks[rows], side="right") - 1]
                turn = ranks[rows] - entry[:, 0]
                sequence[rows] = entry[:, 1] + turn // entry[:, 3]
                offset[rows] = entry[:, 2] + turn % entry[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = found.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return df.mapInArrow(run, schema)


def best_fit_packing(docs: DataFrame, size: int = SIZE, text: str = "text", doc_id: str = "doc_id", vocabulary: str = "", end_id: int = 0) -> DataFrame:
    """All documents' pieces with their sequences; ids are computed once and their digests written in between."""
    return pack_pieces(written(cut_documents(docs, size, text, doc_id, vocabulary, end_id), "pieces"), size)

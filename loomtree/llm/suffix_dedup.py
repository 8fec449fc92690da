"""Repeated passages by a column-wise suffix order of many documents at once.

A byte goes if a SPAN-byte string that covers it also starts earlier: in a document of smaller doc_id, or earlier in the same
one. Matches never cross documents; overlaps count; everything is judged on the input.

The suffix order is built as Burrows-Wheeler transforms of collections are built column by column: every round inserts one
more symbol of each document, to the left of what is in; the new symbols in the order so far are the transform's column, the order of all documents'
suffixes is a stable sort of it, and the longest common prefixes follow from minima over the old ones. Strings are equal where the
common prefix reaches SPAN. Each round reads and writes order, transform and prefixes once, front to back.

To run this on a cluster the corpus is cut into collections that can't share a string. Of every SPAN-byte window the
K-byte string of least hash is its anchor, so equal windows have equal anchors at equal places. (1) Anchors are dealt by hash, and those
that occur once are dropped. (2) Around each other anchor the bytes of its windows are a read, dealt by anchor. (3) In each
task, equal reads are one, and the rounds run over the columns of the reads, aligned at their anchors, to find the first
window of each class. (4) Back at its document, every window of a repeated anchor that is not the first of its class removes its
bytes. Windows of anchors with more than HOT occurrences are dealt by their own content, each equal one once per batch,
so that a passage in a third of all documents does not meet in one task as many times; this is a matter of ways, and changes no result.
(5) What a task receives beyond MOST bytes it deals to sequential files, by group, and takes back file by file, so that its memory does not grow with the corpus.

Defined results: null text is empty; shorter texts than SPAN keep all; a null doc_id comes first; of equal doc_ids with
different texts, the one with the smaller text hash is earlier; rows equal in doc_id and text are one document and get the
same result; an empty table gives no rows; other columns pass through, but for names that
the operator writes itself.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtree.llm.common import flat_bytes, mixed, new_path, pieces, rest_of, written

SPAN = 100
K = 50
STARTS = SPAN - K + 1  # columns at which a window can start; the anchor is at column STARTS - 1
COLUMNS = STARTS - 1 + SPAN
HOT = 4096
BLOCK = 1 << 14  # reads that are built at once
HELD = 1 << 17  # distinct reads that are held before they are sent
#: Records of a task that take more bytes than this go through files, in so many parts.
MOST = 128 << 20
PARTS = 64
_SEGMENT = 1 << 22
_LOW = np.uint64((1 << 24) - 1)
_BYTES = mixed(np.arange(256, dtype=np.uint64), 21)
_BASE = 0xD6E8FEB86659FD93
KEY = np.dtype([("null", "i1"), ("id", "<i8"), ("text", "<i8")])
#: 48 bits of a hash tell anchors apart: two that fall together are only read in vain.
ANCHOR = (np.dtype("<u4"), np.dtype("<u2"), np.dtype("<u4"), np.dtype("u1"), np.dtype("u1"))
READ = np.dtype([("h", "<u8"), ("back", "u1"), ("starts", "u1"), ("bytes", "u1", (COLUMNS,))])


def rolling(flat: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all strings of this length, by doubling."""
    with np.errstate(over="ignore"):
        power, done, parts, rest = _BYTES[flat], 1, None, length
        width = 0
        while True:
            if rest & done:
                if parts is None:
                    parts, width = power, done
                else:
                    n = len(flat) - width - done + 1
                    parts, width = parts[:n] * np.uint64(pow(_BASE, done, 1 << 64)) + power[width : width + n], width + done
            if done * 2 > length:
                break
            n = len(power) - done
            power, done = power[:n] * np.uint64(pow(_BASE, done, 1 << 64)) + power[done:], done * 2
    return mixed(parts, 22)


def anchors(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of each anchor of all rows; positions count from the start of flat."""
    out = []
    for base in range(0, max(len(flat) - SPAN + 1, 0), _SEGMENT):
        part = flat[base : base + _SEGMENT + SPAN - 1]
        n = len(part) - SPAN + 1
        hashes = rolling(part, K)
        least = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while width * 2 <= STARTS:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        least = np.minimum(least[:n], least[STARTS - width : STARTS - width + n])
        row = np.searchsorted(offsets, base + np.arange(n), side="right")
        starts = np.flatnonzero(offsets[np.minimum(row, len(offsets) - 1)] - (base + np.arange(n)) >= SPAN)
        if not len(starts):
            continue
        at = (least[starts] & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        out.append((hashes[at[first]], base + at[first], base + starts[first], base + starts[last]))
    if not out:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# -- blocks: the records that one batch sends to one bucket, with the keys of their documents ------------------------------


def block(keys: np.ndarray, docs: np.ndarray, *arrays: np.ndarray) -> bytes:
    """docs indexes keys; the block carries the keys that it needs, equal neighbours once."""
    used, index = np.unique(docs, return_inverse=True)
    own = keys[used]
    new = np.concatenate([[True], ~same_as_last(own)]) if len(own) else np.zeros(0, bool)
    own, index = own[new], (np.cumsum(new) - 1)[index]
    parts = [own.tobytes(), index.astype("<u4").tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]
    return struct.pack("<QQ", len(own), len(docs)) + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def opened(raw: bytes, *kinds: np.dtype) -> tuple[np.ndarray, ...]:
    """(document keys of the records, arrays...) of a block."""
    n_keys, n = struct.unpack_from("<QQ", raw)
    raw, at = zstandard.ZstdDecompressor().decompress(memoryview(raw)[16:]), 0
    keys = np.frombuffer(raw, KEY, n_keys, at)
    at += n_keys * KEY.itemsize
    index = np.frombuffer(raw, "<u4", n, at)
    at, out = at + 4 * n, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return keys[index], *out


Arrays = tuple[np.ndarray, ...]


def in_parts(batches: Iterator[pa.RecordBatch], kinds: tuple, group_of: Callable[..., np.ndarray], folder: str, most: int) -> Iterator[Arrays]:
    """The records of all blocks as arrays (keys first), whole groups at a time: all at once where they take at most `most` bytes, else by way of files.

    Then every record goes to one of PARTS files by a hash of its group, appended block by block; afterwards each file is read from front to back. The files lie in the shared
    folder, below a name that no other attempt of the task uses, and go when the task is through.
    """
    held: list[Arrays] = []
    size, streams, store, path = 0, [], None, ""
    try:
        for batch in batches:
            for x in batch.column("block"):
                held.append(opened(x.as_buffer(), *kinds))
                size += sum(a.nbytes for a in held[-1])
                if size <= most:
                    continue
                if not streams:
                    store, path = fs.FileSystem.from_uri(f"{folder}/{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}")
                    store.create_dir(path, recursive=True)
                    streams = [store.open_output_stream(f"{path}/{k}") for k in range(PARTS)]
                _append(streams, held, group_of)
                held, size = [], 0
        if not streams:
            if held:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            return
        if held:
            _append(streams, held, group_of)
        for s in streams:
            s.close()
        for k in range(PARTS):
            found = list(_blocks(store, f"{path}/{k}", (KEY, *kinds)))
            if found:
                yield tuple(np.concatenate(x) for x in zip(*found, strict=True))
    finally:
        if streams:
            for s in streams:
                s.close()
            store.delete_dir(path)


def _append(streams: list, held: list[Arrays], group_of: Callable[..., np.ndarray]) -> None:
    arrays = tuple(np.concatenate(x) for x in zip(*held, strict=True))
    part = (mixed(group_of(*arrays).astype(np.uint64), 31) >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(PARTS + 1))
    for k, s in enumerate(streams):
        rows = order[edges[k] : edges[k + 1]]
        if len(rows):
            s.write(struct.pack("<Q", len(rows)))
            for a in arrays:
                s.write(a[rows].tobytes())


def _blocks(store: fs.FileSystem, path: str, kinds: tuple) -> Iterator[Arrays]:
    with store.open_input_stream(path) as file:
        while head := file.read(8):
            (n,) = struct.unpack("<Q", head)
            yield tuple(np.frombuffer(file.read(n * np.dtype(kind).itemsize), kind, n) for kind in kinds)


def _of_document(keys: np.ndarray, *_: np.ndarray) -> np.ndarray:
    return keys["id"].astype(np.uint64) ^ keys["text"].astype(np.uint64)


def _of_anchor(keys: np.ndarray, high: np.ndarray, low: np.ndarray, *_: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) << np.uint64(16) | low


def _of_read(keys: np.ndarray, reads: np.ndarray, *_: np.ndarray) -> np.ndarray:
    return reads["h"]


def dealt(hashes: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """The records of each bucket."""
    bucket = ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, order[edges[b] : edges[b + 1]]) for b in range(buckets) if edges[b] < edges[b + 1]]


def key_array(part: pa.RecordBatch) -> np.ndarray:
    keys = np.zeros(part.num_rows, KEY)
    for name, column in (("null", "_known"), ("id", "_id"), ("text", "_hash")):
        keys[name] = np.asarray(part.column(column))
    return keys


def same_as_last(keys: np.ndarray) -> np.ndarray:
    """Whether each key but the first equals the one before it."""
    return (keys["id"][1:] == keys["id"][:-1]) & (keys["text"][1:] == keys["text"][:-1]) & (keys["null"][1:] == keys["null"][:-1])


def homeward(keys: np.ndarray, values: np.ndarray, buckets: int) -> pa.RecordBatch:
    """What a task found, as a block for each bucket of documents: rows are tasks times buckets, not documents times tasks."""
    sent = dealt(mixed(keys["id"].astype(np.uint64) ^ keys["text"].astype(np.uint64), 23), buckets)
    blocks = [block(keys, rows, values[rows]) for _, rows in sent]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in sent], pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])


def by_document(batches: Iterator[pa.RecordBatch], kind: np.dtype, folder: str, most: int) -> Iterator[pa.RecordBatch]:
    """Of the blocks for whole buckets of documents, one row a document: its key and its values as bytes."""
    for keys, values in in_parts(batches, (kind,), _of_document, folder, most):
        yield _by_document(keys, values)


def _by_document(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((keys["text"], keys["id"], keys["null"]))
    keys, values = keys[order], values[order]
    edges = np.flatnonzero(np.concatenate([[True], ~same_as_last(keys), [True]]))
    first, raw, size = keys[edges[:-1]], values.tobytes(), values.itemsize
    columns = [*(pa.array(np.ascontiguousarray(first[n])) for n in ("null", "id", "text")), pa.array([raw[i * size : j * size] for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["_known", "_id", "_hash", "_found"])


#: A text cell has less than 2 ** 31 bytes.
MARK = np.dtype([("at", "<u4"), ("back", "u1"), ("ahead", "u1"), ("hot", "u1")])
FIRST = np.dtype([("at", "<i8"), ("mask", "<u8")])
_FOUND = "_known byte, _id long, _hash long, _found binary"


def send_anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "_text"):
            flat, offsets = flat_bytes(part.column("_text"))
            h, at, first, last = anchors(flat, offsets)
            doc = np.searchsorted(offsets, at, side="right") - 1
            columns = (h >> np.uint64(32)).astype("<u4"), (h >> np.uint64(16)).astype("<u2"), (at - offsets[doc]).astype("<u4"), (at - first).astype("u1"), (at - last).astype("u1")
            keys, sent = key_array(part), dealt(h, buckets)
            blocks = [block(keys, doc[rows], *(c[rows] for c in columns)) for _, rows in sent]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in sent], pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])


def repeated_anchors(batches: Iterator[pa.RecordBatch], buckets: int, folder: str, most: int, hot: int = HOT) -> Iterator[pa.RecordBatch]:
    """Of the anchors of whole buckets, those with two or more places, for their documents."""
    for keys, high, low, at, back, ahead in in_parts(batches, ANCHOR, _of_anchor, folder, most):
        yield _repeated(keys, high, low, at, back, ahead, buckets, hot)


def _repeated(keys: np.ndarray, high: np.ndarray, low: np.ndarray, at: np.ndarray, back: np.ndarray, ahead: np.ndarray, buckets: int, hot: int) -> pa.RecordBatch:
    h = high.astype(np.uint64) << np.uint64(16) | low
    unique, doc = np.unique(keys, return_inverse=True)
    order = np.lexsort((back, at, doc, h))
    h, doc, at, back, ahead = (x[order] for x in (h, doc, at, back, ahead))
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1]) & (back[1:] == back[:-1])])
    h, doc, at, back, ahead = (x[~same] for x in (h, doc, at, back, ahead))
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.append(starts, len(h)))
    count = np.repeat(sizes, sizes)
    kept = count > 1
    marks = np.zeros(kept.sum(), MARK)
    marks["at"], marks["back"], marks["ahead"], marks["hot"] = at[kept], back[kept], ahead[kept], count[kept] > hot
    order = np.lexsort((marks["at"], doc[kept]))
    return homeward(unique[doc[kept][order]], marks[order], buckets)


def send_reads(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The bytes around each marked anchor; equal reads of a batch go once, as the earliest of them."""
    for batch in batches:
        for part in pieces(batch, "_text"):
            part = part.filter(part.column("_marks").is_valid())
            if not part.num_rows:
                continue
            flat, offsets = flat_bytes(part.column("_text"))
            found = [np.frombuffer(x, MARK) for x in part.column("_marks").to_pylist()]
            doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
            marks = np.concatenate(found) if found else np.zeros(0, MARK)
            each = np.where(marks["hot"], marks["back"].astype(np.int64) - marks["ahead"] + 1, 1)
            hashes, keys, held = rolling(flat, K), key_array(part), []
            turns = np.cumsum(each)
            cuts = np.searchsorted(turns, np.arange(BLOCK, turns[-1] if len(turns) else 0, BLOCK))
            for some in np.split(np.arange(len(marks)), cuts):
                held.append(built(flat, offsets, hashes, doc[some], marks[some], each[some], keys))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield sent_reads(keys, *merged(keys, held), buckets)
                    held = []
            if held:
                yield sent_reads(keys, *merged(keys, held), buckets)


def merged(keys: np.ndarray, held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(document, place, read) of these, equal reads once, as the earliest of them."""
    doc, at, reads = (np.concatenate(x) for x in zip(*held, strict=True))
    rank = np.lexsort((at, keys["text"][doc], keys["id"][doc], keys["null"][doc]))
    _, once = np.unique(reads[rank].view(f"V{READ.itemsize}"), return_index=True)
    return doc[rank[once]], at[rank[once]], reads[rank[once]]


def built(flat: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, doc: np.ndarray, marks: np.ndarray, each: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct reads of some marks: of a hot one, one for each window."""
    row = np.repeat(np.arange(len(marks)), each)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    back = marks["back"][row].astype(np.int64) - turn
    starts = np.where(marks["hot"][row], 1, marks["back"][row].astype(np.int64) - marks["ahead"][row] + 1)
    first = offsets[doc[row]] + marks["at"][row] - back
    columns = np.arange(COLUMNS)[None, :]
    cells = np.where(columns < (starts + SPAN - 1)[:, None], flat[np.minimum(first[:, None] + columns, max(len(flat) - 1, 0))] if len(flat) else 0, 0)
    reads = np.zeros(len(row), READ)
    reads["h"], reads["back"], reads["starts"], reads["bytes"] = hashes[offsets[doc[row]] + marks["at"][row]], back, starts, cells
    hot = np.flatnonzero(marks["hot"][row])
    if len(hot):
        reads["h"][hot] = rolling(reads["bytes"][hot][:, :SPAN].ravel(), SPAN)[::SPAN]
    return merged(keys, [(doc[row], marks["at"][row], reads)])


def sent_reads(keys: np.ndarray, doc: np.ndarray, at: np.ndarray, reads: np.ndarray, buckets: int) -> pa.RecordBatch:
    sent = dealt(reads["h"], buckets)
    blocks = [block(keys, doc[x], reads[x], at[x]) for _, x in sent]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in sent], pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])


def first_windows(group: np.ndarray, back: np.ndarray, starts: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each read, bit c set if its window at column c is the first of its class. Reads are in document order.

    group: which anchor (all reads of a group are aligned); text: bytes from the read's first column on.
    """
    n = len(group)
    begin = STARTS - 1 - back
    symbols = np.zeros((COLUMNS, n), np.uint16)
    for c in range(COLUMNS):
        at = c - begin
        there = (at >= 0) & (at < starts + SPAN - 1)
        symbols[c, there] = text[there, at[there]].astype(np.uint16) + 1
    order = np.argsort(group, kind="stable")
    prefix = np.zeros(n + 1, np.int16)
    grouped = group[order].astype(np.int64) << 16
    mask = np.zeros(n, np.uint64)
    for c in range(COLUMNS - 1, -1, -1):
        # the symbols before the suffixes, in the order of the suffixes: this column of the collection's Burrows-Wheeler transform
        transform = grouped | symbols[c][order]
        # inserting one symbol of each read is a stable sort of the transform; prefixes grow by one over the least of those passed
        move = np.argsort(transform, kind="stable")
        low = np.minimum.reduceat(prefix, move + 1)[:-1] if n > 1 else prefix[:0]
        transform = transform[move]
        prefix[0] = prefix[n] = 0
        prefix[1:n] = np.where(transform[1:] == transform[:-1], low + 1, 0)
        order = order[move]
        if c < STARTS:
            inside = (begin[order] <= c) & (c < begin[order] + starts[order])
            edges = np.flatnonzero(prefix[:n] < SPAN)
            least = np.minimum.reduceat(np.where(inside, order, n), edges)
            first = order[inside & (np.repeat(least, np.diff(np.append(edges, n))) == order)]
            mask[first] |= np.uint64(1 << c)
    return mask


def find_first(batches: Iterator[pa.RecordBatch], buckets: int, folder: str, most: int) -> Iterator[pa.RecordBatch]:
    """Of the reads of whole buckets, for their documents, the windows that are the first of their class."""
    for keys, reads, at in in_parts(batches, (READ, np.dtype("<u4")), _of_read, folder, most):
        yield _first(keys, reads, at, buckets)


def _first(keys: np.ndarray, reads: np.ndarray, at: np.ndarray, buckets: int) -> pa.RecordBatch:
    order = np.lexsort((at, keys["text"], keys["id"], keys["null"]))
    keys, reads, at = keys[order], reads[order], at[order]
    _, once = np.unique(reads.view(f"V{READ.itemsize}"), return_index=True)
    once.sort()
    keys, reads, at = keys[once], reads[once], at[once]
    _, group, size = np.unique(reads["h"], return_inverse=True, return_counts=True)
    back, starts = reads["back"].astype(np.int64), reads["starts"].astype(np.int64)
    mask = ((np.uint64(1) << starts.astype(np.uint64)) - np.uint64(1)) << (STARTS - 1 - back).astype(np.uint64)
    shared = np.flatnonzero(size[group] > 1)
    if len(shared):
        mask[shared] = first_windows(group[shared], back[shared], starts[shared], reads["bytes"][shared])
    some = mask != 0
    firsts = np.zeros(some.sum(), FIRST)
    firsts["at"], firsts["mask"] = at[some], mask[some]
    return homeward(keys[some], firsts, buckets)


def removed_bytes(n: int, marks: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Whether each of a document's n bytes is covered by a window of a repeated anchor that is not the first of its class."""
    repeated = np.zeros(n + 1, np.int32)
    place = marks["at"].astype(np.int64)
    np.add.at(repeated, place - marks["back"], 1)
    np.add.at(repeated, place - marks["ahead"] + 1, -1)
    window = np.cumsum(repeated[:n]) > 0
    for c in range(STARTS):
        here = firsts["at"][(firsts["mask"] >> np.uint64(c)) & np.uint64(1) == 1]
        window[here - (STARTS - 1) + c] = False
    cover = np.zeros(n + SPAN + 1, np.int32)
    at = np.flatnonzero(window)
    cover[at] += 1
    cover[at + SPAN] -= 1
    return np.cumsum(cover[:n]) > 0


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", as_text: bool = False, hot: int = HOT, most: int = MOST) -> DataFrame:
    """docs without text, with kept (the remaining bytes; as_text: without cut characters, as a string), n_bytes, n_removed, n_spans (maximal removed runs)."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = ["kept", "n_bytes", "n_removed", "n_spans"]
    rest = rest_of(docs, text, *made)
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    key = [docs[doc_id].isNotNull().cast("byte").alias("_known"), F.coalesce(docs[doc_id].cast("long"), F.lit(0)).alias("_id"), F.xxhash64(body).alias("_hash")]
    names = ["_known", "_id", "_hash"]
    rows = docs.select(*key, body.alias("_text"))
    sent = rows.mapInArrow(lambda b: send_anchors(b, buckets), "bucket int, block binary")
    folder = new_path(spark, "suffix-files")
    marks = sent.repartition("bucket").mapInArrow(lambda b: repeated_anchors(b, buckets, folder, most, hot), "bucket int, block binary")
    marks = written(marks.repartition("bucket").mapInArrow(lambda b: by_document(b, MARK, folder, most), _FOUND).withColumnRenamed("_found", "_marks"), "marks")
    # both uses of this join read all its columns, so that the texts are dealt once
    every = docs.select(*key, body.alias("_text"), F.struct(*[docs[c] for c in rest]).alias("_row")).join(marks, names, "left")
    sent = every.mapInArrow(lambda b: send_reads(b, buckets), "bucket int, block binary")
    firsts = sent.repartition("bucket").mapInArrow(lambda b: find_first(b, buckets, folder, most), "bucket int, block binary")
    firsts = firsts.repartition("bucket").mapInArrow(lambda b: by_document(b, FIRST, folder, most), _FOUND).withColumnRenamed("_found", "_firsts")
    schema = every.select("_row").schema.add("kept", "string" if as_text else "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                flat, offsets = flat_bytes(part.column("_text"))
                kept, sizes, spans = [], [], []
                for k, (m, f) in enumerate(zip(part.column("_marks").to_pylist(), part.column("_firsts").to_pylist(), strict=True)):
                    data = flat[offsets[k] : offsets[k + 1]]
                    if m:
                        gone = removed_bytes(len(data), np.frombuffer(m, MARK), np.frombuffer(f or b"", FIRST))
                        spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                        data = data[~gone]
                    else:
                        spans.append(0)
                    kept.append(data.tobytes().decode("utf-8", "ignore") if as_text else data.tobytes())
                    sizes.append(len(data))
                n = np.diff(offsets)
                arrays = [part.column("_row"), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(n), pa.array(n - np.array(sizes, np.int64)), pa.array(spans, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["_row", *made])

    return every.join(firsts, names, "left").mapInArrow(finish, schema).select("_row.*", *made)

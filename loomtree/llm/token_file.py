"""Token ids in files of fixed-width bit-packed blocks.

Layout of a file (little-endian): b"LTB1", then blocks of BLOCK ids, each id in `bits` bits, bit k of id t being bit
t * bits + k of its block; the last block is padded to whole bytes. Then the document table (doc_id int64, null flag uint8,
first id in the file uint64), the byte offset of each block (uint64), and a trailer: documents, blocks, ids (uint64), bits
(uint8), b"LTB1". Any run of ids is read from its blocks alone and unpacked by numpy at once.

Rows are range-partitioned and sorted by doc_id; a task streams its rows into one file whose name no other attempt uses, so
that a lost or repeated task leaves no half-written file in the manifest.

Defined results: null text is empty; each document ends with end_id; a null doc_id stands first; equal doc_ids stand in the
order of their texts; an empty table gives an empty manifest; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtree.llm.common import new_path, pieces, written
from loomtree.llm.tokens import encoder, vocabulary_file

BLOCK = 8192
MAGIC = b"LTB1"
TRAILER = struct.Struct("<QQQB4s")
MANIFEST = "part int, path string, n_documents long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, first: int, n: int, bits: int) -> np.ndarray:
    """Ids first ... first + n - 1 of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    at = (first + np.arange(n, dtype=np.int64)) * bits
    padded = np.frombuffer(raw + bytes(8), np.uint8)
    value = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        value |= padded[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    def __init__(self, path: str, bits: int) -> None:
        store, self.path = fs.FileSystem.from_uri(path)
        store.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out, self.bits = store.open_output_stream(self.path), bits
        self.out.write(MAGIC)
        self.at, self.n, self.rest = len(MAGIC), 0, np.zeros(0, np.uint32)
        self.blocks: list[int] = []
        self.keys: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.blocks.append(self.at)
        self.out.write(raw)
        self.at += len(raw)

    def add(self, keys: np.ndarray, nulls: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys.astype("<i8"))
        self.nulls.append(nulls.astype(np.uint8))
        self.starts.append((self.n + np.cumsum(counts) - counts).astype("<u8"))
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            self._block(self.rest[k : k + BLOCK])
        self.rest = self.rest[whole:]

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            self._block(self.rest)
        for parts in (self.keys, self.nulls, self.starts):
            self.out.write(b"".join(p.tobytes() for p in parts))
        self.out.write(np.array(self.blocks, "<u8").tobytes())
        n = sum(map(len, self.keys))
        self.out.write(TRAILER.pack(n, len(self.blocks), self.n, self.bits, MAGIC))
        self.out.close()
        return n, self.n


class Reader:
    def __init__(self, path: str) -> None:
        store, local = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(local)
        size = self.file.size()
        docs, blocks, self.n, self.bits, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        at = size - TRAILER.size - 8 * blocks
        self.end = at - 17 * docs
        self.blocks = np.frombuffer(self.file.read_at(8 * blocks, at), "<u8").astype(np.int64)
        self.keys = np.frombuffer(self.file.read_at(8 * docs, self.end), "<i8")
        self.nulls = np.frombuffer(self.file.read_at(docs, self.end + 8 * docs), np.uint8).astype(bool)
        self.starts = np.append(np.frombuffer(self.file.read_at(8 * docs, self.end + 9 * docs), "<u8").astype(np.int64), self.n)

    def ids(self, first: int, stop: int) -> np.ndarray:
        """Ids first ... stop - 1 of the file, from the blocks that hold them."""
        if stop <= first:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, (stop - 1) // BLOCK
        edges = np.append(self.blocks, self.end)
        raw = self.file.read_at(int(edges[b + 1] - edges[a]), int(edges[a]))
        parts = [unpack(raw[edges[k] - edges[a] : edges[k + 1] - edges[a]], 0, min(BLOCK, self.n - k * BLOCK), self.bits) for k in range(a, b + 1)]
        return np.concatenate(parts)[first - a * BLOCK : stop - a * BLOCK]


def write_tokens(docs: DataFrame, path: str = "", text: str = "text", doc_id: str = "doc_id", vocabulary: str = "", end_id: int = 0) -> DataFrame:
    """Writes the token files below path (one of its own in the shared folder if empty) and returns their manifest."""
    spark = docs.sparkSession
    path, tokenizer = path or new_path(spark, "tokens"), vocabulary_file(vocabulary)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    # a beginning of the text cuts runs of one doc_id at places that agree with the order of the texts
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer, task = encoder(tokenizer), None, TaskContext.get()
        file = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}.ltb"
        for batch in batches:
            for part in pieces(batch, "text"):
                writer = writer or Writer(file, bits_for(max(coder.vocabulary, end_id + 1)))
                flat, counts = coder.ids(part.column("text").to_pylist())
                ids = np.insert(flat, np.cumsum(counts), end_id)
                keys = part.column("doc_id")
                writer.add(np.asarray(pc.fill_null(keys, 0)), np.asarray(pc.is_null(keys)), ids, counts + 1)
        if writer:
            n, tokens = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([file]), pa.array([n], pa.int64()), pa.array([tokens], pa.int64())], ["part", "path", "n_documents", "n_tokens"])

    return written(rows.mapInArrow(run, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row a document in file order: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                reader = Reader(file)
                n, first = len(reader.keys), 0
                while first < n:  # runs of documents of about a million ids
                    last = max(first + 1, int(np.searchsorted(reader.starts, reader.starts[first] + (1 << 20))))
                    last = min(last, n)
                    edges = reader.starts[first : last + 1]
                    ids = reader.ids(int(edges[0]), int(edges[-1])).astype("<u4")
                    sums = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1] - edges[0], edges[1:] - edges[0], strict=True)]
                    keys = pa.array(reader.keys[first:last], pa.int64(), mask=reader.nulls[first:last])
                    yield pa.RecordBatch.from_arrays([keys, pa.array(base + edges[:-1]), pa.array(np.diff(edges)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    first = last

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(spread, "path").mapInArrow(run, ROWS)

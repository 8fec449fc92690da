"""Media columns: ISO base media files, built from payloads and indexed from their boxes and sample tables alone.

mux() writes ftyp, moov and mdat boxes around a payload: one track of 8-bit mono samples ('raw '), in chunks of
CHUNK_SAMPLES samples, the first of each chunk a sync sample. A sample here is SAMPLE_BYTES bytes of payload (one access unit), so
that tables stay short for long payloads.

index() walks the nested boxes of any such file, decodes stsd, mdhd, stts, stsc, stsz, stco or co64 and stss, and gives
for each track codec, duration and the byte ranges and times of the key samples, without looking at the payload. payload() joins the byte
ranges of all samples. Counts and offsets are held against the size of the file before anything of their size is made.

Defined results: null text is an empty payload; a payload is padded with zero bytes to a positive multiple of 64; equal
texts give equal files; a null, cut off or malformed file, one that is no ISO media file and one without a track have the feature 'invalid', no tracks and an
empty payload; of a fragmented file (moof boxes) the tables of moov alone are read and the feature begins with 'fragmented'; an empty
table gives no rows; other columns pass through, but for names that the operator writes itself.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomtree.llm.common import pieces, rest_of

ALIGN = 64
SAMPLE_BYTES = 64
CHUNK_SAMPLES = 64
TIMESCALE = 8000
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(ALIGN, -(-len(raw) // ALIGN) * ALIGN) - len(raw))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, bytes(4), *parts)


def _u32(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


def mux(payload: bytes) -> bytes:
    """An ISO media file that holds payload (a multiple of SAMPLE_BYTES) as 8-bit samples."""
    n = len(payload) // SAMPLE_BYTES
    chunks, rest = divmod(n, CHUNK_SAMPLES)
    n_chunks = chunks + bool(rest)
    runs = [(1, CHUNK_SAMPLES, 1)] * bool(chunks) + [(chunks + 1, rest, 1)] * bool(rest)
    matrix = _u32(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    duration = len(payload)

    def moov(base: int) -> bytes:
        offsets = base + np.arange(n_chunks, dtype=np.int64) * CHUNK_SAMPLES * SAMPLE_BYTES
        wide = n_chunks and int(offsets[-1]) >= 1 << 32
        places = _full(b"co64", _u32(n_chunks), offsets.astype(">u8").tobytes()) if wide else _full(b"stco", _u32(n_chunks), offsets.astype(">u4").tobytes())
        stbl = _box(
            b"stbl",
            _full(b"stsd", _u32(1), entry),
            _full(b"stts", _u32(1, n, SAMPLE_BYTES)),
            _full(b"stsc", _u32(len(runs)), *(_u32(*r) for r in runs)),
            _full(b"stsz", _u32(SAMPLE_BYTES, n)),
            places,
            _full(b"stss", _u32(n_chunks), (1 + np.arange(n_chunks, dtype=np.int64) * CHUNK_SAMPLES).astype(">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", _u32(1), _box(b"url ", _u32(1)))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", _u32(0, 0, TIMESCALE, duration), struct.pack(">HH", 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = _box(b"tkhd", b"\0\0\0\7", _u32(0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), matrix, bytes(8))
        mvhd = _full(b"mvhd", _u32(0, 0, TIMESCALE, duration, 0x10000), struct.pack(">HH", 256, 0), bytes(8), matrix, bytes(24), _u32(2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    ftyp = _box(b"ftyp", b"isom", _u32(512), b"isom", b"iso2")
    head = 8 if len(payload) + 8 < 1 << 32 else 16
    base = len(ftyp) + len(moov(1 << 33 if len(payload) >= 1 << 31 else 0)) + head
    return b"".join((ftyp, moov(base), _box(b"mdat", payload)))


def boxes(data: memoryview) -> Iterator[tuple[tuple, int, int]]:
    """Walks nested boxes, depth first: (path of types, first byte of the body, end)."""
    ends: list[tuple[int, tuple]] = [(len(data), ())]
    start = 0
    while ends:
        end, path = ends[-1]
        if start == end:
            ends.pop()
            continue
        if start + 8 > end:
            raise ValueError(f"{end - start} bytes after the last box")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,), body = struct.unpack_from(">Q", data, body), start + 16
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} does not fit")
        yield (*path[-8:], kind), body, stop
        if kind in CONTAINERS:
            ends.append((stop, (*path[-8:], kind)))
            start = body
        else:
            start = stop


def _table(data: memoryview, at: int, stop: int, columns: int, kind: str = ">u4") -> np.ndarray:
    """The rows of a table box, which must end within it."""
    (n,) = struct.unpack_from(">I", data, at + 4)
    if at + 8 + n * columns * np.dtype(kind).itemsize > stop:
        raise ValueError(f"a table of {n} rows does not fit")
    return np.frombuffer(data, dtype=kind, count=n * columns, offset=at + 8).astype(np.int64).reshape(n, columns)


def _sizes(data: memoryview, at: int, stop: int) -> np.ndarray:
    size, n = struct.unpack_from(">II", data, at + 4)
    if (size * n if size else at + 12 + 4 * n) > (len(data) if size else stop):
        raise ValueError(f"{n} samples do not fit")
    return np.full(n, size, np.int64) if size else np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)


def _placed(track: dict, length: int) -> None:
    """Adds the offset and the time of every sample; raises if the tables contradict each other or the file."""
    sizes, chunks, runs = track["sizes"], track["chunks"], track["stsc"]
    n = len(sizes)
    edges = np.append(runs[:, 0], len(chunks) + 1) if len(runs) else np.array([len(chunks) + 1])
    if len(runs) and (edges[0] != 1 or (np.diff(edges) < 0).any() or sum(int(a) * int(b) for a, b in zip(runs[:, 1], np.diff(edges), strict=True)) != n):
        raise ValueError("chunks and samples do not agree")
    if not len(runs) and n:
        raise ValueError("samples without chunks")
    each = np.repeat(runs[:, 1], np.diff(edges)) if len(runs) else np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(each) - each
    chunk = np.repeat(np.arange(len(each)), each)
    track["offsets"] = chunks[chunk] + before - before[first[chunk]] if n else np.zeros(0, np.int64)
    if n and (track["offsets"].min() < 0 or (track["offsets"] + sizes).max() > length):
        raise ValueError("samples beyond the end of the file")
    stts = track["stts"]
    if sum(int(k) for k in stts[:, 0]) not in ((n,) if len(stts) else (n, 0)):
        raise ValueError("times and samples do not agree")
    steps = np.repeat(stts[:, 1], stts[:, 0]) if len(stts) else np.zeros(n, np.int64)
    track["times"] = np.cumsum(steps) - steps
    if track["sync"] is None:
        track["sync"] = np.arange(n)
    elif len(track["sync"]) and (track["sync"].min() < 0 or track["sync"].max() >= n):
        raise ValueError("key samples beyond the last sample")


def index(data: bytes) -> list[dict]:
    """For each track: codec, timescale, duration, and the offset, size and time of every sample and the numbers of key samples."""
    view, tracks, fragmented = memoryview(data), [], False
    for path, at, stop in boxes(view):
        kind = path[-1]
        fragmented |= kind == b"moof"
        if kind == b"trak":
            none = np.zeros(0, np.int64)
            tracks.append({"codec": "", "timescale": 0, "duration": 0, "sync": None, "stts": none.reshape(0, 2), "stsc": none.reshape(0, 3), "sizes": none, "chunks": none})
        if b"trak" not in path:
            continue
        track = tracks[-1]
        if kind == b"mdhd":
            track["timescale"], track["duration"] = struct.unpack_from(">IQ", view, at + 20) if view[at] else struct.unpack_from(">II", view, at + 12)
        elif kind == b"stsd":
            track["codec"] = bytes(view[at + 12 : at + 16]).decode("latin-1")
        elif kind == b"stts":
            track["stts"] = _table(view, at, stop, 2)
        elif kind == b"stsc":
            track["stsc"] = _table(view, at, stop, 3)
        elif kind == b"stsz":
            track["sizes"] = _sizes(view, at, stop)
        elif kind == b"stco":
            track["chunks"] = _table(view, at, stop, 1)[:, 0]
        elif kind == b"co64":
            track["chunks"] = _table(view, at, stop, 1, ">u8")[:, 0]
        elif kind == b"stss":
            track["sync"] = _table(view, at, stop, 1)[:, 0] - 1
    for track in tracks:
        _placed(track, len(data))
        track["fragmented"] = fragmented
    return tracks


def payload(data: bytes, track: dict) -> bytes:
    """The bytes of a track's samples in order; samples that lie end to end are read as one range."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(offsets):
        return b""
    cut = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    firsts, lasts = np.concatenate([[0], cut]), np.concatenate([cut, [len(offsets)]]) - 1
    return b"".join(data[offsets[a] : offsets[b] + sizes[b]] for a, b in zip(firsts, lasts, strict=True))


def keyframes(track: dict) -> list[dict]:
    """Of each key sample its byte range and its time in units of the timescale."""
    offsets, sizes, times = (track[k][track["sync"]].tolist() for k in ("offsets", "sizes", "times"))
    return [{"start": a, "length": b, "time": t} for a, b, t in zip(offsets, sizes, times, strict=True)]


_TRACK = "codec:string,timescale:long,duration:long,n_samples:long,keyframes:array<struct<start:long,length:long,time:long>>"
#: Of a file: all tracks, the first one's fields, the samples of the first one end to end, and a line of text.
INDEX = f"tracks array<struct<{_TRACK}>>, codec string, timescale long, duration long, n_samples long, keyframes array<struct<start:long,length:long,time:long>>, payload binary, feature string"
_KEYS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("time", pa.int64())]))
_FIELDS = [("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", _KEYS)]
_KINDS = [("tracks", pa.list_(pa.struct(_FIELDS))), *_FIELDS, ("payload", pa.binary()), ("feature", pa.string())]
Batches = Iterator[pa.RecordBatch]


def muxed(batches: Batches, text: str) -> Batches:
    """Batches with n_bytes and media in place of the text."""
    for batch in batches:
        for part in pieces(batch, text):
            raw = [x or b"" for x in part.column(text).cast(pa.binary()).to_pylist()]
            rest = [c for c in part.schema.names if c != text]
            made = [pa.array(map(len, raw), pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *made], [*rest, "n_bytes", "media"])


def described(data: bytes | None) -> tuple:
    """The fields of INDEX for one file."""
    try:
        tracks = index(data)
        found = [{"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "n_samples": len(t["sizes"]), "keyframes": keyframes(t)} for t in tracks]
        first, body = found[0], payload(data, tracks[0])
    except (ValueError, KeyError, IndexError, TypeError, OverflowError, struct.error):
        return [], None, None, None, None, None, b"", "invalid"
    keys = first["keyframes"]
    seconds = first["duration"] / first["timescale"] if first["timescale"] else 0.0
    mean = sum(k["length"] for k in keys) / len(keys) if keys else 0.0
    feature = f"{first['codec'].strip()};{seconds:.6f}s;samples={first['n_samples']};keyframes={len(keys)};mean_key_bytes={mean:.2f}"
    return found, *first.values(), body, "fragmented;" * tracks[0]["fragmented"] + feature


def indexed(batches: Batches, media: str, keep: bool = False) -> Batches:
    """Batches with the columns of INDEX in place of the file, or beside it."""
    for batch in batches:
        for part in pieces(batch, media):
            found = [described(x) for x in part.column(media).to_pylist()]
            rest = [c for c in part.schema.names if keep or c != media]
            made = [pa.array([x[k] for x in found], kind) for k, (_, kind) in enumerate(_KINDS)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *made], [*rest, *(n for n, _ in _KINDS)])


def _free(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with n_bytes and the media file of each text."""
    rest = rest_of(docs, text, "n_bytes", "media")
    schema = docs.select(*rest).schema.add("n_bytes", "long").add("media", "binary")
    name = _free("_text", rest)
    return docs.select(*rest, docs[text].cast("string").alias(name)).mapInArrow(lambda b: muxed(b, name), schema)


def index_media(files: DataFrame, media: str = "media") -> DataFrame:
    """files with the columns of INDEX, read from the boxes of each file, in place of the files."""
    extra = T._parse_datatype_string(INDEX).fields
    rest = rest_of(files, media, *(f.name for f in extra))
    schema = T.StructType([*files.select(*rest).schema.fields, *extra])
    name = _free("_media", rest)
    return files.select(*rest, files[media].alias(name)).mapInArrow(lambda b: indexed(b, name), schema)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration long, keyframes array<struct<start:long,length:long,time:long>>, feature string"


def media_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """DIGESTS of each text's file: it is made, indexed and read back within one pass, so that files need not travel between Python and Spark."""

    def run(batches: Batches) -> Batches:
        for batch in indexed(muxed(batches, "_text"), "media", keep=True):
            read, stored = batch.column("payload").to_pylist(), batch.column("media").to_pylist()
            made = {
                "payload_bytes": pa.array(map(len, read), pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in read]),
                "tail_crc32": pa.array([zlib.crc32(x[-ALIGN:]) for x in read], pa.int64()),
                "media_bytes": pa.array(map(len, stored), pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in stored]),
            }
            names = [f.split()[0] for f in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names)

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("_text")).mapInArrow(run, DIGESTS)

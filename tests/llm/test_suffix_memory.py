"""Memory of the reads of hot anchors."""

import tracemalloc

import numpy as np
import pyarrow as pa

from loomtree.llm import suffix_dedup as s


def test_a_long_run_of_one_character_takes_bounded_memory():
    n = 400_000
    marks = np.zeros(n - s.SPAN, s.MARK)
    marks["at"], marks["back"], marks["hot"] = np.arange(len(marks)), 0, 1
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int8()), pa.array([1]), pa.array([2]), pa.array(["a" * n]), pa.array([marks.tobytes()], pa.binary())], ["_known", "_id", "_hash", "_text", "_marks"])
    tracemalloc.start()
    out = list(s.send_reads(iter([batch]), 8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    reads = [s.opened(x.as_buffer(), s.READ, np.dtype("<u4")) for b in out for x in b.column("block")]
    assert peak < 300 << 20
    # all windows are equal: one read is sent, as the earliest
    assert sum(len(r[1]) for r in reads) == 1 and reads[0][2][0] == 0


def test_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    text = ("".join(rng.choice(list("abcdef"), 600)) * 3).encode()
    marks = np.zeros(300, s.MARK)
    marks["at"], marks["back"], marks["ahead"], marks["hot"] = 60 + 4 * np.arange(300), 20, 5, np.arange(300) % 2
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int8()), pa.array([1]), pa.array([2]), pa.array([text.decode()]), pa.array([marks.tobytes()], pa.binary())], ["_known", "_id", "_hash", "_text", "_marks"])

    def reads():
        found = [s.opened(x.as_buffer(), s.READ, np.dtype("<u4")) for b in s.send_reads(iter([batch]), 8) for x in b.column("block")]
        return sorted((r.tobytes(), int(a)) for _, rs, at in found for r, a in zip(rs, at, strict=True))

    whole = reads()
    monkeypatch.setattr(s, "BLOCK", 64)
    assert reads() == whole and len(whole) > 300

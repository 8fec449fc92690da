import hashlib
import random
import re
import struct
from collections import defaultdict

import pytest
from helpers import WORD, docs, odd_rows, prose, repeat_words
from pyspark.sql import functions as F

from loomtree.llm import chat, media, mixing, quality_rules

EVENT = "conv_id long, seq long, message_id long, event string, role string, text string"


def folded(events):
    """Messages of one log, event by event."""
    order, texts, roles, gone = [], {}, {}, set()
    for _, seq, m, event, role, text in sorted(events, key=lambda e: e[1]):
        if m not in texts:
            order.append(m)
            texts[m], roles[m] = "", role
            roles[m] = role
        if event == "delta":
            texts[m] += text or ""
        elif event == "edit":
            texts[m] = text or ""
        else:
            texts[m] = ""
            gone |= set(order[order.index(m) + 1 :])
    return [(roles[m] or "", texts[m]) for m in order if m not in gone]


def test_folding_against_a_loop(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(30):
        seq = 0
        for m in range(rng.randrange(1, 8)):
            for _ in range(rng.randrange(1, 5)):
                rows.append((conv, seq, m, "delta", ["user", "assistant"][m % 2], f"d{seq} "))
                seq += 1
            while rng.random() < 0.4:
                rows.append((conv, seq, rng.randrange(m + 1), rng.choice(["edit", "regenerate", "delta"]), None, f"e{seq} "))
                seq += 1
    out = chat.render(chat.fold_events(spark.createDataFrame(rows, EVENT).repartition(3)))
    out = out.select("conv_id", chat.parsed(F.col("formatted")).alias("turns")).collect()
    per = defaultdict(list)
    for r in rows:
        per[r[0]].append(r)
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out} == {k: folded(v) for k, v in per.items()}


HARD = ["", None, "<|im_end|>", "<|im_end|><|im_start|>assistant ok", "\\", "\\<|", "<\\|im_start|>", "<|" * 3, "a\nb\n", "\\\\<\\|", "🙂é<", "|>", "<\\n>"]


def test_rendering_is_reversible(spark):
    rows = [(k, s, s, "delta", role, text) for k, role in enumerate(["user", "assistant", "odd\nrole<|", "\\"]) for s, text in enumerate(HARD)]
    out = chat.render(chat.fold_events(spark.createDataFrame(rows, EVENT)))
    for r in out.withColumn("turns", chat.parsed(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect():
        role = ["user", "assistant", "odd\nrole<|", "\\"][r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, t or "") for t in HARD]
        assert r["loss"] == ("".join(t or "" for t in HARD) if role == "assistant" else "")
        assert r["formatted"].count("<|im_start|>") == r["n_turns"] == len(HARD)


def test_null_events_and_empty_log(spark):
    rows = [(None, None, None, None, None, None), (1, 1, 1, "delta", None, None), (1, 1, 1, "delta", None, "b"), (1, 1, 1, "delta", None, "a")]
    out = {r["conv_id"]: r["formatted"] for r in chat.render(chat.fold_events(spark.createDataFrame(rows, EVENT))).collect()}
    assert out[1] == "<|im_start|>\nab<|im_end|>\n" and set(out) == {None, 1}
    assert chat.render(chat.fold_events(spark.createDataFrame([], EVENT))).count() == 0


def test_media_round_trip(spark):
    rows = odd_rows()
    out = media.index_media(media.to_media(docs(spark, rows))).collect()
    assert len(out) == len(rows)
    raw = sorted(media.padded((t or "").encode()) for _, t in rows)
    assert sorted(r["payload"] for r in out) == raw
    for r in out:
        assert r["codec"] == "raw " and r["duration"] == len(r["payload"]) == r["n_samples"] * 64
        assert len(r["keyframes"]) == -(-r["n_samples"] // 64)
        assert all(k["length"] == 64 for k in r["keyframes"])


def test_media_key_ranges_point_at_payload():
    body = bytes(range(256)) * 100
    data = media.mux(body)
    track = media.index(data)[0]
    for number, key in zip(track["sync"], media.keyframes(track), strict=True):
        assert data[key["start"] : key["start"] + key["length"]] == body[number * 64 : (number + 1) * 64] and key["time"] == number * 64
    kinds = [p[-1] for p, _, _ in media.boxes(memoryview(data))]
    assert kinds[:3] == [b"ftyp", b"moov", b"mvhd"] and kinds[-1] == b"mdat"


@pytest.mark.parametrize("cut", [0, 3, 40, 300, 600])
def test_broken_media(spark, cut):
    data = media.mux(bytes(6400))[:cut]
    row = media.index_media(spark.createDataFrame([(1, bytearray(data)), (2, None)], "doc_id long, media binary")).collect()
    assert [(r["feature"], r["payload"]) for r in row] == [("invalid", b"")] * 2


def test_malformed_media(spark):
    """Deep nesting, counts that the file can't hold, offsets beyond its end: no crash and no memory of the claimed size."""
    good = media.mux(bytes(6400))
    nested = b"".join(struct.pack(">I4s", 8 * (1500 - k), b"moov") for k in range(1500))
    broken = [nested, b"", b"no media at all"]
    for kind, at in ((b"stsz", 12), (b"stsz", 8), (b"stco", 8), (b"stco", 12), (b"stts", 8), (b"stts", 12), (b"stsc", 8), (b"stsc", 16), (b"stss", 8), (b"stss", 12)):
        place = good.index(kind) - 4 + at + 4 - 4 * (kind == b"stsz" and at == 12) + 4 * (kind == b"stsz")
        broken.append(good[:place] + b"\xff\xff\xff\x7f" + good[place + 4 :])
    rows = [(k, bytearray(x)) for k, x in enumerate(broken)]
    out = media.index_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert {r["feature"] for r in out} == {"invalid"} and {r["payload"] for r in out} == {b""}
    rng = random.Random(7)
    for _ in range(3000):
        data = bytearray(good)
        for _ in range(rng.randrange(1, 4)):
            data[rng.randrange(700)] = rng.randrange(256)
        assert len(media.described(bytes(data))[6]) <= len(data)


def test_all_tracks_and_fragments(spark):
    """A file of two tracks gives both; moof boxes are named."""
    body = bytes(range(64)) * 70
    data = media.mux(body)
    at = data.index(b"moov") - 4
    size = int.from_bytes(data[at : at + 4], "big")
    trak = data.index(b"trak") - 4
    second = data[trak : at + size]
    two = data[:at] + struct.pack(">I", size + len(second)) + data[at + 4 : at + size] + second + data[at + size :]
    moved = media.index(data)[0]["chunks"]
    for old in sorted(set(moved.tolist()), reverse=True):  # chunk offsets move by the second track
        two = two.replace(struct.pack(">I", old), struct.pack(">I", old + len(second)))
    rows = [(1, bytearray(two)), (2, bytearray(data + struct.pack(">I4s", 8, b"moof")))]
    out = {r["doc_id"]: r for r in media.index_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert [t["n_samples"] for t in out[1]["tracks"]] == [70, 70] and out[1]["payload"] == body
    assert out[2]["feature"].startswith("fragmented;raw") and out[2]["payload"] == body


def targets(sizes):
    """By hand: share 150 percent by weight, cap at twice the size, share the excess again."""
    keys = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(keys)}
    left, open_, out = 1.5 * sum(sizes.values()), set(keys), {}
    while open_:
        rate = left / sum(weight[k] for k in open_)
        above = {k for k in open_ if rate * weight[k] > 2 * sizes[k]}
        for k in above or open_:
            out[k] = 2.0 * sizes[k] if above else rate * weight[k]
        if not above:
            break
        left -= sum(out[k] for k in above)
        open_ -= above
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = []
    for s, n in (("a", 400), ("b", 30), (None, 20), ("", 5), ("é", 100), ("Z", 1)):
        rows += [(len(rows) + k, None if rng.random() < 0.03 else prose(rng, rng.choice([1, 20, 20, 80])), "en", s, 1) for k in range(n)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix_sources(df).collect()
    assert len(out) == len(rows)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(df.repartition(7)).collect()))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in out:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    want = targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * largest[s]


def rule_base(text):
    text = text or ""
    words, lines = WORD.findall(text), text.split("\n")
    worded = [x for x in lines if WORD.search(x)]
    repeat = repeat_words(text)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(worded) - len(set(worded)), repeat, len(words) < 20 or 100 * repeat > 30 * len(words)


def test_rules_against_loops(spark):
    rng = random.Random(5)
    rows = odd_rows() + [(50 + k, t) for k, t in enumerate(["a b c d e f g h " * 5, "a b c d e f g h i j k " * 4, "same line here\n" * 9, "x\n\ny\n \nx\n", "# * $ % & | < >", "one two three four five six seven " * 2, "\v\f\r mixed \x1c words   here  ok"])]
    for k in range(40):
        block = prose(rng, rng.randrange(8, 30))
        rows.append((200 + k, prose(rng, rng.randrange(1, 60)) + " " + " ".join([block] * rng.randrange(1, 4)) + "\n" + prose(rng, 5)))
    out = quality_rules.quality_rules(docs(spark, rows)).collect()
    found = sorted(str((r["doc_id"], r["text"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in out)
    assert found == sorted(str((i, t, *rule_base(t))) for i, t in rows)
    assert not any(r["kept"] for r in out if r["base_failed"])


def test_lines_that_fail(spark):
    good = "This line says something whole about rivers and stones in the old city. It ends well."
    lines = {
        good: False,
        "Home | About us | Contact": True,
        "Copyright 2024 Example. All rights reserved.": True,
        "Click here to read more": True,
        "### ***": True,
        "We walked home. It was late.": False,
        "She went home early.": False,
        "We ordered from the menu.": False,
        "The baker sold a fresh cookie to the child.": False,
        "Our grandmother hid the cookie jar on the top shelf.": False,
        "and we walked all the way home through the": False,
        "The senate debated the new privacy policy for two days.": False,
        "Home About Contact Search Log in and Register here": True,
        "By using this website you agree to our terms of service.": True,
        "Privacy policy for all of the readers here": True,
        "版权所有 2024 示例公司。": True,
        "Все права защищены. Пример, 2024.": True,
        "جميع الحقوق محفوظة. مثال 2024.": True,
        "他说今天天气很好。": False,
        "This page uses a cookie to remember what you chose to see.": True,
        "": False,
        "   ": False,
    }
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    found = {r["x"]: r["f"] for r in df.select("x", quality_rules.line_fails(F.col("x")).alias("f")).collect()}
    assert {x: found[x] for x in lines if x.strip()} == {x: v for x, v in lines.items() if x.strip()}
    rng = random.Random(3)
    sentences = [" ".join(f"word{rng.randrange(10**6)}" for _ in range(9)) + "." for _ in range(6)]
    text = "\n".join(["Home | About us | Contact", *sentences, "Copyright 2024 Example. All rights reserved.", ""])
    row = quality_rules.quality_rules(docs(spark, [(1, text)])).first()
    assert row["kept"] and row["clean_text"] == "\n".join([*sentences, ""])
    assert row["lost_chars"] == len("Home | About us | Contact") + len("Copyright 2024 Example. All rights reserved.")
    bad = "\n".join([*sentences, *["Click here to see what is new today on this page"] * 20])
    assert not quality_rules.quality_rules(docs(spark, [(1, bad)]), max_lost_percent=30).first()["kept"]


def test_digest_of_stored_form_is_stable(spark):
    a, b = (media.to_media(docs(spark, [(1, "same text")])).first()["media"] for _ in range(2))
    assert hashlib.sha256(a).digest() == hashlib.sha256(b).digest()

import random

import numpy as np
from helpers import classes, docs, prose, word_similarity

from loomtree.llm.minhash import SIMILARITY, aligned, near_duplicates


def brute(rows):
    """doc_id of the least member of each class, from all pairs."""
    links = [(i, j) for i in range(len(rows)) for j in range(i) if word_similarity(rows[i][1] or "", rows[j][1] or "") >= SIMILARITY]
    return {rows[k][0]: rows[c][0] for k, c in enumerate(classes(len(rows), links))}


def found(spark, rows):
    return {r["doc_id"]: r["class_id"] for r in near_duplicates(docs(spark, rows)).collect()}


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], ["changed"], [words[k], "more"]])
    return " ".join(words)


def test_against_all_pairs(spark):
    rng = random.Random(4)
    rows, k = [], 0
    for _ in range(12):
        base = prose(rng, rng.randrange(6, 150))
        for n in (0, 0, 1, 2, 4, 9):
            rows.append((k, edited(rng, base, n)))
            k += 1
    rows += [(900, ""), (901, None), (902, " \n "), (903, "one two"), (904, "one  two"), (905, "one three")]
    assert found(spark, rows) == brute(rows)


def test_moved_parts_are_not_near(spark):
    rng = random.Random(8)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, f"{a} {b} {c}"), (2, f"{c} {b} {a}"), (3, f"{a} {b} {c} end")]
    assert found(spark, rows) == {1: 1, 2: 2, 3: 1}


def test_chain_and_a_star_whose_arms_are_not_alike(spark):
    """Copies that are each near their original and not near each other are one class through it."""
    rng = random.Random(9)
    base = prose(rng, 300)
    rows = [(0, base)]
    for k in range(1, 60):
        words = base.split(" ")
        for at in rng.sample(range(len(words) - 5), 18):
            words[at + 5] = f"arm{k}at{at}"
        rows.append((k, " ".join(words)))
    assert word_similarity(rows[1][1], rows[0][1]) >= SIMILARITY > word_similarity(rows[1][1], rows[2][1])
    assert set(found(spark, rows).values()) == {0}


def test_alignment_is_exact():
    rng = random.Random(10)
    near = 0
    for _ in range(600):
        base = [rng.randrange(rng.choice([3, 40, 4000])) for _ in range(rng.randrange(1, rng.choice([12, 60, 700])))]
        other = [x if rng.random() > 0.05 else rng.randrange(40) for x in base if rng.random() > rng.choice([0.02, 0.1])]
        if rng.random() < 0.2:
            other = other[len(other) // 2 :] + other[: len(other) // 2]
        real = word_similarity(*(" ".join(f"w{x}" for x in t) for t in (base, other)))
        got = aligned(np.array(base, np.uint64), np.array(other, np.uint64))
        assert abs(got - (real if real >= SIMILARITY else 0)) < 1e-12
        near += got > 0
    assert 100 < near < 550


def changed_words(rng, text, share):
    """This share of the words replaced, dropped or doubled, each at its place."""
    out = []
    for w in text.split(" "):
        out += rng.choice([[f"new{rng.randrange(10**6)}"], [f"new{rng.randrange(10**6)}"], [], [w, f"more{rng.randrange(10**6)}"]]) if rng.random() < share else [w]
    return " ".join(out)


def test_recall_of_edited_copies(spark):
    """Copies with up to a tenth of their words edited, of 20 to 6,000 words, against all pairs: at least 0.97 of the near ones are found."""
    rng = random.Random(14)
    rows, want = [], []
    for k in range(240):
        base = prose(rng, rng.choice([20, 60, 300, 300, 1500]) if k % 40 else 6000)
        copy = changed_words(rng, base, rng.choice([0.01, 0.03, 0.05, 0.08, 0.1]))
        rows += [(2 * k, base), (2 * k + 1, copy)]
        if word_similarity(base, copy) >= SIMILARITY:
            want.append(k)
    got = found(spark, rows)
    assert all(got[2 * k] == 2 * k and got[2 * k + 1] in (2 * k, 2 * k + 1) for k in range(240))
    assert len(want) > 150 and sum(got[2 * k + 1] == 2 * k for k in want) >= 0.97 * len(want)
    assert all(got[2 * k + 1] == 2 * k + 1 for k in set(range(240)) - set(want))


def test_hot_keys_are_split_and_lose_nothing(spark, monkeypatch):
    """All parts and blocks of size 2: same classes."""
    from loomtree.llm import minhash

    rng = random.Random(15)
    passage = prose(rng, 60)
    rows = [(k, passage + " " + prose(rng, 40)) for k in range(30)] + [(100 + k, edited(rng, passage, 2)) for k in range(12)] + [(200 + k, passage) for k in range(9)]
    whole = found(spark, rows)
    monkeypatch.setattr(minhash, "BLOCK", 2)
    split = minhash.salted_join
    monkeypatch.setattr(minhash, "salted_join", lambda *a, **k: split(*a, **(k | {"most": 2})))
    assert found(spark, rows) == whole == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    text = prose(random.Random(2), 30)
    out = near_duplicates(docs(spark, [(None, text), (None, text), (3, text), (4, "alone here")])).collect()
    assert sorted((str(r["doc_id"]), r["class_id"], r["class_size"]) for r in out) == [("3", 3, 3), ("4", 4, 1), ("None", 3, 3), ("None", 3, 3)]


def test_f3_f4_one_common_table_is_enough(spark, monkeypatch):
    """Two near texts that share single tables, whose heads are another text that is near neither."""
    from pyspark.sql import functions as F

    from loomtree.llm import minhash

    rng = random.Random(16)
    base = prose(rng, 80)
    rows = [(1, base), (2, edited(rng, base, 2)), (3, prose(rng, 80)), (4, prose(rng, 80))]
    tables = {1: (100, 11, 102, 13), 2: (100, 21, 102, 23), 3: (100, 31, 102, 33), 4: (41, 31, 43, 33)}
    made = F.create_map(*[x for k, t in tables.items() for x in (F.lit(k).cast("long"), F.array(*[F.lit(v).cast("long") for v in t]))])
    whole = minhash.sketched
    monkeypatch.setattr(minhash, "sketched", lambda *a: whole(*a).withColumn("sketch", F.element_at(made, F.col("doc_id"))))
    assert found(spark, rows) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_second_meetings_leave_out_texts_that_are_nearly_near(spark):
    """Three of four words in common pass the sketches, and no near pair fails the words."""
    from pyspark.sql import functions as F

    from loomtree.llm.minhash import WORDS, counted, digested, may_be_alike, share_words, sketched

    rng = random.Random(31)
    texts, pairs = [], []
    for k in range(120):
        base = [f"w{k}_{i % 140}" for i in range(150)]
        edits = rng.sample(range(150), (21, 8, 16)[k % 3])
        other = [f"x{k}_{i}" if i in edits else w for i, w in enumerate(base)]
        pairs.append((base, other))
        texts += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    df = docs(spark, texts)
    planes = [F.get("bins", F.lit(j + WORDS * (p == "v"))).alias(f"{p}{j}") for p in "mv" for j in range(WORDS)]
    rows = sketched(df).select("doc_id", "node", "n", *planes).withColumn("filled", sum((F.bit_count(f"m{j}") for j in range(1, WORDS)), F.bit_count("m0")))
    rows = rows.join(counted(digested(df.select("text"))), "node")
    side = F.struct("words", "n", "filled", *[f"{p}{j}" for p in "mv" for j in range(WORDS)])
    met = rows.groupBy(F.expr("doc_id div 2").alias("k")).agg(F.min(F.struct("doc_id", side.alias("s")))["s"].alias("x"), F.max(F.struct("doc_id", side.alias("s")))["s"].alias("y"))
    passed = {r["k"]: (r["sketches"], r["words"]) for r in met.select("k", may_be_alike("x", "y").alias("sketches"), share_words("x", "y").alias("words")).collect()}
    near = [aligned(*(np.array([hash(w) & (1 << 62) - 1 for w in p], np.uint64) for p in pair)) > 0 for pair in pairs]
    far = [k for k, is_near in enumerate(near) if not is_near]
    assert len(far) == 40 and sum(passed[k][0] for k in far) > 20
    assert not any(passed[k][1] for k in far)
    assert all(passed[k] == (True, True) for k, is_near in enumerate(near) if is_near)
    long = docs(spark, [(1, " ".join(f"v{i}" for i in range(2000)))])
    assert counted(digested(long.select("text"))).first()["words"] is None


def test_comparisons_are_compiled_and_shuffles_go(spark, monkeypatch):
    """The JVM compiles no method of over 8,000 bytes; the shuffle files of written tables go with their queries."""
    import re
    import time

    from loomtree.llm import common, minhash

    sizes = {}

    def seen(df, name):
        if name in ("pairs", "again"):
            before = spark.conf.get("spark.sql.adaptive.enabled")
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "codegen")
            spark.conf.set("spark.sql.adaptive.enabled", before)
            sizes[name] = max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text)))
        assert spark.conf.get(common.CLEANUP, None) is None
        return common.written(df, name)

    monkeypatch.setattr(minhash, "written", seen)
    rows = [(k, " ".join(f"w{k // 2}x{i}" for i in range(30))) for k in range(6)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {k: k // 2 * 2 for k in range(6)}
    assert set(sizes) == {"pairs", "again"} and max(sizes.values()) < 8000

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        return sum("shuffle_" in str(files.apply(k)) for k in range(files.size()))

    had = shuffled()
    common.written(spark.range(1000).repartition(7, "id"), "gone")
    until = time.time() + 10
    while shuffled() > had and time.time() < until:
        time.sleep(0.1)
    assert shuffled() <= had

"""Near duplicates by order MinHash, verified by banded alignment.

The similarity of two texts is that of their sequences of words under edits: M / (n1 + n2 - M), with M the number of words that an
alignment matches in order (their longest common subsequence). Texts are near from 0.8, which is one word in nine replaced, or one in
five inserted. Five-word shingles lose five elements for each replaced word; texts whose five-word shingles agree to 0.8 are near here too, but
for moved parts. 1 - similarity is a metric (the Steinhaus transform of the edit distance of insertions and deletions).

Candidates: a text has k-mers, strings of neighbouring words, each labelled by how often it has occurred before, so that all elements
differ. An order MinHash takes, for each of TABLES hash functions, a few elements of least hash and keeps them in text order; two
texts share a bucket if such a sequence agrees, which needs common elements in a common order. K-mers have five words; those of texts of up to 100 words
have three and those of up to 12 words one (KINDS), so that an edit of a short text can't touch all its tables; kinds overlap in size, so that any two near
texts have tables of one kind.

Alignment: a similarity of 0.8 bounds the unmatched words, and so how far matched places can lie apart. Within that band the
common subsequence is computed by bits, a machine word of columns at a time; texts of any length are aligned whole.

Not all pairs are made within a bucket. Texts of equal words are one text first. Each member of a bucket meets the bucket's
head, the member that shares its buckets with most others (an original rather than one of its copies, which are farther from
each other than from it); this grows with the number of members, and in a bucket of two the pair itself is looked at. Members that are not in the class of a head
meet all others of the bucket, wherever their classes differ, in blocks of at most BLOCK of them, so that no task holds a bucket's pairs.
Whoever meets is aligned only if the bin sketches of their labelled words (a bit of the least hash in each of BINS bins of hashes) agree as those of near
texts do, but for five standard deviations: near texts have at least 0.8 of their words in common, in whatever order, so that texts that share a passage
or a line, and copies that are too far from each other, fall out within the join. Sketches leave in copies that are nearly near, and there may be very many; so where
all others of a bucket are met, texts of up to COUNTED words are compared by all their words (share_words), which no near pair fails.

Keys with many rows (a text with many copies, a head or root of a large class) are salted in joins, and copies are dropped in tasks before
their texts are shuffled.

Defined results: null, empty and blank texts have the same (no) words and are one class; a class has the least doc_id of its members
(nulls last); a null doc_id is a document like others; repeated rows stay, in one class; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtree.llm.common import dropped, flat_bytes, mixed, pieces, salted_join, word_hashes, written
from loomtree.llm.components import components

SIMILARITY = 0.8
TABLES = 40
#: (from so many words, up to so many, words of a k-mer, elements that a table takes)
KINDS = ((0, 12, 1, 4), (9, 100, 3, 3), (75, 1 << 62, 5, 3))
BLOCK = 1024
BINS = 1024
COUNTED = 1024
WORDS = BINS // 64


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word strings of a text, labelled by occurrence."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        n = max(1, len(words) - k + 1)
        out = np.zeros(n, np.uint64)
        for i in range(min(k, len(words))):
            out = out * np.uint64(0x100000001B3) + words[i : i + n]
    out = mixed(out, 7)
    order = np.argsort(out, kind="stable")
    ordered = out[order]
    again = ordered[1:] == ordered[:-1]
    if again.any():
        first = np.concatenate([[0], np.where(again, 0, np.arange(1, len(out)))])
        label = np.arange(len(out)) - np.maximum.accumulate(first)
        out = out.copy()
        out[order] = np.where(label > 0, mixed(ordered ^ mixed(label.astype(np.uint64), 8), 9), ordered)
    return out


_MULTIPLIERS = mixed(np.arange(TABLES, dtype=np.uint64), 11) | np.uint64(1)
_PLACES = mixed(np.arange(max(k[3] for k in KINDS), dtype=np.uint64), 12) | np.uint64(1)


def _tables(elements: np.ndarray, length: int, kind: int) -> np.ndarray:
    n, out = len(elements), np.zeros(TABLES, np.uint64)
    step = max(1, (1 << 20) // max(n, 1))
    with np.errstate(over="ignore"):
        for k in range(0, TABLES, step):
            if n > length:
                values = elements[None, :] * _MULTIPLIERS[k : k + step, None]
                at = np.sort(np.argpartition(values, length - 1, axis=1)[:, :length], axis=1)
            else:
                at = np.tile(np.arange(n), (min(step, TABLES - k), 1))
            out[k : k + step] = mixed((elements[at] * _PLACES[: at.shape[1]]).sum(axis=1), 13)
        return mixed(out ^ _MULTIPLIERS, kind)


def sketch(words: np.ndarray) -> np.ndarray:
    """For each table, one hash of its elements of least hash in text order (all elements of a shorter text)."""
    return np.concatenate([_tables(kmers(words, k), length, k) for low, high, k, length in KINDS if low <= len(words) <= high])


def bins(elements: np.ndarray) -> np.ndarray:
    """Two bits for each of BINS bins of hashes, as 64-bit words: whether an element is in it, and the last bit of the least hash there."""
    ordered = np.sort(mixed(elements, 15))
    of = (ordered >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
    bits = np.zeros((2, BINS), np.uint8)
    bits[0, of[first]] = 1
    bits[1, of[first]] = ordered[first] & np.uint64(1)
    return np.packbits(bits, axis=1).view(np.int64).ravel()


PLANES = [f"{p}{k}" for p in "mv" for k in range(WORDS)]


def side(*more: Column) -> Column:
    """What may_be_alike() reads, and more columns, as one struct. Its fields are never null: the checks for nulls would double the code of the comparisons, which the JVM compiles up to 8,000 bytes a method only."""
    return F.struct(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "filled", *PLANES)], *more)


def may_be_alike(a: str, b: str) -> Column:
    """Whether two rows' n and bins are as those of near texts, but for five standard deviations.

    Of the bins that either fills, the least word is common to both in the share SIMILARITY or more; of the other bins that both fill, half
    agree by chance. So agreeing bins number (SIMILARITY * either + both) / 2, which is what the last line says with both counted once.
    Bins are a sample of the words without replacement, which lessens the deviation for short texts.
    """

    def bits(of: Callable[[int], Column]) -> Column:
        out = F.bit_count(of(0))
        for k in range(1, WORDS):
            out = out + F.bit_count(of(k))
        return out

    def filled(k: int) -> Column:
        return F.col(f"{a}.m{k}").bitwiseAND(F.col(f"{b}.m{k}"))

    def differ(k: int) -> Column:
        return F.col(f"{a}.v{k}").bitwiseXOR(F.col(f"{b}.v{k}")).bitwiseAND(filled(k))

    each = F.col(f"{a}.filled") + F.col(f"{b}.filled")
    either = F.least(each * (1 / (1 + SIMILARITY)), F.lit(float(BINS)))
    union = (F.col(f"{a}.n") + F.col(f"{b}.n")) * (1 / (1 + SIMILARITY))
    sampled = either * (SIMILARITY * (1 - SIMILARITY)) * F.greatest(1 - either / union, F.lit(0.0))
    chance = F.greatest(each - either * (1 + SIMILARITY), F.lit(0.0))
    spread = F.sqrt((sampled + chance) * 0.25)
    sizes = F.least(f"{a}.n", f"{b}.n") >= F.greatest(f"{a}.n", f"{b}.n") * SIMILARITY
    return sizes & (bits(filled) * ((1 + SIMILARITY) / 2) - bits(differ) >= each * (SIMILARITY / 2) - 5 * spread - 1)


def counted(texts: DataFrame) -> DataFrame:
    """(node, words): the labelled words of texts (node, text) as sorted 32-bit hashes, NULL for a text of more than COUNTED words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words, rows, _, _ = word_hashes(*flat_bytes(part.column("text")))
                found = [None if b - a > COUNTED else np.unique((kmers(words[a:b], 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)) for a, b in zip(rows[:-1], rows[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node").cast(pa.binary()), pa.array(found, pa.list_(pa.int32()))], ["node", "words"])

    return texts.select("node", "text").mapInArrow(run, "node binary, words array<int>")


def share_words(a: str, b: str) -> Column:
    """Whether two rows' words have as many in common as an alignment of near texts matches; true where either is not counted.

    Words of equal 32-bit hashes count once, so both the bound and the words in common lessen by as many.
    """
    x, y = F.col(f"{a}.words"), F.col(f"{b}.words")
    merged = F.col(f"{a}.n") - F.size(x) + F.col(f"{b}.n") - F.size(y)
    need = (F.col(f"{a}.n") + F.col(f"{b}.n")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6
    return F.coalesce(F.size(F.array_intersect(x, y)) + merged >= need, F.lit(True))


def banded_matches(a: list[int], b: list[int], behind: int, ahead: int) -> int:
    """The longest common subsequence of two sequences in a band: place i of a meets j of b if j - ahead <= i <= j + behind.

    Bit i of an integer says that the row of the alignment table does not rise at i; a row follows from the one before by a sum. Rows go in
    blocks, each over the columns of its band only; what lies before them stays as it is.
    """
    n, m = len(a), len(b)
    state, step = (1 << n) - 1, max(256, behind + ahead)
    for start in range(0, m, step):
        stop = min(start + step, m)
        low, high = max(0, start - ahead), min(n, stop + behind)
        if low >= high:
            break
        full = (1 << (high - low)) - 1
        at: dict[int, int] = {}
        for i, x in enumerate(a[low:high]):
            at[x] = at.get(x, 0) | 1 << i
        row = (state >> low) & full
        for x in b[start:stop]:
            if x in at:
                hit = row & at[x]
                row = ((row + hit) | (row - hit)) & full
        state = (state & ~(full << low)) | row << low
    return n - state.bit_count()


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sequences of word hashes; 0 where it is below SIMILARITY."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    total = len(a) + len(b)
    need = int(np.ceil(total * SIMILARITY / (1 + SIMILARITY) - 1e-9))
    if min(len(a), len(b)) < need:
        return 0.0
    _, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ids[: len(a)], ids[len(a) :]
    if np.minimum(np.bincount(x, minlength=ids.max() + 1), np.bincount(y, minlength=ids.max() + 1)).sum() < need:
        return 0.0
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    first = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(x[::-1][: n - first] != y[::-1][: n - first])
    last = int(differ[0]) if len(differ) else n - first
    inner = banded_matches(x[first : len(x) - last].tolist(), y[first : len(y) - last].tolist(), len(a) - need, len(b) - need)
    m = first + last + inner
    return m / (total - m) if m >= need else 0.0


def _digest(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def sketched(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, turn, node, n, sketch, bins): turn numbers a task's rows, node is a 128-bit digest of the words, n the number of words; a task sketches each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        turn = 0
        for batch in batches:
            for part in pieces(batch, "text"):
                words, rows, _, _ = word_hashes(*flat_bytes(part.column("text")))
                nodes, counts, tables, bits = [], [], [], []
                for a, b in zip(rows[:-1], rows[1:], strict=True):
                    node = _digest(words[a:b])
                    nodes.append(node)
                    if node in seen:
                        for column in (counts, tables, bits):
                            column.append(None)
                        continue
                    seen.add(node)
                    counts.append(b - a)
                    tables.append(sketch(words[a:b]).view(np.int64) if b > a else np.zeros(0, np.int64))
                    bits.append(bins(kmers(words[a:b], 1)))
                arrays = [part.column("doc_id"), pa.array(np.arange(turn, turn + len(nodes))), pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (tables, bits))]
                turn += len(nodes)
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "turn", "node", "n", "sketch", "bins"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, turn long, node binary, n long, sketch array<long>, bins array<long>")


def digested(docs: DataFrame, text: str = "text", once: bool = False) -> DataFrame:
    """docs with node, the digest of the words that sketched() gives too; once: a task gives only the first row of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in pieces(batch, text):
                words, at, _, _ = word_hashes(*flat_bytes(part.column(text)))
                nodes = [_digest(words[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                out = pa.RecordBatch.from_arrays([*part.columns, pa.array(nodes, pa.binary())], [*part.schema.names, "node"])
                if once:
                    fresh = []
                    for node in nodes:
                        fresh.append(node not in seen)
                        seen.add(node)
                    out = out.filter(pa.array(fresh, pa.bool_()))
                yield out

    return docs.mapInArrow(run, docs.select("*").schema.add("node", "binary"))


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose texts are near; texts has (node, text). Many a may have one b."""
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = salted_join(pairs.join(left, "a"), right, "b", pairs.groupBy("b").agg(F.count("*").alias("n")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text_a"):
                words_a, rows_a, _, _ = word_hashes(*flat_bytes(part.column("text_a")))
                words_b, rows_b, _, _ = word_hashes(*flat_bytes(part.column("text_b")))
                near = [aligned(words_a[rows_a[k] : rows_a[k + 1]], words_b[rows_b[k] : rows_b[k + 1]]) > 0 for k in range(part.num_rows)]
                yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def near_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, node (the digest of its words), root (a node of its class, the same for the whole class)."""
    spark = docs.sparkSession
    rows = written(sketched(docs, text, doc_id), "sketches")
    distinct = rows.groupBy("node").agg(F.count("*").alias("copies"), *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "sketch", "bins")])
    distinct = written(distinct, "distinct")
    entries = distinct.select(F.explode("sketch").alias("bucket"), "node")
    shared = entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    entries = written(entries.join(shared, "bucket"), "entries")
    met = entries.groupBy("node").agg(F.sum("members").alias("met"))
    entries = written(entries.select("bucket", "node").join(met, "node"), "met")
    heads = entries.groupBy("bucket").agg(F.max(F.struct("met", "node"))["node"].alias("head"))
    buckets = written(entries.join(heads, "bucket"), "buckets")
    planes = [F.get("bins", F.lit(k + WORDS * (p == "v"))).alias(f"{p}{k}") for p in "mv" for k in range(WORDS)]
    known = distinct.join(entries.select("node"), "node", "left_semi").select("node", "n", F.col("sketch").alias("tables"), *planes)
    known = known.withColumn("filled", sum((F.bit_count(f"m{k}") for k in range(1, WORDS)), F.bit_count("m0")))
    known = written(known, "known")

    texts = digested(docs.select(docs[text].cast("string").alias("text")), once=True)
    texts = written(texts.join(known, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "texts")
    ours, others = known.select(F.col("node").alias("a"), side().alias("x")), known.select(F.col("node").alias("b"), side().alias("y"))

    def linked_to_heads(meetings: DataFrame) -> DataFrame:
        """The links of those (a, b) that are near; b is a head, and may have very many a."""
        meetings = written(meetings.distinct(), "meetings")
        both = salted_join(meetings.join(ours, "a"), others, "b", meetings.groupBy("b").agg(F.count("*").alias("n")), "a")
        pairs = written(both.where(may_be_alike("x", "y")).select("a", "b"), "pairs")
        out = written(linked(pairs, texts), "links")
        for table in (meetings, pairs):
            dropped(spark, table)
        return out

    of_head = buckets.groupBy("head").agg(F.count("*").alias("n"))

    links = linked_to_heads(buckets.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")))
    classes = written(components(links), "classes")

    # nodes that are not in the class of a bucket's head, against all others of their buckets
    found = buckets.join(classes, "node", "left").select("node", "head", F.coalesce("root", "node").alias("root"))
    head_class = classes.select(F.col("node").alias("head"), F.col("root").alias("head_root"))
    found = salted_join(found, head_class, "head", of_head, "node", "left").where(F.col("root") != F.coalesce("head_root", "head"))
    apart = found.select("node", F.lit(True).alias("apart")).distinct()
    member = known.select("node", F.array_distinct("tables").alias("tables")).join(classes, "node", "left").join(apart, "node", "left")
    member = written(member.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("apart", F.lit(False)).alias("apart"), "tables"), "members")
    thin = member.select("node", "root", "apart", F.explode("tables").alias("bucket"))
    live = thin.groupBy("bucket").agg(F.count_if("apart").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("n > 0 and least <> most")
    thin = written(thin.join(live.select("bucket", "n"), "bucket"), "met")
    open_ = thin.groupBy("node").agg(F.collect_list("bucket").alias("open"))
    words = written(counted(texts.join(open_.select("node"), "node", "left_semi")), "words")
    wide = written(open_.join(known, "node").join(words, "node").select("node", "open", "words", "n", "filled", *PLANES), "wide")
    # no columns that may be null here either; with sizes as may_be_alike() asks, share_words() lets a text without counted words through
    some = {"open": F.coalesce("open", F.array().cast("array<long>")), "words": F.coalesce("words", F.array().cast("array<int>")).alias("words"), "root": F.coalesce("root", F.lit(b""))}
    of_a, of_b = ([F.col("node").alias(k), some["open"].alias(f"open_{k}"), side(some["words"]).alias(v)] for k, v in (("a", "x"), ("b", "y")))
    x = thin.where("apart").select("bucket", F.col("node").alias("a"), some["root"].alias("root_a")).join(wide.select(*of_a), "a")
    y = thin.select("bucket", F.col("node").alias("b"), some["root"].alias("root_b"), F.coalesce("apart", F.lit(False)).alias("apart_b")).join(wide.select(*of_b), "b")
    # a pair meets once: in one direction, and in the least of its buckets
    once = (~F.col("apart_b") | (F.col("a") < F.col("b"))) & (F.array_min(F.array_intersect("open_a", "open_b")) == F.col("bucket"))
    again = salted_join(x, y, "bucket", live.select("bucket", "n"), "a", most=BLOCK).where((F.col("root_a") != F.col("root_b")) & may_be_alike("x", "y") & once & share_words("x", "y"))
    again = written(again.select("a", "b"), "again")
    final = components(links.unionByName(linked(again, texts)))
    for table in (entries, buckets, known, texts, links, classes, member, thin, words, wide, again):
        dropped(spark, table)

    of_node = salted_join(rows.select("doc_id", "node", "turn"), final, "node", distinct.select("node", F.col("copies").alias("n")), "turn", "left")
    return of_node.select("doc_id", "node", F.coalesce("root", "node").alias("root"), "turn")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, class_id (least doc_id of its class), class_size (documents in it)."""
    member = near_classes(docs, text, doc_id).select("doc_id", "root", "turn")
    of_class = member.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    sizes = of_class.select("root", F.col("class_size").alias("n"))
    return salted_join(member, of_class, "root", sizes, "turn").select("doc_id", "class_id", "class_size")

"""Small tables and plain Python versions that the operators are held against."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = "the of and a river stone house walks over under bright small green old city makes water light brings seven cold morning road field every song".split()


def docs(spark: SparkSession, rows: list[tuple[int | None, str | None]], source: str | None = "web") -> DataFrame:
    return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in rows], DOCUMENT)


def prose(rng: random.Random, n: int) -> str:
    """n words, a full stop and now and then a new line after some of them."""
    out = []
    for k in range(n):
        out.append(rng.choice(VOCABULARY) + str(rng.randrange(60)))
        if k % 13 == 12:
            out[-1] += "." + ("\n" if rng.random() < 0.3 else "")
    return " ".join(out).replace("\n ", "\n")


def odd_rows() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, ties, repeated rows, control strings, many bytes a character and a long text."""
    long = prose(random.Random(1), 4000)
    same = prose(random.Random(2), 40)
    return [(None, None), (None, same), (1, None), (2, ""), (3, " \n\t "), (4, same), (4, same), (5, same), (5, "another text"), (6, "x"), (7, "é漢字🙂 " * 60), (8, long), (9, long + " end"), (10, "\x00\x1f<|endoftext|> <|im_end|>"), (11, "a" * 500)]


def repeat_words(text: str, window: int = 8) -> int:
    words = WORD.findall(text)
    found = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    often = Counter(found)
    return len({i + j for i, w in enumerate(found) if often[w] > 1 for j in range(window)})


def removed(texts: list[bytes], span: int = 100) -> list[list[bool]]:
    """Bytes under a span-byte string that starts earlier too, texts in order."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - span + 1):
            s = t[i : i + span]
            if s in seen:
                gone[i : i + span] = [True] * span
            seen.add(s)
        out.append(gone)
    return out


def runs(gone: list[bool]) -> int:
    return sum(x and not (k and gone[k - 1]) for k, x in enumerate(gone))


def word_similarity(a: str, b: str) -> float:
    """Words matched in order by the best alignment, over all words of either; the whole table, row by row."""
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in WORD.findall(t)], int) for t in (a, b))
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    row = np.zeros(len(y) + 1, int)
    for u in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == u)))
    return row[-1] / (len(x) + len(y) - row[-1])


def classes(n: int, links: list[tuple[int, int]]) -> list[int]:
    """The least member of each one's component."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]

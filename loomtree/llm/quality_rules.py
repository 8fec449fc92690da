"""Quality rules, line first: lines that fail a punctuation, navigation or boilerplate rule go; a document that loses too much goes with them.

Everything is a DataFrame expression over one row: no shuffle, no Python. A single word never condemns a line: navigation and boilerplate need
a phrase that prose does not have, or two signs at once. Phrases are English, with some Spanish, French, German, Chinese, Arabic and Russian ones.

Defined results: a null or empty text has no words and is rejected (too short); a line without words neither fails nor
counts; repeated rows are judged alike; other columns pass through, but for names that the operator writes itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtree.llm.common import SPACE, rest_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: A line fails the punctuation rule if it is short and no sentence ends in it, or if symbols make up much of it.
FRAGMENT_WORDS = 6
MAX_SYMBOL_PERCENT = 8
STOP = r"[.!?:;,…。！？；：，؟،؛](\s|[\"')\]»”’]|$)"
#: Whether the line itself ends as a sentence.
SENTENCE = r"[.!?…。！？؟][\"')\]»”’]*[\x09-\x0D\x20]*$"
#: A navigation line has separators between entries; or is short, ends no sentence, and names two parts of a site or asks to go to one.
MIN_SEPARATORS = 3
SEPARATORS = "|»›·>/•"
SEPARATOR = r"\s[|»›·>/•]\s?"
NAVIGATION_WORDS = 12
_PART = r"(home|menu|log ?in|sign ?in|sign ?up|register|search|sitemap|contact|about|help|faq|blog|news)"
NAVIGATION = rf"(?i)(^|[^a-z])({_PART}[^a-z](.*[^a-z])?{_PART}|(next|previous) page|read more|click here|back to top|contact us|about us|skip to content)([^a-z]|$)"
#: A boilerplate line is of at most so many words and has a phrase that prose does not have, or a phrase that it may have beside a sign of a site.
BOILERPLATE_WORDS = 40
BOILERPLATE = (
    r"(?i)(all rights reserved|copyright (©|\(c\)|\d{4})|\(c\) ?\d{4}|© ?\d{4}|enable javascript|subscribe to our|lorem ipsum|licensed under the|permission is hereby granted"
    r"|share (this|on) (page|post|article|facebook|twitter)|todos los derechos reservados|tous droits r.serv.s|alle rechte vorbehalten"
    r"|版权所有|保留所有权利|隐私政策|使用条款|جميع الحقوق محفوظة|سياسة الخصوصية|[Вв]се права защищены|[Пп]олитика конфиденциальности)"
)
SITE = (
    r"(?i)((you agree|by using|this (web ?)?site|this page|we use|our (privacy|cookie|terms|newsletter)).*(privacy policy|terms of (use|service)|cookie|newsletter|policy)"
    r"|(privacy policy|terms of (use|service)|cookie|newsletter).*(you agree|by using|this (web ?)?site|this page|we use))"
)
LINKS = r"(?i)(privacy policy|terms of (use|service)|cookie (policy|settings)|newsletter)"
MAX_LOST_PERCENT = 50


def _has_words(x: Column) -> Column:
    return x.rlike(r"[^\x20\x09-\x0D]")


def _n_words(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))


def _n_of(x: Column, characters: str) -> Column:
    """How many of these characters are in a text."""
    return F.char_length(x) - F.char_length(F.translate(x, characters, ""))


def line_fails(x: Column) -> Column:
    """Whether a line with words fails a rule; false without words. Counts come first: most lines of prose are too long for the patterns."""

    def judged(n: Column) -> Column:
        open_ = ~x.rlike(SENTENCE)
        punctuation = _n_of(x, SYMBOLS) * 100 > F.char_length(x) * MAX_SYMBOL_PERCENT
        listed = F.when(_n_of(x, SEPARATORS) >= MIN_SEPARATORS, F.regexp_count(x, F.lit(SEPARATOR)) >= MIN_SEPARATORS).otherwise(False)
        navigation = (n < NAVIGATION_WORDS) & (x.rlike(NAVIGATION) | x.rlike(LINKS)) & open_
        boilerplate = (n <= BOILERPLATE_WORDS) & (x.rlike(BOILERPLATE) | x.rlike(SITE))
        return (n > 0) & (punctuation | listed | ((n < FRAGMENT_WORDS) & ~x.rlike(STOP)) | navigation | boilerplate)

    return let(_n_words(x), judged)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often and in whatever lambda body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_repeat_words(words: Column) -> Column:
    """The number of words inside WINDOW-word windows that occur twice or more in the array.

    Windows are compared by 64-bit hashes of their words' hashes. Only rows in which a window occurs again sort theirs.
    """
    w = F.lit(WINDOW)

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - w + 1), lambda i: F.xxhash64(F.slice(hashes, i, w)))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(w, F.coalesce(F.get(at, k + 1) - p, w))), F.lit(0), lambda a, b: a + b)

    def twice(ordered: Column) -> Column:
        found = F.filter(ordered, lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]))
        return let(F.array_sort(F.transform(found, lambda x: x["i"])), covered)

    def counted(found: Column) -> Column:
        again = F.size(F.array_distinct(found)) < F.size(found)
        return F.when(again, let(F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twice)).otherwise(0)

    count = let(F.transform(words, lambda x: F.xxhash64(x)), lambda hashes: let(windows(hashes), counted))
    return F.when(F.size(words) >= WINDOW, count).otherwise(0).cast("long")


def quality_rules(docs: DataFrame, text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text, lost_chars, kept.

    clean_text is the text without the lines that failed; lost_chars counts the characters of those lines.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "lost_chars", "kept"]
    df = docs.select(F.struct(*[docs[c] for c in rest_of(docs, *made)]).alias("_row"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("_text"))
    df = df.withColumn("_words", F.array_remove(F.split("_text", SPACE), "")).withColumn("_lines", F.split("_text", "\n"))
    df = df.withColumn("n_repeat_words", n_repeat_words(F.col("_words")))
    df = df.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_symbols", _n_of(F.col("_text"), SYMBOLS).cast("long")).drop("_words")
    df = df.withColumn("_worded", F.filter("_lines", _has_words))
    df = df.withColumn("n_dup_lines", (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long"))
    df = df.withColumn("_kept_lines", F.filter("_lines", lambda x: ~line_fails(x)))
    df = df.withColumn("clean_text", F.array_join("_kept_lines", "\n"))
    lost = F.char_length(F.array_join("_lines", "")) - F.char_length(F.array_join("_kept_lines", ""))
    df = df.withColumn("lost_chars", lost.cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    kept = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.char_length(F.array_join("_lines", "")) * max_lost_percent)
    df = df.withColumn("kept", kept)
    return df.select("_row.*", *made)

"""Texts to token ids with a public tokenizer, exactly as encoding each whole text, but each distinct word once a task.

A byte-level BPE splits a text into words before it merges, and a single space between two non-spaces always ends a word.
So the ids of a text are those of its parts between such places, one after the other. Parts repeat, so they are kept in a
table of bounded size. A text that holds an added token's string goes through the tokenizer whole.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

_SPACES = re.compile(r"^\s|\s\s|\s$")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
MOST_PARTS = 800_000


class Encoder:
    """Encodes batches of texts; keeps the ids of the words that it has seen."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        #: Whether words are encoded on their own: byte level, no normaliser, no space put before a text.
        self.by_word = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.vocabulary = self.tokenizer.get_vocab_size()

        #: The bytes that each id stands for, to cut the ids of words that were encoded end to end.
        self.width = np.zeros(max(self.vocabulary, 1), np.int64)
        for piece, i in self.tokenizer.get_vocab().items():
            if i < self.vocabulary:
                self.width[i] = len(piece)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids_of = np.zeros(1 << 16, np.uint32)
        self.end_of = np.zeros(1 << 15, np.int64)
        self.used = self.n = 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _keep(self, flat: np.ndarray, ends: np.ndarray) -> int:
        """Stores the ids of new parts, given where each part ends in flat; returns the first part's number."""
        while self.used + len(flat) > len(self.ids_of):
            self.ids_of = np.concatenate([self.ids_of, np.zeros_like(self.ids_of)])
        while self.n + len(ends) > len(self.end_of):
            self.end_of = np.concatenate([self.end_of, np.zeros_like(self.end_of)])
        self.ids_of[self.used : self.used + len(flat)] = flat
        self.end_of[self.n : self.n + len(ends)] = self.used + ends
        first = self.n
        self.used, self.n = self.used + len(flat), self.n + len(ends)
        return first

    def _learn_words(self, words: list[str]) -> None:
        """Words that follow a space, or begin with a newline: encoded end to end and cut by the bytes of their ids."""
        parts = [w if w[0] == "\n" else " " + w for w in words]
        flat = np.fromiter((i for x in self._encode(["".join(parts[k : k + 512]) for k in range(0, len(parts), 512)]) for i in x), np.int64)
        stops = np.cumsum(np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts)))
        ends = np.searchsorted(np.cumsum(self.width[flat]), stops) + 1
        first = self._keep(flat, ends)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    def _alone(self, parts: list[str]) -> int:
        """Parts that are encoded by themselves and not kept by name; returns the first one's number."""
        lists = self._encode(parts)
        return self._keep(np.fromiter((i for x in lists for i in x), np.int64), np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))))

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """One flat array of ids (unsigned 32 bits), and the number of ids of each text."""
        if self.n > MOST_PARTS:
            self._clear()
        words: list[str | None] = []
        alone: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if not text:
                continue
            before = len(words)
            if not self.by_word or any(x in text for x in self.added):
                alone.append(text)
                words.append(None)
            elif _SPACES.search(text):
                parts = _SAFE.split(text)
                alone += [parts[0], *(" " + p for p in parts[1:])]
                words += [None] * len(parts)
            else:
                parts = text.replace("\n", " \n").split(" ")
                alone.append(parts[0])
                words.append(None)
                words += parts[1:]
            counts[k] = len(words) - before
        get = self.known.get
        which = np.fromiter((-2 if w is None else get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(which == -1)
        if len(missing):
            self._learn_words(list(dict.fromkeys(words[i] for i in missing)))
            which[missing] = [get(words[i]) for i in missing]
        if alone:
            single = np.flatnonzero(which == -2)
            which[single] = self._alone(alone) + np.arange(len(single))
        ends = self.end_of[which]
        starts = np.where(which > 0, self.end_of[which - 1], 0)
        lengths = ends - starts
        total = np.cumsum(lengths)
        flat = self.ids_of[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)]
        at = np.concatenate([[0], total])
        row = np.cumsum(counts)
        return flat, at[row] - at[row - counts]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path)


def vocabulary_file(path: str, name: str = "byte_bpe_50k.json") -> str:
    """path, or where that is empty the public vocabulary of this name."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)

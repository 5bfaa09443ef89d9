"""Ragged arrays of pre-tokens: merging steps that all byte-pair operators share, and a bounded memo of finished ones."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

NONE = np.int32(2**31 - 1)
#: A text is handled in pieces of about so many characters, cut only where the tokenizer cuts as well.
PIECE = 1 << 20


def every_other(hit: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring hits, the first, third, ...: pairs that share no symbol, leftmost first."""
    at = np.flatnonzero(hit)
    if len(at) < 2 or not (np.diff(at) == 1).any():
        return at
    first = np.concatenate(([True], np.diff(at) != 1))
    began = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - began) % 2 == 0]


def word_starts(word: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))


def pieces(text: str, cut: re.Pattern, size: int = PIECE) -> Iterator[str]:
    """The text in pieces, each (but the last) at least size long, split at the start of a match of cut."""
    at = 0
    while len(text) - at > size and (m := cut.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Memo(dict):
    """Values of chunks, kept from batch to batch of a Python worker.

    Beyond most entries (or chars) those at hand become the old ones, and the old ones not asked for since go.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable], most: int = 250_000, chars: int = 1 << 24, at_once: int = 8192):
        super().__init__()
        self.compute, self.most, self.chars, self.at_once, self.held, self.old = compute, most, chars, at_once, 0, {}

    def provide(self, chunks: Iterable[str]) -> None:
        """See that all chunks (distinct ones) have their values here."""
        if len(self) > self.most or self.held > self.chars:
            self.old = dict(self)
            self.clear()
            self.held = 0
        missing = [c for c in chunks if c not in self]
        old = self.old
        self.update((c, old[c]) for c in missing if c in old)
        new = [c for c in missing if c not in old] if old else missing
        for i in range(0, len(new), self.at_once):
            part = new[i : i + self.at_once]
            self.update(zip(part, self.compute(part)))
        self.held += sum(map(len, missing))


def encoded_words(words, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Ids of an Arrow array of words, and how many each word has. The memo gives a word's ids as bytes of 32-bit integers.

    Words repeat, so they are numbered by Arrow's dictionary encoding; only distinct ones are looked up.
    """
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    memo.provide(distinct)
    values = list(map(memo.__getitem__, distinct))
    flat = np.frombuffer(b"".join(values), "<u4")
    size = np.fromiter(map(len, values), np.int32, len(values)) // 4
    index = coded.indices.to_numpy()
    many = size[index]
    end = np.cumsum(many, dtype=np.int32)
    shift = (np.cumsum(size, dtype=np.int32) - size)[index] - (end - many)
    at = np.repeat(shift, many)
    at += np.arange(len(at), dtype=np.int32)
    ids = flat[at]
    return ids, many


def grouped(rows: Iterable, size: Callable[[object], int], most: int = 1 << 22) -> Iterator[list]:
    """Rows in lists of about most in size."""
    held: list = []
    total = 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held

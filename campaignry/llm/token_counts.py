"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens that a Python worker has not met are held as one ragged numpy array of byte symbols. In each round every
pre-token finds its pair of lowest rank and merges all its occurrences at once; pre-tokens without a mergeable pair
leave. What counts is the number of symbols that survive. Counts of pre-tokens are kept in a bounded memo.

Edge cases: a null text counts as an empty one (0 bytes, 0 tokens); a very long text is handled in pieces cut between a
letter and a space; repeated rows and ids give a row each; an empty table gives an empty result; other columns are
ignored. A special string inside a text is one token, as the library has it by default.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .ragged import NONE, Memo, every_other, grouped, pieces, word_starts

#: Pattern of the byte-level pre-tokenizer (a fixed value of the public vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII, Latin-1 and Latin Extended-A and -B without the separators 1C to 1F, for the faster library.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9²³¹¼-¾]+| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼-¾]+|\s+(?!\S)|\s+"
NOT_PLAIN = re.compile(r"[^\x00-\x1b\x20-ɏ]")
CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")
SHIFT = np.int64(20)


def byte_symbols() -> list[str]:
    """The characters that stand for the bytes 0 to 255 in byte-level vocabularies: printable ones for themselves, then 256 and up."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class ByteBPE:
    """A byte-level BPE vocabulary of the tokenizers library, as sorted pair keys with ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([(vocab[a] << int(SHIFT)) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int32)
        left, right = (x.ravel() for x in np.meshgrid(self.first, self.first, indexing="ij"))
        self.byte_ranks = self.rank(left, right).reshape(256, 256)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern, self.plain = regex.compile(PATTERN), re.compile(PLAIN)
        self.memo = Memo(self.counts)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, chunks: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        raw = [c.encode("utf-8", "surrogatepass") for c in chunks]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(raw)), size)
        rank = np.full(len(symbol), NONE, np.int32)
        rank[:-1] = np.where(word[1:] == word[:-1], self.byte_ranks[symbol[:-1], symbol[1:]], NONE)
        symbol = self.first[symbol]
        out = np.zeros(len(raw), np.int64)
        while len(symbol):
            starts = word_starts(word)
            best = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(symbol)))
            done = best == NONE
            out[word[starts[done]]] = length[done]
            live = np.repeat(~done, length)
            best, rank, symbol, word = np.repeat(best, length)[live], rank[live], symbol[live], word[live]
            hit = every_other(rank == best)
            symbol[hit] = self.merged[rank[hit]]
            rank[hit] = rank[hit + 1]  # NONE at a word's end
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            at = hit - np.arange(len(hit))
            at = np.concatenate((at[at > 0] - 1, at[at < len(symbol) - 1]))
            at = at[word[at] == word[at + 1]]
            rank[at] = self.rank(symbol[at], symbol[at + 1])
        return out.tolist()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, special strings as one token each."""
        found: list[list[list[str]]] = []
        fixed, chunks = [], set()
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            fixed.append(len(parts) - 1)
            cut = (self.pattern if NOT_PLAIN.search(text) else self.plain).findall
            found.append([cut(p) for part in parts for p in pieces(part, CUT)])
            for f in found[-1]:
                chunks.update(f)
        self.memo.provide(chunks)
        get = self.memo.__getitem__
        return [n + sum(sum(map(get, f)) for f in fs) for n, fs in zip(fixed, found)]


@cache
def vocabulary(path: str) -> ByteBPE:
    return ByteBPE(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than limit)."""

    def run(batches):
        import pyarrow as pa

        bpe = vocabulary(path)
        for batch in batches:
            at = 0
            for texts in grouped((t.as_py() or "" for t in batch.column(1)), len):
                n = np.array(bpe.count(texts), np.int64)
                n_bytes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *map(pa.array, (n_bytes, n, n > limit))], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
                at += len(texts)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

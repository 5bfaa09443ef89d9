"""Token ids in Simple-8b words.

File format: Parquet rows, one for each segment of whole documents in ascending doc_id order, with doc_ids, no_ids (how
many of them, from the first one, stand for a null), doc_lens (ids of each document), first (ids before the segment in
its part) and data, a binary string of little-endian fields:

    magic b"S8B1", block length u32, ids u64, words u64, block offsets u32 (blocks + 1, in words), words u64

A word's upper 4 bits select how many ids of how many bits fill its lower 60 bits, the first id lowest. Selector 15 is
the escape: the next word is one id as it is (60 bits are not enough). Blocks hold a fixed number of ids (the last one
fewer) and end with a padded word, so each can be decoded from its offset alone; all words of one selector are decoded
as one array. Parquet's commit protocol makes the files whole when executors are lost.

Edge cases: a null text counts as an empty one and has only the end id; rows with equal doc_id are ordered by a hash of
their text and then by text, null doc_ids come first; a very long text is tokenized in pieces cut at spaces; an empty table gives files without
rows; other columns are ignored.
"""

from __future__ import annotations

import codecs
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ragged import Memo, encoded_words, grouped, pieces

MAGIC = b"S8B1"
HEADER = struct.Struct("<4sIQQ")
BLOCK = 4096
#: Ids of a segment, about; a document is never divided.
SEGMENT = 1 << 17
#: Ids in a word and bits of each, by selector (fixed values of the Simple-8b layout).
COUNTS = (240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
WORD = np.dtype("<u8")
COUNT, BIT = np.array([*COUNTS, 1], np.int32), np.array([*BITS, 0], np.int32)
SHORT = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)  # bits of short ids
MASK = (np.uint64(1) << BIT.astype(np.uint64)) - np.uint64(1)


def encode_ids(ids: np.ndarray) -> bytes:
    """The data field of a segment."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if n and ids.max() >= 1 << 53:
        exact = ids < np.uint64(1 << 53)
        width = np.where(exact, np.frexp(np.where(exact, ids, 0).astype(np.float64))[1], np.where(ids < np.uint64(1 << 60), 60, 64)).astype(np.uint8)
    elif n and ids.max() < len(SHORT):
        width = SHORT[ids]
    else:
        width = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    select = np.zeros(n, np.uint8)  # what a selector can hold, the next one can as well: count those that can't
    widest, span = width, 1  # of each window of span ids
    for k in reversed(range(len(COUNTS))):
        while span < COUNTS[k]:
            step = min(span, COUNTS[k] - span)
            later = np.zeros_like(widest)
            later[: max(n - step, 0)] = widest[step:]
            widest, span = np.maximum(widest, later), span + step
        select += widest > BITS[k]
    place = np.arange(n, dtype=np.int32)
    after = np.minimum(place + COUNT[select], np.minimum((place // BLOCK + 1) * BLOCK, n))
    chain, at, jump = [], 0, after.tolist()
    while at < n:
        chain.append(at)
        at = jump[at]
    start = np.array(chain, np.int64)
    chosen = select[start]
    escaped = np.flatnonzero(chosen == ESCAPE)
    size = np.diff(np.append(start, n))
    inside = place - np.repeat(start, size)
    packed = np.bitwise_or.reduceat(ids << (inside * np.repeat(BIT[chosen], size)).astype(np.uint64), start) if n else ids
    packed |= chosen.astype(np.uint64) << np.uint64(60)
    words = np.zeros(len(start) + len(escaped), WORD)
    slot = np.arange(len(start)) + np.searchsorted(escaped, np.arange(len(start)))
    words[slot] = packed
    words[slot[escaped]] = np.uint64(ESCAPE << 60)
    words[slot[escaped] + 1] = ids[start[escaped]]
    offsets = np.append(slot[np.searchsorted(start, np.arange(0, n, BLOCK))], len(words)).astype("<u4")
    return HEADER.pack(MAGIC, BLOCK, n, len(words)) + offsets.tobytes() + words.tobytes()


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of a data field, all blocks at once."""
    magic, block, n, n_words = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b segment")
    blocks = -(-n // block)
    offsets = np.frombuffer(data, "<u4", blocks + 1, HEADER.size).astype(np.int64)
    words = np.frombuffer(data, WORD, n_words, HEADER.size + 4 * (blocks + 1))
    return _decode(words, offsets, block, n)


def decode_block(data: bytes, number: int) -> np.ndarray:
    """The ids of one block, found by its offset."""
    _, block, n, n_words = HEADER.unpack_from(data)
    blocks = -(-n // block)
    first, last = np.frombuffer(data, "<u4", 2, HEADER.size + 4 * number).tolist()
    words = np.frombuffer(data, WORD, last - first, HEADER.size + 4 * (blocks + 1) + 8 * first)
    return _decode(words, np.array([0, last - first]), block, min(block, n - number * block))


def _decode(words: np.ndarray, offsets: np.ndarray, block: int, n: int) -> np.ndarray:
    select = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)  # words after an escape
    for i in np.flatnonzero(select == ESCAPE).tolist():
        if not raw[i]:
            raw[i + 1] = True
    count = np.where(raw, 0, COUNT[select])
    before = np.cumsum(count) - count
    in_block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = np.minimum((in_block + 1) * block, n)
    count = np.minimum(count, end - (before - before[offsets[in_block]] + in_block * block))  # less what pads a block's last word
    inside = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
    out = np.repeat(words, count) >> (inside * np.repeat(BIT[select], count)).astype(np.uint64)
    out &= np.repeat(MASK[select], count)
    escaped = np.flatnonzero((select == ESCAPE) & ~raw)
    out[(np.cumsum(count) - count)[escaped]] = words[escaped + 1]
    return out


#: What ODD matches may change in ways that only the library knows; other texts are ASCII and Latin letters that keep their number of characters in lower case.
ODD = r"[^ -~\t\n\rÀ-ÖØ-öø-įĲ-ž]|<\|"
#: The vocabulary's own pattern (fixed), on such texts in lower case.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\sa-z0-9ß-öø-ž]+")
MARKS = r"([^\sa-z0-9ß-öø-ž]+)"
SPACES = re.compile(r"[ \t\n\r]+")


class WordTokenizer:
    """A tokenizers vocabulary that drops white space, with memos of the chunks between white space.

    Chunks of plain texts are cut into pre-tokens here and merged by the library's model, many in one call; a
    pre-token's last token has the mark of a word's end, which tells the calls' results apart. Chunks of other
    texts go through the whole library.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        from .token_counts import byte_symbols

        self.library = Tokenizer.from_file(path)
        if self.library.encode("A\tb \n it's\u2003Ç1", add_special_tokens=False).tokens != ["a</w>", "b</w>", "it</w>", "'s</w>", "Ã", "§</w>", "1</w>"]:
            raise ValueError(f"{path} is not a lower-casing vocabulary that drops white space")
        spec = json.loads(self.library.to_str())
        spec |= {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        self.merger = Tokenizer.from_str(json.dumps(spec))
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.merger.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.symbols = "".join(chr(b) if b < 127 else c for b, c in enumerate(byte_symbols()))
        self.words = Memo(self.merge, most=100_000)
        self.plain = Memo(self.plain_chunks, most=120_000, chars=1 << 23)
        self.other = Memo(self.other_chunks, most=50_000, chars=1 << 22)

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens."""
        lines = [" ".join(words[i : i + 64]) for i in range(0, len(words), 64)]
        lines = [x if x.isascii() else codecs.charmap_decode(x.encode(), "strict", self.symbols)[0] for x in lines]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.merger.encode_batch_fast(lines, add_special_tokens=False)])
        data, cut = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(cut) != len(words):
            raise ValueError("a pre-token has no end")
        return [data[a:b] for a, b in zip([0, *cut], cut)]

    def plain_chunks(self, chunks: list[str]) -> list[bytes]:
        cut = [[c] if c.isalpha() else PRE_TOKEN.findall(c) for c in chunks]
        self.words.provide({w for ws in cut for w in ws})
        get = self.words.__getitem__
        return [get(ws[0]) if len(ws) == 1 else b"".join(map(get, ws)) for ws in cut]

    def other_chunks(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(chunks, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        given = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(given, ODD).to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(given.filter(pa.array(~odd)))
        quoted = pc.match_substring(lower, "'").to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        rest = np.flatnonzero(~odd)
        marked = pc.replace_substring_regex(lower.filter(pa.array(~quoted)), MARKS, r" \1 ")  # fewer distinct chunks; 's and the like would be torn
        for of, part in ((rest[~quoted], marked), (rest[quoted], lower.filter(pa.array(quoted)))):
            words = pc.ascii_split_whitespace(part)
            self.fill(out, of, pc.list_parent_indices(words), words.flatten(), self.plain)
        if odd.any():
            split = [[c for p in pieces(texts[i], SPACES) for c in SPACES.split(p)] for i in np.flatnonzero(odd)]
            parent = pa.array(np.repeat(np.arange(len(split)), [len(x) for x in split]))
            self.fill(out, np.flatnonzero(odd), parent, pa.array([c for x in split for c in x], pa.large_string()), self.other)
        return out

    @staticmethod
    def fill(out: list, of: np.ndarray, parent, words, memo: Memo) -> None:
        """Put the ids of the texts numbered in of into out. parent: of each word, its text's place in of."""
        import pyarrow.compute as pc

        some = pc.not_equal(words, "")  # a text that begins or ends with white space
        ids, many = encoded_words(words.filter(some), memo)
        owner = parent.filter(some).to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(many))[np.searchsorted(owner, np.arange(len(of) + 1))]
        for i, a, b in zip(of.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            out[i] = ids[a:b]


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2) -> None:
    """Tokenize every text, append end_id to each, and write the ids in ascending doc_id order."""
    schema = "part int, first long, doc_ids array<bigint>, no_ids int, doc_lens array<bigint>, n_ids long, data binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tokenizer, part, first = word_tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def segment() -> pd.DataFrame:
            ids = np.concatenate([x for *_, x in held])
            numbers = [i for i, *_ in held]
            return pd.DataFrame({"part": [part], "first": [first], "doc_ids": [numbers], "no_ids": [sum(none for _, none, _ in held)], "doc_lens": [[len(x) for *_, x in held]], "n_ids": [len(ids)], "data": [encode_ids(ids)]})

        for batch in batches:
            rows = zip(batch["doc_id"].tolist(), batch["none"].tolist(), batch["text"].tolist())
            for group in grouped(((i, none, t or "") for i, none, t in rows), lambda r: len(r[2])):
                for (i, none, _), ids in zip(group, tokenizer.encode([t for *_, t in group])):
                    held.append((i, none, np.append(ids, np.uint32(end_id))))
                    size += len(ids) + 1
                    if size >= SEGMENT:
                        yield segment()
                        first, size, held = first + size, 0, []
        if held:
            yield segment()

    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("doc_id"), docs["doc_id"].isNull().alias("none"), "text")
    order = [F.col("none").desc(), F.col("doc_id"), F.xxhash64("text"), F.col("text")]  # a hash, so the rows of one doc_id spread without their texts in the ranges
    rows.repartitionByRange(*order[:3]).sortWithinPartitions(*order).mapInPandas(run, schema).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files of write_tokens."""
    files = spark.read.parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))  # a row for each writing task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids = decode_ids(r.data).astype("<u4")
                lens = np.asarray(r.doc_lens, np.int64)
                ends = np.cumsum(lens)
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip((ends - lens).tolist(), ends.tolist())]
                numbers = pd.arrays.IntegerArray(np.array(r.doc_ids, np.int64), np.arange(len(lens)) < r.no_ids)
                yield pd.DataFrame({"doc_id": numbers, "start": r.base + r.first + ends - lens, "n_tokens": lens, "ids_crc32": crc})

    return files.join(F.broadcast(bases), "part").select("base", "first", "doc_ids", "no_ids", "doc_lens", "data").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""SentencePiece encoding and decoding by suffix-array matching.

The new words of a batch are concatenated and indexed by a suffix array, sorted as deep as the longest piece. Every
piece is searched in it whole, by bisection, which gives the range of its occurrences; these become edges, ordered by position
and length. The public model merges byte-pair pieces, so edges are relaxed best score first: an edge is taken when it
spans exactly two present symbols, and of a word's edges with the best score those that do not disturb each other are
taken at once, leftmost first. What no piece covers becomes byte pieces.

Edge cases: null and empty texts give no ids and decode to the empty text; a very long text is handled in pieces cut at
single spaces; U+2581 in a text is a space to the model, so it decodes to a space; repeated rows give a row each; an
empty table gives an empty result; other columns pass through or are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name
from .ragged import NONE, Memo, every_other, grouped, pieces, word_starts

SPACE = "▁"
CUT = re.compile(f"(?<=[^ {SPACE}]) (?=[^ {SPACE}])")  # no run of what becomes spaces is torn
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+\\Z")
UNSIGNED = np.dtype("<u4")


class PieceModel:
    """Pieces and scores of a byte-pair SentencePiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        if any(model.is_unused(i) for i in ids) or model.normalize("a  b\n ﬁ ") != f"{SPACE}a{SPACE}{SPACE}b\n{SPACE}ﬁ{SPACE}":
            raise ValueError(f"{path} rewrites texts before it matches pieces")
        self.text = [model.id_to_piece(i) for i in ids]
        self.byte_id = np.full(256, -1, np.int64)
        for i in ids:
            if model.is_byte(i):
                self.byte_id[int(self.text[i][3:5], 16)] = i
        if (self.byte_id < 0).any():
            raise ValueError(f"{path} has no byte fallback")
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        if any(SPACE in self.text[i].lstrip(SPACE) for i in normal):
            raise ValueError(f"{path} has pieces that span words")
        _, place = np.unique([-model.get_score(i) for i in normal], return_inverse=True)
        self.rank = np.full(len(ids) + 1, NONE, np.int32)  # the last stands for no piece
        self.rank[normal] = place
        codes = [np.frombuffer(self.text[i].encode("utf-32-le"), UNSIGNED) for i in normal]
        self.piece_id = np.array(normal, np.int64)
        self.piece_len = np.array([len(c) for c in codes], np.int64)
        self.depth = int(-(-self.piece_len.max() // 8) * 8)
        char = np.unique(np.concatenate(codes))
        self.place = np.full(0x110000, len(char) + 1, np.uint16)  # of a character among those of the pieces; the last is for all others
        self.place[char] = np.arange(1, len(char) + 1)
        self.piece_code = np.zeros((len(normal), self.depth), np.uint16)
        for row, c in zip(self.piece_code, codes):
            row[: len(c)] = self.place[c]
        self.others = len(char) + 1
        #: What each id adds to a decoded text: bytes.
        self.decoded = [b"" if model.is_control(i) else self.text[i].replace(SPACE, " ").encode() for i in ids]
        for b, i in enumerate(self.byte_id):
            self.decoded[i] = bytes([b])
        self.unknown = model.unk_id()
        self.decoded[self.unknown] = " ⁇ ".encode()
        self.memo = Memo(self.encode_chunks)

    def edges(self, code: np.ndarray) -> np.ndarray:
        """Piece id of each edge, or -1, by position * (depth + 1) + length. code: places of the characters of all words, 0 after each word."""
        present = np.zeros(self.others + 1, bool)
        present[code] = True
        present[0] = True
        cell = np.dtype(">u2" if present.sum() > 250 else "u1")
        narrow = (np.cumsum(present) - 1).astype(cell)
        fits = present[self.piece_code].all(axis=1)
        packed = np.zeros(len(code) + self.depth, cell)
        packed[: len(code)] = narrow[code]
        suffix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(packed, self.depth)[: len(code)])
        keys = suffix.view(">u8").reshape(len(code), -1)  # a suffix is so many 64-bit keys
        at = np.flatnonzero(code)
        head = keys[at, 0].astype(np.uint64)
        order = np.argsort(head, kind="stable")
        tied = head[order][1:] == head[order][:-1]
        tied = np.flatnonzero(np.append(tied, False) | np.append(False, tied))  # only these need their further keys
        order[tied] = order[tied][np.lexsort(keys[at[order[tied]]].T[::-1])]
        head, array = head[order], at[order]
        piece, length = self.piece_code[fits], self.piece_len[fits]
        low = narrow[piece]
        high = np.where(np.arange(self.depth) < length[:, None], low, np.iinfo(cell).max)
        low, high = (np.ascontiguousarray(x, cell) for x in (low, high))
        (first, last) = (np.searchsorted(head, x.view(">u8").reshape(len(x), -1)[:, 0].astype(np.uint64), side) for x, side in ((low, "left"), (high, "right")))
        long = np.flatnonzero((length * cell.itemsize > 8) & (last > first))  # pieces beyond the first key, among the suffixes that share it
        whole = f"S{self.depth * cell.itemsize}"  # compares as bytes; zeros at the end don't count, as beyond a word
        if len(long):
            bound = suffix[array].view(whole).ravel()
            first[long], last[long] = (np.searchsorted(bound, x[long].view(whole).ravel(), side) for x, side in ((low, "left"), (high, "right")))
        many = last - first
        which = np.repeat(np.arange(len(many)), many)
        found = array[np.arange(len(which)) + np.repeat(first - (np.cumsum(many) - many), many)]
        table = np.full(len(code) * (self.depth + 1), -1, np.int32)
        table[found * (self.depth + 1) + length[which]] = self.piece_id[fits][which]
        return table

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each word (without the space that begins it), as little-endian 32-bit integers."""
        joined = "".join(f"{SPACE}{c}\0" for c in chunks)
        char = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), UNSIGNED)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
        word_of = np.repeat(np.arange(len(chunks), dtype=np.int32), size + 1)
        ends = np.cumsum(size + 1) - 1
        known = self.place[char]
        known[ends] = 0
        table = self.edges(known)
        begins = np.ones(len(char), bool)
        begins[ends] = False
        self.relax(table, np.flatnonzero(begins), word_of, begins)
        start = np.flatnonzero(begins)
        length = np.diff(np.append(start, len(char)))
        length[np.append(word_of[start[1:]] != word_of[start[:-1]], True)] -= 1  # the 0 after the word
        ids = table[start * (self.depth + 1) + length].astype(np.int64)
        word = word_of[start]
        if (lost := np.flatnonzero(ids < 0)).size:
            raw = [joined[i].encode("utf-8", "surrogatepass") for i in start[lost]]
            count = np.ones(len(ids), np.int64)
            count[lost] = [len(r) for r in raw]
            spread = np.repeat(ids, count)
            spread[np.isin(np.repeat(np.arange(len(ids)), count), lost)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            ids, word = spread, np.repeat(word, count)
        data, cut = ids.astype(UNSIGNED).tobytes(), (np.searchsorted(word, np.arange(len(chunks) + 1)) * 4).tolist()
        return [data[a:b] for a, b in zip(cut, cut[1:])]

    def relax(self, table: np.ndarray, start: np.ndarray, word_of: np.ndarray, begins: np.ndarray) -> None:
        """Take edges until none spans two symbols; begins keeps where symbols begin."""
        length = np.ones(len(start), np.int32)
        word = word_of[start]

        def rank(a: np.ndarray, n: np.ndarray) -> np.ndarray:
            return self.rank[table[a * (self.depth + 1) + np.where(n <= self.depth, n, 0)]]  # none has length 0

        ranks = np.full(len(start), NONE, np.int32)
        at = np.flatnonzero(word[1:] == word[:-1])
        while len(start):
            ranks[at] = rank(start[at], length[at] + length[at + 1])
            heads = word_starts(word)
            best = np.minimum.reduceat(ranks, heads)
            many = np.diff(np.append(heads, len(start)))
            live = np.repeat(best != NONE, many)
            best, ranks, start, length, word = np.repeat(best, many)[live], ranks[live], start[live], length[live], word[live]
            hit = every_other(ranks == best)
            hit = self.undisturbed(hit, best, start, length, word, rank)
            begins[start[hit + 1]] = False
            length[hit] += length[hit + 1]
            ranks[hit] = NONE
            keep = np.ones(len(start), bool)
            keep[hit + 1] = False
            ranks, start, length, word = ranks[keep], start[keep], length[keep], word[keep]
            hit = hit - np.arange(len(hit))
            at = np.concatenate((hit[hit > 0] - 1, hit[hit < len(start) - 1]))
            ranks[at] = NONE
            at = at[word[at] == word[at + 1]]

    @staticmethod
    def undisturbed(hit: np.ndarray, best: np.ndarray, start: np.ndarray, length: np.ndarray, word: np.ndarray, rank) -> np.ndarray:
        """The hits, but only the first one of a word where taking one opens a better edge before the next is taken."""
        many = np.bincount(word[hit], minlength=int(word[-1]) + 1 if len(word) else 0) if len(hit) else np.zeros(0, np.int64)
        several = hit[many[word[hit]] > 1]
        if not len(several):
            return hit
        taken = np.zeros(len(start) + 1, bool)
        taken[several] = True
        both = length[several] + length[several + 1]
        after = np.minimum(several + 2, len(start) - 1)
        right = np.where((several + 2 < len(start)) & (word[after] == word[several]), rank(start[several], both + length[after]), NONE)
        before = np.maximum(several - 1, 0)
        inside = (several > 0) & (word[before] == word[several])
        left = np.where(inside, rank(start[before], both + length[before]), NONE)
        pair = np.maximum(several - 2, 0)
        merged = inside & (several > 1) & taken[pair]
        left = np.minimum(left, np.where(merged, rank(start[pair], both + length[before] + length[pair]), NONE))
        bad = np.unique(word[several[np.minimum(left, right) < best[several]]])
        if not len(bad):
            return hit
        first = np.concatenate(([True], word[hit][1:] != word[hit][:-1]))
        return hit[first | ~np.isin(word[hit], bad)]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Words of a text, each without the space that begins it."""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if not text:
            return []
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in CHUNK.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        found = []
        for text in texts:
            parts = list(pieces(text, CUT))
            found.append([c for i, p in enumerate(parts) for c in self.chunks(p[1:] if i else p)])
        self.memo.provide(set().union(*found))
        get = self.memo.__getitem__
        return [b"".join(map(get, f)) for f in found]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space that the model adds in front; broken bytes become U+FFFD."""
        out = b"".join(map(self.decoded.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


@cache
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "piece_ids", decoded: str | None = "decoded") -> DataFrame:
    """docs with the ids of each text, and the text that they decode to. A name that docs has already is lengthened."""
    ids = free_name(docs, ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if decoded:
        decoded = free_name(docs, decoded)
        schema.add(decoded, T.StringType())

    def run(batches):
        import pyarrow as pa

        model = piece_model(path)
        for batch in batches:
            at = 0
            for group in grouped((t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()), len):
                rows = batch.slice(at, len(group))
                at += len(group)
                found = [np.frombuffer(b, UNSIGNED).astype(np.int32) for b in model.encode(group)]
                offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                arrays = [*rows.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))]
                if decoded:
                    arrays.append(pa.array([model.decode(f) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(run, schema)

"""Mining of phrase collocations by counting on a minimal perfect hash.

Four passes read the texts. The first sums words and pairs into count-min counters, which never underestimate, the second
phrases of 3 and 4 words all of whose pairs may reach the least frequency. The third gathers the candidates: phrases whose own
cell and, by Apriori, those of all their parts reach it. A minimal perfect hash gives each candidate a slot, with the
candidate stored there. In the fourth pass mappers look up the phrases of their texts, verify the stored key and bincount into numpy arrays, which are summed by block of slots. The parts of
each frequent phrase are then looked up again, and their counts read by slot, to score its cuts.

What mappers hold is bounded: counters have at most sketch.MOST_WIDTH cells a row, and slots come in groups of
GROUP_BYTES of stored keys; more candidates mean more runs of the fourth pass.

Edge cases: a null text counts as an empty one, a null language as `und`; words of the least frequency or more that no
phrase has are counted, but not returned; repeated rows count each; a very long text is split in parts that share three words,
so nothing is lost between them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import perfect_hash
from .common import materialize
from .sketch import MOST, Counters, reaches, summed_bits, width_for

LONGEST, LEAST, REPORT = 4, 30, 2000
#: A phrase goes if a longer one has this share of its occurrences: 80 of 100.
SHARE = (80, 100)
SCALE = 2_000_000
#: Rows of counters for each length, and bytes of text for each cell of a row. A rare phrase shares a cell with a frequent one now and then, but seldom in both rows.
DEPTH, BYTES_A_CELL = 2, 64
#: Lengths of phrases that each pass over the texts sums.
STEPS = ((1, 2), (3, 4))
#: Words of a chunk, candidates of a block of slots, and bytes of the keys that mappers hold at once.
CHUNK, KEYS, GROUP_BYTES = 1 << 18, 1 << 16, 96 << 20
#: Bytes of a piece that are split into words at once.
PART = 1 << 22
BREAK = b"\n"
#: A to Z in lower case; what divides pieces is a line feed, what divides words a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))
SALTS = 64
#: Distinct candidates that a task holds before it sends them.
HELD = 600_000
BLOCK_ROW = "block long, sizes array<long>, bits binary, keys binary, ends binary, bytes long"


def chunks(texts: Iterable[str | None]) -> Iterator[tuple[list[bytes], int]]:
    """Words of texts with BREAK after each piece, in lists, and how many of a list's first words the one before had as well."""
    words: list[bytes] = []
    again = 0
    for text in texts:
        for piece in (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split(BREAK):
            at = 0
            while at <= len(piece):
                end = piece.find(b" ", at + PART) if len(piece) - at > PART else -1
                end = len(piece) if end < 0 else end
                words += piece[at:end].split()
                at = end + 1
                if len(words) >= CHUNK:
                    yield words, again
                    words = words[-(LONGEST - 1) :]
                    if BREAK in words:
                        words = words[len(words) - words[::-1].index(BREAK) :]
                    again = len(words)
            words.append(BREAK)
    if words:
        yield words, again


def by_language(batch, lang: int, text: int) -> Iterator[tuple[str, Iterator[str]]]:
    """The texts of an Arrow batch by language."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for g in pc.unique(batch.column(lang)).to_pylist():
        of = batch.column(text).filter(pc.equal(batch.column(lang), pa.scalar(g, batch.column(lang).type)))
        yield g, (t.as_py() for t in of)


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    import xxhash

    seed = zlib.crc32(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all but the last word and of the last word."""
    return perfect_hash.mixed(prefix, 77) ^ word


def cells_of(h: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each hash in each of the DEPTH rows of its length."""
    return [((h >> np.uint64(32 * d)) & np.uint64(width - 1)).astype(np.int64) for d in range(DEPTH)]


class Phrases:
    """The distinct phrases of a chunk by length: hash, count, and the places of their words in dictionary.

    With bits of counters, of the shorter lengths or all, only those phrases are here whose own cell and those of all parts reach the least frequency.
    """

    def __init__(self, words: list[bytes], again: int, lang: str, bits: np.ndarray | None = None, width: int = 0, longest: int = LONGEST):
        import pyarrow as pa

        coded = pa.array(words, pa.binary()).dictionary_encode()
        self.lang, self.dictionary = lang, coded.dictionary
        code = coded.indices.to_numpy().astype(np.int64)
        distinct = self.dictionary.to_pylist()
        many = len(distinct)
        sound = code != (distinct.index(BREAK) if BREAK in distinct else -1)
        counted = np.arange(len(code)) >= again  # by the last word
        self.n_words = int((sound & counted).sum())
        self.hash, self.count, self.words, self.alive = [], [], [], []

        def found(h: np.ndarray, count: np.ndarray, places: np.ndarray) -> np.ndarray:
            live = np.ones(len(h), bool)
            if bits is not None and DEPTH * len(self.hash) < len(bits):
                for row, slots in enumerate(cells_of(h, width), DEPTH * len(self.hash)):
                    live &= reaches(bits[row], slots)
            self.hash.append(h)
            self.count.append(count)
            self.words.append(places)
            self.alive.append(np.flatnonzero(live & (count > 0)))
            return live

        h = word_hashes(distinct, lang)
        live = found(h, np.bincount(code[sound & counted], minlength=many), np.arange(many)[:, None])
        at = np.where(sound & live[code], code, -1)  # number of the phrase that begins here, of the length before
        for n in range(2, longest + 1):
            starts = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
            number, key = pd.factorize(at[starts] * many + code[starts + n - 1])
            prefix, last = np.divmod(key, many)
            count = np.bincount(number[counted[starts + n - 1]], minlength=len(key))
            live = found(longer(self.hash[-1][prefix], h[last]), count, np.concatenate((self.words[-1][prefix], last[:, None]), axis=1))
            at = np.full(len(code), -1, np.int64)
            at[starts] = np.where(live[number], number, -1)

    def keys(self, i: int, numbers: np.ndarray):
        """Arrow array of the stored form of phrases of i + 1 words: language, tab, words with spaces."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = [self.dictionary.take(pa.array(c)) for c in self.words[i][numbers].T]
        head = pa.scalar(self.lang.encode("utf-8", "surrogatepass") + b"\t", pa.binary())
        joined = pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.binary())) if len(texts) > 1 else texts[0]
        return pc.binary_join_element_wise(head, joined, pa.scalar(b"", pa.binary()))


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """Hashes of stored keys, equal to those of Phrases."""
    out = np.zeros(len(keys), np.uint64)
    parts = [k.rpartition(b"\t") for k in keys]
    held: dict[tuple, list[int]] = {}
    split = [p[2].split(b" ") for p in parts]
    for i, (p, w) in enumerate(zip(parts, split)):
        held.setdefault((p[0], len(w)), []).append(i)
    for (lang, n), rows in held.items():
        columns = [word_hashes([split[i][k] for i in rows], lang.decode("utf-8", "surrogatepass")) for k in range(n)]
        h = columns[0]
        for c in columns[1:]:
            h = longer(h, c)
        out[rows] = h
    return out


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return (perfect_hash.mixed(h, 99) % np.uint64(blocks)).astype(np.int64)


def possible_phrases(docs: DataFrame, width: int, least: int) -> np.ndarray:
    """Bits of the cells that reach least, DEPTH rows for each length."""
    spark, bits = docs.sparkSession, np.zeros((0, width // 8), np.uint8)
    for lengths in STEPS:
        shorter = spark.sparkContext.broadcast(bits)

        def run(batches, lengths=lengths, shorter=shorter):
            import pyarrow as pa

            counters = Counters(DEPTH * len(lengths), width)
            for batch in batches:
                for lang, texts in by_language(batch, 0, 1):
                    for words, again in chunks(texts):
                        found = Phrases(words, again, lang, shorter.value, width, lengths[-1])
                        for i, n in enumerate(lengths):
                            which = found.alive[n - 1]
                            for row, slots in enumerate(cells_of(found.hash[n - 1][which], width), DEPTH * i):
                                counters.add(row, slots, found.count[n - 1][which])
            for block, cells in counters.blocks():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([cells], pa.binary())], names=["block", "cells"])

        bits = np.concatenate((bits, summed_bits(docs.mapInArrow(run, "block long, cells binary"), DEPTH * len(lengths), width, min(least, MOST))))
        shorter.unpersist()
    return bits


def packed(keys: list[bytes]) -> bytes:
    """Sorted keys as one compressed string: how many, their ends, and themselves."""
    import zstandard

    ends = np.cumsum([len(k) for k in keys], dtype=np.int64)
    return zstandard.ZstdCompressor(level=6).compress(np.int64(len(keys)).tobytes() + ends.tobytes() + b"".join(keys))


def unpacked(data: bytes) -> list[bytes]:
    import zstandard

    whole = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(whole, np.int64, 1)[0])
    ends = np.frombuffer(whole, np.int64, n, 8).tolist()
    body = whole[8 + 8 * n :]
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def candidates(docs: DataFrame, bits, width: int, parts: int) -> DataFrame:
    """key: the stored form of each candidate, once. Each task sends what it has met, packed by parts of the hashes."""

    def run(batches):
        import pyarrow as pa

        held: dict[int, set] = {}

        def flush():
            for part, keys in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([packed(sorted(keys))], pa.binary())], names=["part", "keys"])
            held.clear()

        for batch in batches:
            for lang, texts in by_language(batch, 0, 1):
                for words, again in chunks(texts):
                    found = Phrases(words, again, lang, bits.value, width)
                    for i, numbers in enumerate(found.alive):
                        for part, key in zip(block_of(found.hash[i][numbers], parts).tolist(), found.keys(i, numbers).to_pylist()):
                            held.setdefault(part, set()).add(key)
                    if sum(map(len, held.values())) > HELD:
                        yield from flush()
        yield from flush()

    def once(batches):
        import pyarrow as pa

        held: dict[int, set] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(part, set()).update(unpacked(data))
        for keys in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.binary())], names=["key"])

    return docs.mapInArrow(run, "part long, keys binary").repartition("part").mapInArrow(once, "key binary")


def stored_keys(keys: bytes, ends: bytes):
    """Arrow array of the keys of a block."""
    import pyarrow as pa

    offsets = np.concatenate(([np.int32(0)], np.frombuffer(ends, np.int32)))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(keys)])


def hashed_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """block, sizes, bits, keys (one after the other, by slot), ends (of each, 32 bits), bytes: the perfect hash, a row for each block."""

    def number(batches):
        import pyarrow as pa

        for batch in batches:
            h = key_hashes(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.view(np.int64)), pa.array(block_of(h, blocks))], names=["key", "h", "block"])

    def built(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        sizes, bits, slot = perfect_hash.build(rows["h"].to_numpy().view(np.uint64))
        keys = np.empty(len(rows), object)
        keys[slot] = rows["key"].to_numpy()
        ends = np.cumsum([len(k) for k in keys], dtype=np.int32)
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "sizes": [sizes], "bits": [bits], "keys": [b"".join(keys)], "ends": [ends.tobytes()], "bytes": [int(ends[-1]) + 16 * len(keys)]})

    return keys.mapInArrow(number, "key binary, h long, block long").groupBy("block").applyInPandas(built, BLOCK_ROW)


class Group:
    """The blocks of a group, for lookups, and, once they are summed, their counts."""

    def __init__(self, rows: list, blocks: int, counts: dict[int, bytes] | None = None):
        self.rows, self.blocks = [(r["block"], list(r["sizes"]), bytes(r["bits"]), bytes(r["keys"]), bytes(r["ends"])) for r in rows], blocks
        self.counts = counts
        self.slots: dict[int, perfect_hash.Slots] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"slots": {}}

    def find(self, h: np.ndarray, asked) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(block, numbers of the asked keys found in it, their slots)."""
        import pyarrow as pa

        if not self.slots:
            self.slots = {b: perfect_hash.Slots(sizes, bits, stored_keys(keys, ends)) for b, sizes, bits, keys, ends in self.rows}
            self.rows = []
        block = block_of(h, self.blocks)
        order = np.argsort(block, kind="stable")
        edges = np.searchsorted(block[order], np.arange(self.blocks + 1)) if self.blocks < len(h) else None
        for b in self.slots:
            here = order[edges[b] : edges[b + 1]] if edges is not None else order[np.searchsorted(block[order], b) : np.searchsorted(block[order], b, "right")]
            if len(here):
                slot = self.slots[b].find(h[here], asked.take(pa.array(here)))
                yield b, here[slot >= 0], slot[slot >= 0]


def group_counts(docs: DataFrame, bits, width: int, group) -> DataFrame:
    """block, counts (64-bit integers by slot, compressed) and, where block is null, lang and its number of words."""

    def run(batches):
        import pyarrow as pa

        known, held, n_words = group.value, {}, {}
        for batch in batches:
            for lang, texts in by_language(batch, 0, 1):
                for words, again in chunks(texts):
                    found = Phrases(words, again, lang, bits.value, width)
                    n_words[lang] = n_words.get(lang, 0) + found.n_words
                    for i, numbers in enumerate(found.alive):
                        n = found.count[i][numbers]
                        for b, which, slot in known.find(found.hash[i][numbers], found.keys(i, numbers)):
                            if b not in held:
                                held[b] = np.zeros(len(known.slots[b].keys), np.int64)
                            held[b] += np.bincount(slot, n[which], len(held[b])).astype(np.int64)
        out = [(b, zlib.compress(a.tobytes(), 1), None, None) for b, a in held.items()] + [(None, None, g, n) for g, n in n_words.items()]
        for row in out:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.string(), pa.int64()))], names=["block", "counts", "lang", "n"])

    def add(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = np.frombuffer(zlib.decompress(data), np.int64)
                total[b] = total[b] + a if b in total else a
        for b, a in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([zlib.compress(a.tobytes(), 1)], pa.binary()), pa.array([None], pa.string()), pa.array([None], pa.int64())], names=["block", "counts", "lang", "n"])

    schema = "block long, counts binary, lang string, n long"
    partial = materialize(docs.mapInArrow(run, schema), "slot-counts")
    summed = partial.where("block IS NOT NULL").repartition("block").mapInArrow(add, schema)
    words = partial.where("block IS NULL").groupBy("lang").agg(F.sum("n").alias("n")).select(F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("counts"), "lang", "n")
    return summed.union(words)


def frequent(hashed: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """lang, phrase, a: the candidates that do reach least."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for keys, ends, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n = np.frombuffer(zlib.decompress(data), np.int64)
                at = np.flatnonzero(n >= least)
                split = [k.rpartition(b"\t") for k in stored_keys(keys, ends).take(pa.array(at)).to_pylist()]
                columns = [pa.array([s[i] for s in split], pa.binary()).cast(pa.string()) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n[at])], names=["lang", "phrase", "a"])

    return hashed.join(counts.where("block IS NOT NULL").select("block", "counts"), "block").select("keys", "ends", "counts").mapInArrow(run, "lang string, phrase string, a long")


def read_by_slot(parts: DataFrame, group) -> DataFrame:
    """parts (lang, part, ...) with f, the count of the part, for those that the group has."""
    schema = T.StructType([*parts.schema.fields, T.StructField("f", T.LongType())])

    def run(batches):
        import pyarrow as pa

        known = group.value
        of = {b: np.frombuffer(zlib.decompress(d), np.int64) for b, d in known.counts.items()}
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in ("lang", "part")}
            keys = [f"{g}\t{p}".encode("utf-8", "surrogatepass") for g, p in zip(*(batch.column(i).to_pylist() for i in at.values()))]
            for b, which, slot in known.find(key_hashes(keys), pa.array(keys, pa.binary())):
                rows = batch.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(of[b][slot])], names=schema.names)

    return parts.mapInArrow(run, schema)


def collocations(docs: DataFrame, least: int = LEAST, most: int = REPORT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to 4 words; see the module's text."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    width = width_for(size / BYTES_A_CELL)
    bits = spark.sparkContext.broadcast(possible_phrases(rows, width, least))
    keys = materialize(candidates(rows, bits, width, min(1 << 16, max(64, size >> 26))), "candidates")
    blocks = max(1, -(-keys.count() // KEYS))
    hashed = materialize(hashed_blocks(keys, blocks), "perfect-hash")
    groups: list[list[int]] = [[]]
    held = 0
    for b, n in hashed.select("block", "bytes").orderBy("block").toLocalIterator():  # a number for each block of KEYS
        if held and held + n > GROUP_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(b)
        held += n
    counts = []
    for of in groups:
        group = spark.sparkContext.broadcast(Group(hashed.where(F.col("block").isin(of)).collect(), blocks))
        counts.append(materialize(group_counts(rows, bits, width, group), "counts"))
        group.unpersist()
    words = counts[0].where("block IS NULL").select("lang", F.col("n").alias("n"))
    summed = counts[0]
    for more in counts[1:]:
        summed = summed.union(more)
    found = materialize(frequent(hashed, summed, least).where(F.instr("phrase", " ") > 0).withColumn("w", F.split("phrase", " ")), "frequent")
    side = lambda k, i, words: F.struct(k.alias("k"), F.lit(i).alias("side"), F.array_join(words, " ").alias("part"))
    cut = lambda k: F.array(side(k, 0, F.slice("w", F.lit(1), k)), side(k, 1, F.slice("w", k + 1, F.size("w"))))
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w") - 1), cut))
    parts = found.select("lang", "phrase", F.inline(cuts))
    read = None
    for of, count in zip(groups, counts):
        got = {r["block"]: bytes(r["counts"]) for r in count.where("block IS NOT NULL").collect()}  # of a group's keys
        group = spark.sparkContext.broadcast(Group(hashed.where(F.col("block").isin(list(got))).collect(), blocks, got))
        part = read_by_slot(parts, group)
        if len(groups) > 1:
            part = materialize(part, "read")
            group.unpersist()
        read = part if read is None else read.union(part)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    sides = read.groupBy("lang", "phrase", "k").agg(*[F.max(F.when(F.col("side") == i, F.col("f"))).alias(n) for i, n in enumerate("lr")])
    scored = sides.join(found.select("lang", "phrase", "a"), ["lang", "phrase"]).withColumns({"_a": exact("a") * SCALE, "_of": exact("l") + exact("r")}).withColumn("score", F.expr("_a div _of"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    within = found.where(F.size("w") > 2).select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    share, whole = SHARE
    alone = lowest.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (exact("longer") * whole < exact("a") * share)).drop("longer")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    alone = alone.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))  # a language's best come from the best of its parts
    best = alone.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

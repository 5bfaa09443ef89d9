"""Audit of how far sources diverge: terms that mark a source within its language, and the distance of each pair of sources.

Two passes read the texts. The first fills count-min counters with the document frequencies of the terms of each
language; they are merged and never underestimate, so a term whose cells stay below the least frequency is discarded
before anything is shuffled. The second counts what survives exactly, by language, source and term, and drops what was not
discarded in vain. Pairs of sources meet only at terms that both have: what a term adds where one side or both lack it follows from
the counts of counts of a source and from the number of terms.

With count c of a term in a group of N occurrences of the V kept terms, p = 1 + floor(10^9 (c + 1) / (N + V)); a term adds
floor((p - q)^2 / q), p the group's, q the other's.

Edge cases: null text, language and source count as ''; an empty text has no term, but its source is a group; a language
without a kept term has pairs of value 0; repeated rows are documents of their own; a very long text is split in parts;
an empty table gives an empty result; other columns are ignored. Exact up to 9 * 10^15 occurrences of a language.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_key, materialize
from .sketch import MOST, SCHEMA, Counters, reaches, summed_bits, width_for

LEAST_DOCUMENTS, MOST_TERMS = 3, 200
DEPTH = 2
#: Bytes of text for each cell of a row.
BYTES_A_CELL = 64
#: Distinct terms that a task holds before it passes their counts on.
HELD = 400_000
#: Bytes of a text that are split into terms at once.
PART = 1 << 22
#: Letters stay, A to Z in lower case, bytes beyond ASCII stay; all else divides terms.
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SALTS = 64


def term_lists(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists."""
    data, at = (text or "").encode("utf-8", "surrogatepass").translate(TO_TERMS), 0
    while len(data) - at > PART and (end := data.find(b" ", at + PART)) >= 0:
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def slots_of(terms: list[bytes], lang: str, width: int) -> list[np.ndarray]:
    """Cell of each term of a language in each row."""
    import xxhash

    seed = zlib.crc32(lang.encode("utf-8", "surrogatepass"))
    h = np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in terms), np.uint64, len(terms))
    return [((h >> np.uint64(32 * i)) & np.uint64(width - 1)).astype(np.int64) for i in range(DEPTH)]


def possible_terms(docs: DataFrame, width: int, least: int) -> np.ndarray:
    """Bits of the cells of terms that may be in least documents of a language."""

    def run(batches):
        import pyarrow as pa

        counters, held = Counters(DEPTH, width), {}

        def flush() -> None:
            for lang, counted in held.items():
                terms, n = list(counted), np.fromiter(counted.values(), np.int64, len(counted))
                for row, slots in enumerate(slots_of(terms, lang, width)):
                    counters.add(row, slots, n)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                held.setdefault(lang, Counter()).update(set().union(*term_lists(text)))
                if sum(map(len, held.values())) > HELD:
                    flush()
        flush()
        for block, cells in counters.blocks(1):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([cells], pa.binary())], names=["block", "cells"])

    return summed_bits(docs.mapInArrow(run, SCHEMA), DEPTH, width, min(least, MOST))


def term_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, source, term, n (occurrences there), total (of the language), first (one row of each term of a language), of the terms in least documents of the language."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    width = width_for(size / BYTES_A_CELL)
    bits = docs.sparkSession.sparkContext.broadcast(possible_terms(docs, width, least))

    def run(batches):
        import pyarrow as pa

        held: dict[tuple, tuple[Counter, Counter]] = {}

        def flush():
            for (lang, source), (n, df) in held.items():
                terms = list(df)
                ok = np.logical_and.reduce([reaches(bits.value[row], slots) for row, slots in enumerate(slots_of(terms, lang, width))])
                terms = [t for t, y in zip(terms, ok.tolist()) if y]
                columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([df[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "df"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in term_lists(text):
                    n.update(terms)
                    seen.update(terms)
                df.update(seen)
                if sum(len(d) for _, d in held.values()) > HELD:
                    yield from flush()
        yield from flush()

    partial = docs.mapInArrow(run, "lang string, source string, term string, n long, df long")
    counts = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    of = Window.partitionBy("lang", "term")  # a row for each source of the term
    whole = counts.select("lang", "source", "term", "n", F.sum("df").over(of).alias("df"), F.sum("n").over(of).alias("total"), (F.min("source").over(of) == F.col("source")).alias("first"))
    return whole.where(F.col("df") >= least).drop("df")


def share(count: str, whole: str) -> Column:
    """1 + floor(10**9 * count / whole) by long division, three digits at a time; count <= whole."""
    out, left = "0L", count
    for _ in range(3):
        out, left = f"({out} * 1000 + ({left}) * 1000 div ({whole}))", f"(({left}) * 1000 % ({whole}))"
    return F.expr(f"1 + {out}")


def gap(p: str, q: str) -> Column:
    """floor((p - q)**2 / q); p and q are at most 10**9 + 1."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})").cast("decimal(20,0)")


def pair_values(groups: DataFrame, scored: DataFrame) -> DataFrame:
    """lang, source, item (another source of lang), value: what all kept terms add."""
    a = groups.select("lang", "source", "held", "v", "p0")
    b = groups.select(F.col("lang").alias("b_lang"), F.col("source").alias("item"), F.col("held").alias("b_held"), F.col("p0").alias("q0"))
    both = a.join(b, (F.col("lang") == F.col("b_lang")) & (F.col("source") != F.col("item")))
    base = both.select("lang", "source", "item", F.when(F.col("v") > 0, (F.col("v") - F.col("held") - F.col("b_held")) * gap("p0", "q0")).otherwise(F.lit(0)).cast("decimal(38,0)").alias("value"))
    alike = scored.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"), F.first("p").alias("p"))  # terms of equal counts add the same where the other has none
    lacking = alike.join(b, (F.col("lang") == F.col("b_lang")) & (F.col("source") != F.col("item")))
    lacking = lacking.groupBy("lang", "source", "item").agg(*[F.sum(F.col("m") * f).cast("decimal(38,0)").alias(n) for n, f in (("there", gap("p", "q0")), ("back", gap("q0", "p")))])
    ways = lambda there, back: F.inline(F.array(F.struct("source", "item", F.col(there).alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col(back).alias("value"))))
    left = scored.select("lang", "term", "source", F.col("p"), F.col("p0"))
    right = scored.select(F.col("lang").alias("b_lang"), F.col("term").alias("b_term"), F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    shared = left.join(right, (F.col("lang") == F.col("b_lang")) & (F.col("term") == F.col("b_term")) & (F.col("source") < F.col("item")))
    there = gap("p", "q") - gap("p", "q0") - gap("p0", "q") + gap("p0", "q0")
    back = gap("q", "p") - gap("q0", "p") - gap("q", "p0") + gap("q0", "p0")
    shared = shared.groupBy("lang", "source", "item").agg(F.sum(there).cast("decimal(38,0)").alias("there"), F.sum(back).cast("decimal(38,0)").alias("back"))
    parts = base.unionByName(lacking.select("lang", ways("there", "back"))).unionByName(shared.select("lang", ways("there", "back")))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, most: int = MOST_TERMS) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank (from 1 in each source and part; terms up to most)."""
    rows = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = materialize(term_counts(rows, least), "terms")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("held"), F.sum(F.col("first").cast("long")).alias("firsts"))
    everywhere = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents")).join(sums, ["lang", "source"], "left").na.fill(0)
    langs = everywhere.groupBy("lang").agg(F.sum("occurrences").alias("lang_occurrences"), F.sum("firsts").alias("v"))
    p0 = F.when(F.col("v") > 0, share("1L", "greatest(1, occurrences + v)")).otherwise(F.lit(0))
    groups = materialize(everywhere.join(langs, "lang").withColumn("p0", p0.cast("long")), "groups")
    keyed = groups.select(F.struct("lang", "source").alias("_group"), "occurrences", "v", "lang_occurrences", "p0", "held")
    scored = join_by_key(counts.withColumn("_group", F.struct("lang", "source")), keyed, "_group", "held")
    scored = materialize(scored.select("lang", "source", "term", "n", "p0", share("n + 1", "occurrences + v").alias("p"), share("total + 1", "lang_occurrences + v").alias("q")), "shares")
    marking = scored.where("p > q").select("lang", "source", F.col("term").alias("item"), gap("p", "q").cast("long").alias("value"))
    order = [F.desc("value"), "item"]
    marking = marking.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))  # a source's best come from the best of its parts
    best = marking.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).where(F.col("rank") <= most)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    terms = best.drop("salt").withColumn("rank", place).where(F.col("rank") <= most).withColumn("part", F.lit("term"))
    pairs = pair_values(groups, scored).withColumn("rank", place).withColumn("part", F.lit("pair"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))

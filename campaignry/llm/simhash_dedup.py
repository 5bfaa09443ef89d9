"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits form a ring of three segments, and the radius of 2 is their budget. If two fingerprints differ
in at most 2 bits, then from some start on every chain of k consecutive segments differs in at most 2k/3 bits: none in
the first segment, at most 1 in the first two. Of two halves of the second segment one is then equal. So a head is a
start segment and half of the next one, three starts by two halves; fingerprints alone with all their heads are pruned
before any comparison. The full Hamming check follows (see hamming.linked_pairs).

Edge cases: a null text counts as an empty one; texts without words have fingerprint zero and are linked like any
other; a text of one or two words has one shingle, the whole sequence; very long texts are hashed in blocks; repeated
rows are in one component; a null doc_id is never a component's id unless no other is there (then it is null); rows of
one doc_id, null included, are in one component only if their texts are near; so unrelated components may show the same
component_id where ids repeat or are null, and one_of_each goes by the components, not by what they show; an empty table
gives an empty result; other columns are ignored by near_duplicates and kept by one_of_each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_by_key, materialize
from .hamming import components

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 14


def pigeonring_tables() -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """Bit ranges of head and tail, for each start segment and half of the next one."""
    out = []
    for i, first in enumerate(SEGMENTS):
        (at, n), last = SEGMENTS[(i + 1) % 3], SEGMENTS[(i + 2) % 3]
        halves = (at, n // 2), (at + n // 2, n - n // 2)
        out += [([first, halves[0]], [halves[1], last]), ([first, halves[1]], [halves[0], last])]
    return out


def simhash(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of a text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        hashes = [digest(b" ".join(found[i : i + words]), SEED) for i in range(at, min(at + AT_ONCE, n))]
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def identity(docs: DataFrame) -> tuple[Column, Column]:
    """A document's id and mark, the MD5 of its text (of a null one: no bytes)."""
    return docs["doc_id"].cast("long"), F.coalesce(F.unhex(F.md5(docs["text"])), F.lit(b""))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(id, mark, fp): identity and signed fingerprint of each document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = np.array([simhash(t.as_py(), words) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["id", "mark", "fp"])

    number, mark = identity(docs)
    return docs.select(number.alias("id"), mark.alias("mark"), "text").mapInArrow(run, "id long, mark binary, fp long")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id reachable over links of 2 bits or fewer."""
    fps = materialize(fingerprints(docs, words).drop("mark"), "simhash")
    of = materialize(components(fps, pigeonring_tables()), "components")
    both = join_by_key(fps, of, "fp", "rows")
    return both.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs without near-duplicates: of each component the document of the least doc_id (null last) and then the least MD5 stays, once.

    A chosen document that stands in docs once is found by a semi join alone; one that repeats goes through
    dropDuplicates too, which collapses its copies before they move.
    """
    fps = materialize(fingerprints(docs, words), "simhash")
    of = components(fps.select("id", "fp"), pigeonring_tables())
    copies = fps.groupBy("fp", "id", "mark").agg(F.count(F.lit(1)).alias("copies"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark", "copies")).alias("first")
    firsts = copies.groupBy("fp").agg(first).join(of, "fp").groupBy("root").agg(F.min("first").alias("first"))
    keep = materialize(firsts.select("first.id", "first.mark", "first.copies"), "kept")
    names = [free_name(docs, n) for n in ("_id", "_mark")]
    marked = docs.select("*", *[c.alias(n) for c, n in zip(identity(docs), names)])

    def chosen(which: str) -> DataFrame:
        of = materialize(keep.where(which), "chosen")
        return marked.join(of, [marked[n].eqNullSafe(of[k]) for n, k in zip(names, ("id", "mark"))], "left_semi")

    return chosen("copies = 1").union(chosen("copies > 1").dropDuplicates(names)).drop(*names)

"""Private terms in texts, however many terms: rolling hashes of anchors, joined with the terms, then verified.

A term's anchor is its first ANCHOR bytes or all of it. Each text is hashed at every byte for the lengths that anchors
have; a filter of fixed size drops what no term can begin with; what passes meets the terms on the hash by a shuffle, and
each pair of text and term that met is verified in the whole text. Terms are never broadcast, only the filter's bits.
Letters A to Z match in either case; matches of a term don't overlap.

Paths have rules of their own: addresses and home folders in them, and names of files that hold mail or data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..shared import kept

ANCHOR = 24
#: Bits of the filter.
FILTER_BITS = 1 << 24
BASE = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a text hashed at once; the next part begins so far back that no anchor is torn.
PART = 1 << 20
# Names of files that hold mail or data, and of files that somebody should look at.
SENSITIVE = {".eml": "raw_email_file", ".mbox": "mailbox_export", ".mbx": "mailbox_export", ".pst": "mailbox_export", ".ost": "mailbox_export", ".sqlite": "database_file", ".sqlite3": "database_file", ".db": "database_file"}
REVIEWABLE = (".gif", ".heic", ".jpeg", ".jpg", ".pdf", ".png", ".tif", ".tiff", ".webp")
HOME_PATH = r"(?i)(?:/users/|/home/|[a-z]:\\users\\)[a-z0-9._-]+"
RESERVED = r"(?i)@(?:localhost|example\.(?:com|org|net)|(?:[^@]*\.)?(?:example|invalid|test))$"


def window_hashes(data: bytes, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of the bytes from each position) for each length, by prefix sums of a polynomial modulo 2^64."""
    with np.errstate(over="ignore"):
        n = len(data)
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, BASE, np.uint64))), dtype=np.uint64)
        back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, INVERSE, np.uint64))), dtype=np.uint64)
        sums = np.concatenate(([np.uint64(0)], np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)))
        for length in lengths:
            if length <= n:
                h = (sums[length:] - sums[: n - length + 1]) * back[: n - length + 1]
                h = (h ^ np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15)
                yield length, h ^ (h >> np.uint64(29))


def anchor_hash(term: bytes) -> int:
    data = term[:ANCHOR]
    return int(next(window_hashes(data, [len(data)]))[1][0].astype(np.int64))


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def deny_terms(lines: DataFrame, number: str, line: str) -> DataFrame:
    """number, term, anchor, length of the lines that are terms: not blank, not begun by #. White space around them goes; null is blank."""
    term = F.regexp_replace(folded(F.col(line)), r"^\s+|\s+$", "")
    rows = lines.select(F.col(number).cast("long").alias("number"), term.alias("term")).where((F.col("term") != "") & ~F.startswith("term", F.lit("#")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([anchor_hash(t) for t in data], pa.int64()), pa.array([min(ANCHOR, len(t)) for t in data], pa.int32())], names=["number", "term", "anchor", "length"])

    return rows.mapInArrow(run, "number long, term string, anchor long, length int")


def denied(docs: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """key, number (of the term's line), matches, first_at (from 1) of each term in each text. terms: see deny_terms.

    Null texts hold nothing; equal terms of several lines match each; rows of equal or null keys are texts of their own.
    """
    spark = docs.sparkSession
    terms = kept(terms, "terms")
    lengths = sorted(r[0] for r in terms.select("length").distinct().collect())  # ANCHOR at most
    slots = terms.select(F.pmod("anchor", F.lit(FILTER_BITS)).alias("slot")).distinct().groupBy((F.col("slot") / 8).cast("int").alias("byte")).agg(F.sum(F.pow(F.lit(2), F.col("slot") % 8)).cast("int").alias("bits"))
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in slots.toLocalIterator():  # FILTER_BITS / 8 rows at most, whatever the terms
        table[r["byte"]] = r["bits"]
    known = spark.sparkContext.broadcast(table)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())

    def run(batches):
        import pyarrow as pa

        step = max(lengths, default=1) - 1
        for batch in batches:
            anchors, owners = [], []
            for i, t in enumerate(batch.column(1)):
                data, found = t.as_py().encode("utf-8", "surrogatepass").translate(FOLD), []
                for at in range(0, max(1, len(data)), PART):
                    for _, h in window_hashes(data[at : at + PART + step], lengths):
                        slot = (h.astype(np.int64) % FILTER_BITS).astype(np.int64)
                        found.append(h[(known.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1])
                mine = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
                if len(mine):
                    anchors.append(mine.astype(np.int64))
                    owners.append(i)
            if owners:
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(a) for a in anchors]))).astype(np.int32)), pa.array(np.concatenate(anchors)))
                kept_rows = batch.take(pa.array(owners))
                yield pa.RecordBatch.from_arrays([*kept_rows.columns, lists], names=["key", "text", "anchors"])

    schema = f"key {dict(docs.dtypes)[key]}, text string, anchors array<long>"
    hits = rows.mapInArrow(run, schema).select("key", "text", F.explode("anchors").alias("anchor"))  # only texts that pass the filter move
    low, term = folded(F.col("text")), F.col("term")
    met = hits.join(terms, "anchor").withColumn("low", low).where(F.contains("low", term))
    count = ((F.octet_length("low") - F.octet_length(F.replace("low", term, F.lit("")))) / F.octet_length(term)).cast("long")
    return met.select(F.col("key").alias(key), "number", count.alias("matches"), F.instr("low", term).cast("long").alias("first_at"))


def path_findings(files: DataFrame, path: str, digest: Column) -> DataFrame:
    """path, rule, match_hash: what a file's path alone gives away. A path that shows a person is given by its hash alone.

    digest is the hash that stands for the file's content. Files somebody should look at have the rule `review`.
    """
    where, short = F.col(path), lambda c: F.left(F.sha2(c, 256), F.lit(16))
    name = F.substring_index(F.substring_index(where, "/", -1), "\\", -1)
    suffix = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for s, rule in SENSITIVE.items() for x in (s, rule)])
    found = lambda pattern: F.regexp_extract_all(where, F.lit(f"({pattern})"), 1)
    mail = F.transform(found(R.EMAIL.removeprefix("(?i)") if not R.EMAIL.startswith("(?i)") else f"(?i:{R.EMAIL[4:]})"), lambda m: F.struct(F.when(m.rlike(RESERVED), "synthetic_email_address").otherwise("email_address_in_path").alias("rule"), short(m).alias("match_hash")))
    home = F.transform(found(f"(?i:{HOME_PATH[4:]})"), lambda m: F.struct(F.lit("absolute_home_path_in_path").alias("rule"), short(m).alias("match_hash")))
    whole = lambda condition, rule: F.when(condition, F.struct(rule.alias("rule"), F.left(digest, F.lit(16)).alias("match_hash")))
    others = F.array_compact(F.array(whole(name == ".gitmodules", F.lit("submodule_manifest")), whole(kinds[suffix].isNotNull(), kinds[suffix]), whole(suffix.isin(*REVIEWABLE), F.lit("review"))))
    shown = F.when((F.size(mail) > 0) | (F.size(home) > 0), F.concat(F.lit("<redacted-path:"), short(where), F.lit(">"))).otherwise(where)
    return files.where(where.isNotNull()).select(shown.alias("path"), F.inline(F.concat(mail, home, others)))

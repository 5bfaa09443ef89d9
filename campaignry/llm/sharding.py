"""Jump consistent hashing of stable keys to shards.

The published loop draws from a 64-bit linear congruential generator; here it is one SQL expression, so a row's shard
depends on its key and the number of shards alone. With one shard more, a row keeps its shard or goes to the new one.

Edge cases: a null doc_id is a key like any other (all such rows share a shard); a null text counts as an empty one;
repeated rows share a shard and have slots of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, text_or_empty

#: Multiplier of the generator (a fixed value of the published algorithm).
MULTIPLIER = 2862933555777941757
MASK = 0xFFFFFFFF
#: Jumps grow as the logarithm of the shards; the expression raises an error rather than stop short.
MOST_JUMPS = 500
#: Each shard's rows are numbered in so many parts, dealt by doc_id and text, so rows of one doc_id (null, say) spread as well.
SLOT_PARTS = 64


def _low_product(x: str, c: int) -> str:
    """Lower 32 bits of x * c for x and c below 2**32; no step passes 63 bits, which ANSI arithmetic would reject."""
    return f"((({x} & 65535L) * {c}L + shiftleft((shiftright({x}, 16) * {c}L) & 65535L, 16)) & {MASK}L)"


def _next_state(k: str) -> str:
    """k * MULTIPLIER + 1 modulo 2**64, from halves."""
    high, low = MULTIPLIER >> 32, MULTIPLIER & MASK
    a, b = f"shiftrightunsigned({k}, 32)", f"({k} & {MASK}L)"
    upper = f"(shiftright({b}, 16) * {low}L)"
    lower = f"(({b} & 65535L) * {low}L + shiftleft({upper} & 65535L, 16) + 1L)"
    carry = f"(shiftright({lower}, 32) + shiftright({upper}, 16))"
    return f"(shiftleft(({carry} + {_low_product(a, low)} + {_low_product(b, high)}) & {MASK}L, 32) | ({lower} & {MASK}L))"


def jump_shard(key: str, shards: int) -> Column:
    """The shard in 0..shards-1 of the 64-bit integer expression key (SQL text, not null)."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    step = f"transform(array({_next_state('s.k')}), k -> named_struct('k', k, 'b', s.j, 'j', cast(floor((s.j + 1) * (2147483648D / (shiftrightunsigned(k, 33) + 1))) as bigint)))[0]"
    return F.expr(
        f"aggregate(sequence(1, {min(shards, MOST_JUMPS)}), named_struct('k', {key}, 'b', -1L, 'j', 0L), "
        f"(s, i) -> if(s.j >= {shards}, s, {step}), "
        f"s -> cast(if(s.j < {shards}, raise_error('too many jumps'), s.b) as int))"
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 8), text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (with one shard more)."""
    text = text_or_empty(docs)
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64("doc_id").alias("_key"))
    rows = rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), jump_shard("_key", shards).alias("shard"), jump_shard("_key", shards + 1).alias("grown_shard"), F.pmod(F.xxhash64("_key", "size", "text_crc32"), F.lit(SLOT_PARTS)).cast("int").alias("_part"))
    rows = numbered(rows, ["shard"], "_part", [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "slot")
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Write whole documents into one folder for each shard; a large shard is many files."""
    docs.withColumn("shard", jump_shard("xxhash64(doc_id)", shards)).write.partitionBy("shard").parquet(path)

"""Chat formatting with cumulative-snapshot collapse.

A chat log often holds one conversation several times, each a longer snapshot. Every turn has a hash of its place, role
and text; the exclusive-or of the first k of them is the hash of the first k turns. A conversation whose whole hash is
the hash of a proper prefix of another one goes (anti-join); of equal conversations the least conv_id stays. The rest
is rendered with turn markers.

Edge cases: turns are ordered by (turn, role, text), nulls first, and a null role or text counts as an empty one; a
null conv_id is one conversation; repeated rows are turns of their own; an empty table gives an empty result; other
columns are ignored. A conversation of any length is numbered by ranges, hashed in segments, and rendered in parts of at most
turns_a_part turns, so none is gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered_by_range

SEGMENT = 512
OPEN, CLOSE = "<|turn_start|>", "<|turn_end|>"
HASHES = ("h1", "h2")


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 16), 16, -10).cast("long")


def hashed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, at (from 0), role, text, segment, h1 and h2 (128 bits of place, role and text)."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = numbered_by_range(rows, ["conv_id"], ["turn", "role", "text"], "at")
    digest = F.md5(F.concat(F.col("at").cast("string"), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    return rows.select("conv_id", "at", "role", "text", F.floor(F.col("at") / SEGMENT).alias("segment"), digest.alias("_d")).select("conv_id", "at", "role", "text", "segment", _half(F.col("_d"), 1).alias("h1"), _half(F.col("_d"), 17).alias("h2"))


def prefix_hashes(hashed: DataFrame) -> DataFrame:
    """conv_id, n (turns of the prefix), h1, h2 for every prefix of every conversation."""
    totals = hashed.groupBy("conv_id", "segment").agg(*[F.bit_xor(h).alias(f"_{h}") for h in HASHES])
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("conv_id").alias("_conv"), F.col("segment").alias("_segment"), *[F.coalesce(F.bit_xor(f"_{h}").over(before), F.lit(0)).alias(f"_{h}") for h in HASHES])
    within = Window.partitionBy("conv_id", "segment").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = hashed.select("conv_id", "segment", (F.col("at") + 1).alias("n"), *[F.bit_xor(h).over(within).alias(h) for h in HASHES])
    joined = rolled.join(carried, rolled["conv_id"].eqNullSafe(carried["_conv"]) & rolled["segment"].eqNullSafe(carried["_segment"]))
    return joined.select("conv_id", "n", *[F.col(h).bitwiseXOR(F.col(f"_{h}")).alias(h) for h in HASHES])


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_same: the conversations that stay, with the number of equal ones."""
    whole = hashed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(h).alias(h) for h in HASHES])
    last = whole.select(F.col("conv_id").alias("_conv"), F.col("n").alias("_n"))
    prefixes = prefix_hashes(hashed)
    proper = prefixes.join(last, prefixes["conv_id"].eqNullSafe(last["_conv"]) & (prefixes["n"] < last["_n"])).select("n", *HASHES).distinct()
    kinds = whole.groupBy("n", *HASHES).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_same"))
    return kinds.join(proper, ["n", *HASHES], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_same")


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn between markers; a marker inside a role or text loses its first bar."""
    plain = [F.replace(x, F.lit("<|turn_"), F.lit("<turn_")) for x in (role, text)]
    return F.concat(F.lit(OPEN), plain[0], F.lit("\n"), plain[1], F.lit(CLOSE + "\n"))


def format_conversations(turns: DataFrame, turns_a_part: int = 1024) -> DataFrame:
    """conv_id, part (from 0), n_turns (of the conversation), n_same, rendered."""
    hashed = materialize(hashed_turns(turns), "turns")
    kept = maximal_conversations(hashed).withColumnRenamed("conv_id", "_conv")
    parts = hashed.join(kept, hashed["conv_id"].eqNullSafe(kept["_conv"])).select("conv_id", "n_turns", "n_same", F.floor(F.col("at") / turns_a_part).alias("part"), F.struct("at", rendered_turn(F.col("role"), F.col("text")).alias("said")).alias("turn"))
    whole = parts.groupBy("conv_id", "part", "n_turns", "n_same").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return whole.select("conv_id", "part", "n_turns", "n_same", F.array_join("turns.said", "").alias("rendered"))

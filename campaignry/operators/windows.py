"""Leader windows: a time leads if it is more than a span after its key's last leader.

Which times lead depends on the ones before, but the leader that would follow any time does not. So each time points to
the first one beyond its span, and those that lead are what the beginnings of runs reach, where a run ends at a gap of more than a span:
pointers are doubled until none is left, in as many rounds as the logarithm of the leaders of a run. Times are cut into
slots of one span, so no key is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import discard, kept


def followers(points: DataFrame, span: int) -> DataFrame:
    """key, at, next of distinct points (key, at): the first time of the key more than span later, where there is one."""
    slotted = points.select("key", "at", F.floor(F.col("at") / span).alias("slot"))
    by_slot = Window.partitionBy("key").orderBy("slot")  # a row for each slot of a key
    ahead = slotted.groupBy("key", "slot").agg(F.min("at").alias("first"))
    beyond = F.when(F.lead("slot", 1).over(by_slot) > F.col("slot") + 1, F.lead("first", 1).over(by_slot)).otherwise(F.lead("first", 2).over(by_slot))
    ahead = ahead.select("key", "slot", beyond.alias("beyond"))
    asks = slotted.select("key", F.col("slot") + 1, F.col("at") + span, F.lit(1))
    both = slotted.select("key", "slot", F.col("at").alias("time"), F.lit(0).alias("asks")).union(asks)
    later = Window.partitionBy("key", "slot").orderBy(F.desc("time"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("next", F.last(F.when(F.col("asks") == 0, F.col("time")), ignorenulls=True).over(later)).where("asks = 1")
    found = found.select("key", (F.col("time") - span).alias("at"), (F.col("slot") - 1).alias("slot"), "next")
    return found.join(ahead, ["key", "slot"]).select("key", "at", F.coalesce("next", "beyond").alias("next")).where("next IS NOT NULL")


def marked(points: DataFrame, span: int) -> DataFrame:
    """key, at, slot, starts of distinct points: a point more than span after the one before it leads, whatever came earlier."""
    slotted = points.select("key", "at", F.floor(F.col("at") / span).alias("slot"))
    before = slotted.groupBy("key", (F.col("slot") + 1).alias("slot")).agg(F.max("at").alias("last"))  # two slots earlier is too far anyway
    inside = slotted.withColumn("prev", F.lag("at").over(Window.partitionBy("key", "slot").orderBy("at"))).join(before, ["key", "slot"], "left")
    prev = F.coalesce("prev", "last")
    return inside.select("key", "at", "slot", (prev.isNull() | (F.col("at") - prev > span)).alias("starts"))


def led_by(points: DataFrame, heads: DataFrame, span: int) -> DataFrame:
    """points (key, at, slot) with leader, the last of heads (key, at) in the slot of a point or the one before it, not after the point; else null."""
    at = F.floor(F.col("at") / span)
    led = heads.select("key", "at", F.col("at").alias("leader"), F.explode(F.array(at, at + 1)).alias("slot"))
    both = points.select("key", "slot", "at", F.lit(None).cast("long").alias("leader")).unionByName(led)
    last = Window.partitionBy("key", "slot").orderBy("at", F.col("leader").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("of", F.last("leader", ignorenulls=True).over(last)).where("leader IS NULL").select("key", "slot", "at", F.col("of").alias("leader"))


def leaders(points: DataFrame, span: int) -> DataFrame:
    """key, at, leader of distinct points (key, at), longs: the time that leads the window in which the point lies.

    Most points lie within a span of a start, which leads them. Only the others, which are led by one another, go through
    pointers: from them, and from starts that have such a point within two slots, as the next leader of a run is never
    more than two spans later.
    """
    known = marked(points, span)
    known = kept(led_by(known, known.where("starts").select("key", "at"), span), "points")
    near = F.coalesce(F.col("at") - F.col("leader") <= span, F.lit(False))
    far = known.where(~near).select("key", "at", "slot")
    if far.isEmpty():
        return known.select("key", "at", "leader")
    behind = far.select("key", F.explode(F.array(F.col("slot") - 1, F.col("slot") - 2)).alias("slot")).distinct()
    starts = kept(known.where("at = leader").select("key", "at", "slot").join(behind, ["key", "slot"], "left_semi").select("key", "at"), "starts")
    nexts = followers(far.select("key", "at").union(starts), span).where(F.col("next") - F.col("at") <= 2 * span)
    jump = kept(nexts.join(starts.select("key", F.col("at").alias("next")), ["key", "next"], "left_anti").select("key", "at", "next"), "jumps")
    reached = starts
    while True:
        more = kept(reached.join(jump, ["key", "at"]).select("key", F.col("next").alias("at")), "leaders")
        if more.isEmpty():
            break
        reached = kept(reached.union(more), "leaders")
        twice = jump.join(jump.select("key", F.col("at").alias("next"), F.col("next").alias("beyond")), ["key", "next"]).select("key", "at", F.col("beyond").alias("next"))
        jump, old = kept(twice, "jumps"), jump
        discard(old)
    chained = led_by(far, reached.join(starts, ["key", "at"], "left_anti"), span)
    return known.where(near).select("key", "at", "leader").union(chained.select("key", "at", "leader"))

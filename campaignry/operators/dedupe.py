"""Collapsing of delivery variants: exact keys, and leader windows on a key and time."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import CAMPAIGN_DAYS, CONTENT_DAYS
from ..shared import kept
from . import windows

DAY = 86_400_000_000


def first_of(df: DataFrame, *keys: str) -> DataFrame:
    """The earliest row of each key; rows that lack the key stay, and none of them moves."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("received", "id"))
    lacking = reduce(or_, [F.col(k).isNull() for k in keys])
    return df.where(~lacking).withColumn("_at", at).where("_at = 1").drop("_at").unionByName(df.where(lacking))


def leaders(df: DataFrame, keys: list[str], days: int) -> DataFrame:
    """keys (brand in lower case), leader (time), variants: a row leads if it is more than days after its key's last leader."""
    brand = [F.lower(k).alias(k) if k == "brand" else F.col(k) for k in keys]
    counted = df.select(*brand, F.unix_micros("received_at").alias("at")).groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("n"))
    rows = kept(counted.withColumn("key", F.unhex(F.md5(F.to_json(F.struct(*keys))))), "counted")
    led = windows.leaders(rows.select("key", "at"), days * DAY)
    return rows.join(led, ["key", "at"]).groupBy(*keys, "leader").agg(F.sum("n").alias("variants")).withColumn("leader", F.timestamp_micros("leader"))


def by_content(df: DataFrame) -> DataFrame:
    return leaders(df, ["brand", "content_hash"], CONTENT_DAYS)


def by_campaign(df: DataFrame) -> DataFrame:
    return leaders(df, ["brand", "campaign_id"], CAMPAIGN_DAYS)


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Messages in, distinct and collapsed."""
    return before.agg(F.count(F.lit(1)).alias("input")).join(after.agg(F.count(F.lit(1)).alias("distinct"))).select("input", "distinct", (F.col("input") - F.col("distinct")).alias("collapsed"))

"""Creative gallery: the newest distinct items of each brand, and what state a brand is in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import GALLERY_KEPT, GALLERY_READY


def newest_items(items: DataFrame, kept: int = GALLERY_KEPT) -> DataFrame:
    """The kept newest items of each brand by date and path, descending, one for each sha256; Spark cuts each partition to kept before the shuffle."""
    once = items.groupBy("brand", "sha256").agg(F.max_by(F.struct("date", "path", "bytes"), F.struct("date", "path")).alias("it")).select("brand", "sha256", "it.*")
    place = F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("date"), F.desc("path")))
    return once.withColumn("place", place).where(F.col("place") <= kept)


def brand_states(items: DataFrame, brands: DataFrame) -> DataFrame:
    """brand, shown and state of every brand: ready from three items, insufficient from one, else unavailable."""
    shown = newest_items(items).groupBy(F.lower(F.trim("brand")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    state = F.when(n >= GALLERY_READY, "ready").when(n > 0, "insufficient").otherwise("unavailable")
    return brands.select("brand").distinct().join(shown, F.lower(F.trim("brand")) == F.col("key"), "left").select("brand", n.alias("shown"), state.alias("state"))


def accounting(runs: DataFrame) -> DataFrame:
    """brand and balanced: every requested item was processed and rendered, skipped or failed, and none is pending."""
    sums = runs.groupBy("brand").agg(*[F.sum(c).alias(c) for c in ("requested", "rendered", "skipped", "failed", "pending")])
    return sums.select("brand", "requested", "rendered", "skipped", "failed", "pending", ((F.col("requested") == F.col("rendered") + F.col("skipped") + F.col("failed")) & (F.col("pending") == 0)).alias("balanced"))

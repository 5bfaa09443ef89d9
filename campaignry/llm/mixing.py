"""Mixing of sources to target weights by Poisson replication.

Each document is repeated a number of times that follows a Poisson distribution whose mean is its source's repetition
rate (target rows over rows there). The number comes from a hash of seed, doc_id and text by inversion, so any run, on
any partitioning, makes the same choice. Copies are then shuffled globally by a hash of the same, so rows of one doc_id
spread.

Edge cases: a null source is a source like any other; a source without a target weight (or with 0) goes; rows with
equal doc_id and equal text (a null one counts as an empty one) get equal numbers; null,
empty and very long texts are kept as they are; an empty table gives an empty result; columns with any other names pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: A mean above this is drawn as a sum of so many equal Poisson parts that none is above it.
PART_MEAN = 16.0
#: Values of a part's cumulative distribution; beyond it lies less than 1e-25.
TERMS = 96
#: The table of rates is broadcast only up to so many sources (under 10 MB).
BROADCAST_SOURCES = 10_000


def poisson_cdf(mean: Column) -> Column:
    """Array of P(X <= k), k from 0 to TERMS - 1."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)), start,
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.array_append(s["c"], F.element_at(s["c"], -1) + s["p"] * mean / k).alias("c")),
        lambda s: s["c"],
    )


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of seed and parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def repetition_rates(docs: DataFrame, targets: dict[str, float] | None, temperature: float, total_rows: int | None) -> tuple[DataFrame, int]:
    """(source, rate), and the number of sources. Without targets a source's weight is its rows to the power temperature."""
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        if any(w < 0 for w in targets.values()):
            raise ValueError("weights must not be negative")
        wanted = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in targets.items()], "wanted string, weight double")
        sizes = sizes.join(wanted, sizes["source"].eqNullSafe(wanted["wanted"]), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sources, rows, weights = sizes.agg(F.count(F.lit(1)), F.sum("n"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(weights or 1.0)
    return sizes.select("source", (share * F.lit(float(total_rows if total_rows is not None else rows or 0)) / F.col("n")).alias("rate")), sources


def poisson_mix(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = 0.5, total_rows: int | None = None, seed: int = 42, copy_column: str | None = None) -> DataFrame:
    """The documents, each repeated by its Poisson number, in a global hash order. copy_column, if given, numbers a document's copies from 1."""
    rates, sources = repetition_rates(docs, targets, temperature, total_rows)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN).cast("int"))
    rates = rates.select(F.struct("source").alias("_of"), F.struct(parts.alias("parts"), poisson_cdf(F.col("rate") / parts).alias("cdf")).alias("_draw"))
    rates = F.broadcast(rates) if sources <= BROADCAST_SOURCES else rates
    copy, place, key = (free_name(docs, n) for n in (copy_column or "_copy", "_place", "_key"))
    keyed = docs.withColumn(key, F.concat_ws("|", docs["doc_id"].cast("string"), F.md5(F.coalesce(docs["text"], F.lit("")))))  # below the join, so once a row
    draws = F.transform(F.sequence(F.lit(1), rates["_draw.parts"]), lambda i: uniform(seed, keyed[key], i))  # outside the search of the table, so once a part
    number = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(rates["_draw.cdf"], lambda c: c <= u)))
    repeated = keyed.join(rates, keyed["source"].eqNullSafe(rates["_of.source"])).select(*[keyed[c] for c in docs.columns], number.alias(copy)).where(F.col(copy) > 0)
    repeated = repeated.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
    repeated = repeated.withColumn(place, F.xxhash64(F.lit(seed), "doc_id", "text", copy))
    mixed = repeated.repartitionByRange(F.col(place)).sortWithinPartitions(place, "doc_id", copy)
    return mixed.drop(place) if copy_column else mixed.drop(place, copy)

"""Aggregates of the census: scopes, quadrants, brands, gates, posture, coverage, cross-foot checks, findings, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import coverage_level


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def spine(df: DataFrame, name: str, values: tuple) -> DataFrame:
    """One row for each value, in order, for left joins that keep zeros."""
    return df.sparkSession.createDataFrame(list(enumerate(values)), f"place int, {name} string")


def broadcasts(df: DataFrame) -> DataFrame:
    return df.where(F.col("scope") == "broadcast")


def scope_counts(df: DataFrame) -> DataFrame:
    return spine(df, "scope", R.SCOPES).join(df.groupBy("scope").agg(F.count(F.lit(1)).alias("n")), "scope", "left").select("scope", F.coalesce("n", F.lit(0)).alias("messages"))


def quadrant_census(df: DataFrame) -> DataFrame:
    """Count and share of all four quadrants among broadcasts."""
    counts = spine(df, "quadrant", R.QUADRANTS).join(broadcasts(df).groupBy("quadrant").agg(F.count(F.lit(1)).alias("n")), "quadrant", "left")
    n = F.coalesce("n", F.lit(0))
    total = F.sum(n).over(Window.partitionBy())
    return counts.select("quadrant", n.alias("messages"), F.when(total > 0, n * 100.0 / total).otherwise(0.0).alias("percent"))


def monthly_counts(df: DataFrame) -> DataFrame:
    return broadcasts(df).groupBy(F.coalesce(F.date_format("observed", "yyyy-MM"), F.lit("Unknown receipt date")).alias("month")).agg(F.count(F.lit(1)).alias("messages"))


def grouped_counts(df: DataFrame, column: str) -> DataFrame:
    return broadcasts(df).groupBy(column).agg(F.count(F.lit(1)).alias("messages"))


def observed_window(df: DataFrame) -> DataFrame:
    rows = broadcasts(df)
    return rows.agg(F.min("observed").alias("first_observed"), F.max("observed").alias("last_observed"), (F.datediff(F.max("observed"), F.min("observed")) + 1).cast("long").alias("observed_days"), F.count("observed").alias("trusted"), count_if(F.col("observed").isNull()).alias("untrusted"))


def brand_rollup(df: DataFrame) -> DataFrame:
    """Counts, trusted window and offers of each brand."""
    sent = F.col("scope") == "broadcast"
    day = F.when(sent, F.col("observed"))
    days = F.coalesce(F.datediff(F.max(day), F.min(day)) + 1, F.lit(0)).cast("long")
    rows = df.groupBy("brand").agg(
        F.count(F.lit(1)).alias("distinct_messages"), *[count_if(F.col("scope") == s).alias(s) for s in R.SCOPES], F.min(day).alias("first_observed"), F.max(day).alias("last_observed"), days.alias("observed_days"),
        F.countDistinct(F.date_format(day, "yyyy-MM")).alias("months"), count_if(sent & F.col("offer")).alias("offers"), count_if(sent & F.col("depth").isNotNull()).alias("numeric_offers"), F.median(F.when(sent, F.col("depth"))).alias("median_depth"),
    )
    hook = (F.col("broadcast") >= R.POSTURE_MESSAGES) & (F.col("observed_days") >= R.POSTURE_DAYS)
    return rows.withColumns({"observed_weeks": F.ceil(F.col("observed_days") / 7).cast("long"), "coverage": coverage_level(F.col("observed_days")), "hook_eligible": hook, "seasonal_eligible": (F.col("observed_days") >= R.SEASONAL_DAYS) & (F.col("broadcast") > 0)})


def brand_pivot(df: DataFrame, column: str, values: tuple) -> DataFrame:
    return broadcasts(df).groupBy("brand").agg(*[count_if(F.col(column) == v).alias(v.lower().replace(" ", "_").replace("/", "_").replace("-", "_")) for v in values])


def brand_posture(df: DataFrame) -> DataFrame:
    """Leading intent of each brand with 30 broadcasts and 90 days or more, by its share and its lead."""
    counts = broadcasts(df).groupBy("brand", "intent").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("brand").orderBy(F.desc("n"), "intent")
    ranked = counts.select("brand", "intent", "n", F.row_number().over(order).alias("at"), F.sum("n").over(Window.partitionBy("brand")).alias("total"))
    top = ranked.where("at <= 2").groupBy("brand").agg(F.max(F.when(F.col("at") == 1, F.col("intent"))).alias("leader"), F.max(F.when(F.col("at") == 1, F.col("n"))).alias("first"), F.coalesce(F.max(F.when(F.col("at") == 2, F.col("n"))), F.lit(0)).alias("second"), F.max("total").alias("total"))
    gated = brand_rollup(df).select("brand", "hook_eligible").join(top, "brand", "left")
    leads = (F.col("first") / F.col("total") >= R.POSTURE_SHARE) & ((F.col("second") == 0) | (F.col("first") >= R.POSTURE_LEAD * F.col("second")))
    labels = F.element_at(F.create_map(*[F.lit(x) for kv in R.POSTURE_LABELS.items() for x in kv]), F.col("leader"))
    ok = F.col("hook_eligible")
    return gated.select("brand", F.when(~ok, "Insufficient history").when(leads, labels).otherwise("Mixed").alias("posture"), F.when(ok, F.col("leader")).otherwise("").alias("leading_intent"), F.when(ok, F.col("first") / F.col("total")).otherwise(0.0).alias("share"), F.when(ok, F.col("second") / F.col("total")).otherwise(0.0).alias("runner_up_share"))


def seasonal_broadcasts(df: DataFrame) -> DataFrame:
    """Broadcasts of brands observed for 330 days or more."""
    return broadcasts(df).join(brand_rollup(df).where("seasonal_eligible").select("brand"), "brand", "left_semi")


def occasion_counts(df: DataFrame) -> DataFrame:
    return seasonal_broadcasts(df).where("occasion IS NOT NULL").groupBy("occasion").agg(F.count(F.lit(1)).alias("messages"))


def seasonal_planner(df: DataFrame) -> DataFrame:
    return brand_rollup(df).agg(count_if(F.col("seasonal_eligible")).alias("eligible_brands"), F.count(F.lit(1)).alias("brands"), F.coalesce(F.sum(F.when(F.col("seasonal_eligible"), F.col("broadcast"))), F.lit(0)).alias("eligible_messages"))


def early_gate(df: DataFrame) -> DataFrame:
    """Enough broadcasts in all, and a brand with enough over enough days; else the brand that comes closest."""
    near = F.least(F.col("broadcast") / R.GATE_BRAND, F.col("observed_days") / R.GATE_DAYS)
    brands = brand_rollup(df).select("brand", "broadcast", "observed_days", near.alias("near"))
    totals = brands.agg(F.sum("broadcast").alias("total"), F.bool_or((F.col("broadcast") >= R.GATE_BRAND) & (F.col("observed_days") >= R.GATE_DAYS)).alias("brand_ok"), F.min_by("brand", F.struct(-F.col("near"), F.lower("brand"))).alias("closest_brand"))
    return totals.select("total", "brand_ok", ((F.col("total") >= R.GATE_TOTAL) & F.col("brand_ok")).alias("passed"), "closest_brand")


def coverage_table(df: DataFrame) -> DataFrame:
    """Counts and days of each brand and, by rollup, of all (brand TOTAL); a group without broadcasts takes the dates of all its messages."""
    sent = F.col("scope") == "broadcast"
    day = lambda f: F.when(count_if(sent) > 0, f(F.when(sent, F.col("observed")))).otherwise(f("observed"))
    rows = df.rollup("brand").agg(F.grouping("brand").alias("total"), F.count(F.lit(1)).alias("messages"), *[count_if(F.col("scope") == s).alias(s) for s in R.SCOPES], count_if(sent & F.col("quadrant").isNull()).alias("unclassified"), day(F.min).alias("first_day"), day(F.max).alias("last_day"), *[count_if(sent & (F.col("quadrant") == q)).alias(q.lower().replace(" ", "_")) for q in R.QUADRANTS])
    days = F.coalesce(F.datediff("last_day", "first_day") + 1, F.lit(0)).cast("long")
    gate = F.when(F.col("total") == 1, "summary").when((F.col("broadcast") >= 30) & (days >= 90), "eligible").when((F.col("broadcast") >= 15) & (days >= 45), "within_50_percent").otherwise("insufficient")
    return rows.select(F.when(F.col("total") == 1, "TOTAL").otherwise(F.col("brand")).alias("brand"), "messages", *R.SCOPES, "unclassified", "first_day", "last_day", days.alias("observed_days"), gate.alias("hook_gate"), *[q.lower().replace(" ", "_") for q in R.QUADRANTS])


def cross_foot(df: DataFrame) -> DataFrame:
    """name, left_side, right_side and passed of the equations that a report's numbers must meet.

    Each side is summed on its own way through the data: messages, scopes, quadrants, brands, months with a trusted
    date, distinct messages, brands of the seasonal planner. Those of failures, of distinct messages and of months hold
    only where every message is trusted and once there.
    """
    sent = F.col("scope") == "broadcast"
    one = df.agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("observed").isNull()).alias("failed"), F.count("observed").alias("trusted"), F.count_distinct("message_id").alias("kept"), count_if(sent).alias("sent"),
        count_if(F.col("scope").isin(*R.SCOPES)).alias("scoped"), count_if(sent & F.col("quadrant").isin(*R.QUADRANTS)).alias("quadrants"), count_if(sent & F.col("observed").isNotNull()).alias("monthly"),
        count_if(sent & F.col("offer")).alias("offers"), count_if(sent & F.col("seasonal")).alias("seasonal"), count_if(sent & F.col("quadrant").isin(*R.QUADRANTS[1:3])).alias("q_offers"), count_if(sent & F.col("quadrant").isin(*R.QUADRANTS[2:])).alias("q_seasonal"),
    )
    brands = brand_rollup(df).agg(F.sum("broadcast").alias("brand_sum"), count_if(F.col("seasonal_eligible")).alias("eligible"), F.count_distinct(F.when(F.col("seasonal_eligible"), F.col("brand"))).alias("eligible_names"), F.coalesce(F.sum(F.when(F.col("seasonal_eligible"), F.col("broadcast"))), F.lit(0)).alias("planned"))
    planned = seasonal_broadcasts(df).agg(F.count(F.lit(1)).alias("plan_rows"), F.count("occasion").alias("occasions"))
    sides = {
        "raw_equals_failures_plus_parsed": ("n", "failed + trusted"), "parsed_equals_collapsed_plus_distinct": ("n", "kept"), "distinct_equals_scopes": ("n", "scoped"),
        "broadcast_equals_quadrants": ("sent", "quadrants"), "brand_broadcasts_equal_global": ("sent", "brand_sum"), "monthly_broadcasts_equal_global": ("sent", "monthly"),
        "promotion_axes_reconcile": ("offers", "q_offers"), "seasonal_axes_reconcile": ("seasonal", "q_seasonal"), "seasonal_planner_brand_count_matches": ("eligible", "eligible_names"),
        "seasonal_planner_messages_equal_eligible_brands": ("planned", "plan_rows"), "seasonal_occasions_within_eligible_messages": ("occasions", "planned"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.expr(a).cast("long").alias("left_side"), F.expr(b).cast("long").alias("right_side")) for k, (a, b) in sides.items()])
    within = F.col("name").startswith("seasonal_occasions") & (F.col("left_side") <= F.col("right_side"))
    joined = one.withColumn("_one", F.lit(1)).join(brands.withColumn("_one", F.lit(1)), "_one").join(planned.withColumn("_one", F.lit(1)), "_one")  # a row each
    return joined.select(F.inline(rows)).withColumn("passed", within | (F.col("left_side") == F.col("right_side")))


def findings(df: DataFrame) -> DataFrame:
    """Five ratios with numerator and denominator."""
    q = broadcasts(df).agg(F.count(F.lit(1)).alias("n"), *[count_if(F.col("quadrant") == x).alias(f"q{i}") for i, x in enumerate(R.QUADRANTS)]).select(F.inline(F.expr("array(struct('Evergreen content share' AS label, q0 AS numerator, n AS denominator), struct('Promotion share' AS label, q1 + q2 AS numerator, n AS denominator), struct('Seasonal share' AS label, q2 + q3 AS numerator, n AS denominator), struct('Seasonal messages carrying an offer' AS label, q2 AS numerator, q2 + q3 AS denominator))")))
    b = brand_rollup(df).agg(F.lit("Brands with cadence and mix coverage").alias("label"), count_if(F.col("hook_eligible")).alias("numerator"), F.count(F.lit(1)).alias("denominator"))
    return q.unionByName(b).withColumn("share", F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator")).otherwise(0.0))


def weekly_activity(df: DataFrame) -> DataFrame:
    """52 planning buckets of nearly equal length from the first to the last day, with a heat level from 0 to 4."""
    rows = broadcasts(df).withColumn("received", F.coalesce("received", F.raise_error(F.lit("a broadcast without a date")).cast("date")))
    ends = rows.agg(F.min("received").alias("first"), F.max("received").alias("last")).withColumn("span", F.datediff("last", "first") + 1)
    counted = rows.join(F.broadcast(ends)).groupBy(F.expr(f"least({R.BUCKETS - 1}, (datediff(received, first) * {R.BUCKETS}) div span)").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    buckets = ends.select("first", "last", "span", F.explode(F.expr(f"sequence(0L, {R.BUCKETS - 1}L)")).alias("bucket"))
    start = F.expr(f"date_add(first, cast((bucket * span) div {R.BUCKETS} AS int))")
    end = F.expr(f"least(last, date_add(first, cast(greatest((bucket * span) div {R.BUCKETS}, ((bucket + 1) * span) div {R.BUCKETS} - 1) AS int)))")
    out = buckets.join(counted, "bucket", "left").select("bucket", start.alias("start_day"), end.alias("end_day"), F.coalesce("n", F.lit(0)).alias("messages"))
    most = F.max("messages").over(Window.partitionBy())
    return out.withColumn("level", F.when(F.col("messages") == 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(4), F.ceil(F.col("messages") * 4 / most)))).cast("int"))


#: The columns of a message that a report may show.
LIBRARY = ("id", "brand", "observed", "subject", "quadrant", "intent", "coalesce(occasion, '') AS occasion", "coalesce(primary.type, '') AS offer_type", "scope_evidence.reason AS scope_reason")


def latest(df: DataFrame, n: int = 6) -> DataFrame:
    """The n newest messages of each scope, by day, brand and id, all descending."""
    order = Window.partitionBy("scope").orderBy(F.desc_nulls_last("observed"), F.desc("brand"), F.desc("id"))
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).selectExpr("scope", "place", *LIBRARY)


def quadrant_table(df: DataFrame) -> DataFrame:
    """Count, share and trusted dates of each quadrant among broadcasts, and of all of them (Total), from one grouping."""
    rows = broadcasts(df).rollup("quadrant").agg(F.grouping("quadrant").alias("total"), F.count(F.lit(1)).alias("messages"), F.min("observed").alias("first_day"), F.max("observed").alias("last_day"))
    rows = rows.select(F.when(F.col("total") == 1, "Total").otherwise(F.col("quadrant")).alias("quadrant"), "messages", "first_day", "last_day")
    counted = spine(df, "quadrant", (*R.QUADRANTS, "Total")).join(rows, "quadrant", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))
    whole = F.max("messages").over(Window.partitionBy())
    return counted.select("quadrant", "messages", F.when(whole > 0, F.round(F.col("messages") * 100.0 / whole, 1)).otherwise(0.0).alias("percent"), "first_day", "last_day")


def coverage_cross_foot(table: DataFrame, require_quadrants: bool = True) -> DataFrame:
    """brand and broken: the equations of a coverage table that a row breaks, or the sum of all; none, if it is right."""
    quadrants = " + ".join(q.lower().replace(" ", "_") for q in R.QUADRANTS)
    rules = {"scopes": "messages <> broadcast + lifecycle + uncertain", "quadrants": f"broadcast <> unclassified + {quadrants}"}
    if require_quadrants:
        rules["unclassified"] = "unclassified > 0"
    named = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()]))
    sums = [F.sum(F.when(F.col("brand") == "TOTAL", F.col(c)).otherwise(-F.col(c))) for c in ("messages", "broadcast")]
    total = table.agg(sums[0].alias("m"), sums[1].alias("b")).where("m <> 0 OR b <> 0").select(F.lit("TOTAL").alias("brand"), F.lit("sum of brands").alias("broken"))
    return table.select("brand", F.explode(named).alias("broken")).unionByName(total)


def freeze_metrics(df: DataFrame) -> DataFrame:
    """metric and value of everything a release freezes, in long form."""
    sent = F.col("scope") == "broadcast"
    one = df.agg(
        F.count(F.lit(1)).alias("distinct_messages"), *[count_if(F.col("scope") == s).alias(s) for s in R.SCOPES], F.count_distinct(F.when(sent, F.col("brand"))).alias("brands"),
        *[count_if(sent & (F.col("quadrant") == q)).alias(q.lower().replace(" ", "_")) for q in R.QUADRANTS], count_if(sent & F.col("offer")).alias("promotions"), count_if(sent & F.col("seasonal")).alias("seasonal"),
        F.coalesce(F.datediff(F.max(F.when(sent, F.col("observed"))), F.min(F.when(sent, F.col("observed")))) + 1, F.lit(0)).alias("observed_days"),
    )
    of = lambda c: F.when(F.col("broadcast") > 0, F.round(F.col(c) * 100.0 / F.col("broadcast"), 1)).otherwise(0.0)
    one = one.withColumns({f"{c}_share": of(c) for c in ("promotions", "seasonal", *(q.lower().replace(" ", "_") for q in R.QUADRANTS))})
    return one.unpivot([], one.columns, "metric", "value") if len({t for _, t in one.dtypes}) == 1 else one.select(*[F.col(c).cast("double").alias(c) for c in one.columns]).unpivot([], one.columns, "metric", "value")


def frozen_differences(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """Metrics that one side lacks or that differ, with both values; none, if a recomputation agrees."""
    then = frozen.select(F.col("metric"), F.col("value").alias("frozen"))
    return then.join(now.select("metric", F.col("value").alias("found")), "metric", "full").where(~F.col("frozen").eqNullSafe(F.col("found")))


def hook_selection(df: DataFrame, priority: tuple[str, ...] = ()) -> DataFrame:
    """The brand that leads the report, its strongest quadrant and that one's share; of eligible brands, those of priority first if there are any.

    Brands come by broadcasts, then by priority, then by name; quadrants by count, then by name, both from the greatest.
    """
    brands = brand_rollup(df).where("hook_eligible").select("brand", "broadcast")
    place = F.coalesce(*[F.when(F.lower("brand") == b.lower(), i) for i, b in enumerate(priority)], F.lit(len(priority)))
    chosen = brands.where(place < len(priority)) if priority else brands
    first = chosen.orderBy(F.desc("broadcast"), place, F.lower("brand")).limit(1)
    counts = broadcasts(df).groupBy("brand", "quadrant").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("brand").agg(F.max(F.struct("n", "quadrant")).alias("top"))
    return first.join(top, "brand").select("brand", F.col("broadcast").alias("denominator"), F.col("top.quadrant").alias("quadrant"), F.col("top.n").alias("numerator"), F.round(F.col("top.n") * 100.0 / F.col("broadcast"), 1).alias("percent"))


def reconciled(coverage: DataFrame, census: DataFrame) -> DataFrame:
    """check, coverage, census (as text) and same for each column of coverage, a table of one row, against that of census; a column that census lacks is null there."""
    told = lambda df, side: df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*[F.col(c).cast("string") for c in df.columns]))).alias("check", side))
    both = told(coverage, "coverage").join(told(census.select(*[c for c in coverage.columns if c in census.columns]), "census"), "check", "left")
    return both.select("check", "coverage", "census", F.col("coverage").eqNullSafe(F.col("census")).alias("same"))


def _slug(name: str) -> str:
    return name.lower().replace(" ", "_")


def coverage_side(df: DataFrame, failures: DataFrame) -> DataFrame:
    """What the source ledger says in all: counters, dates, quadrants, gate, in one row."""
    total = coverage_table(df).where("brand = 'TOTAL'").select(F.col("messages").alias("distinct_messages"), F.col("broadcast").alias("qualified_broadcasts"), "lifecycle", "uncertain", F.col("first_day").alias("first_observed"), F.col("last_day").alias("last_observed"), "observed_days", *map(_slug, R.QUADRANTS))
    counts = df.agg(F.count_distinct("message_id").alias("parsed_input")).join(failures.agg(F.count(F.lit(1)).alias("parse_failures")))
    gate = early_gate(df).select(F.col("total").alias("gate_broadcasts"), F.col("passed").alias("gate_passed"))
    brands = coverage_table(df).where("brand <> 'TOTAL'").agg(F.count(F.lit(1)).alias("brands"))
    rows = total.join(counts).join(gate).join(brands)  # a row each
    return rows.withColumns({"raw_fetched": F.col("parsed_input") + F.col("parse_failures"), "variants_collapsed": F.col("distinct_messages") - F.col("parsed_input")})


def census_side(df: DataFrame, failures: DataFrame) -> DataFrame:
    """The same from the census, each number on its own way through the data."""
    pivot = lambda rows, key, names: rows.agg(*[F.max(F.when(F.col(key) == n, F.col("messages"))).alias(alias) for n, alias in names])
    scopes = pivot(scope_counts(df), "scope", [(s, "qualified_broadcasts" if s == "broadcast" else s) for s in R.SCOPES])
    quadrants = pivot(quadrant_census(df), "quadrant", [(q, _slug(q)) for q in R.QUADRANTS])
    window = observed_window(df).select("first_observed", "last_observed", "observed_days")
    rollup = brand_rollup(df).agg(F.sum("distinct_messages").alias("distinct_messages"), F.count(F.lit(1)).alias("brands"), F.sum("broadcast").alias("gate_broadcasts"), F.max(F.least(F.col("broadcast") / R.GATE_BRAND, F.col("observed_days") / R.GATE_DAYS)).alias("_near"))
    ids = df.select("message_id").distinct().agg(F.count("message_id").alias("parsed_input")).join(failures.agg(F.count(F.lit(1)).alias("parse_failures")))
    rows = scopes.join(quadrants).join(window).join(rollup).join(ids)  # a row each
    passed = (F.col("gate_broadcasts") >= R.GATE_TOTAL) & (F.col("_near") >= 1)
    return rows.withColumns({"gate_passed": passed, "raw_fetched": F.col("parsed_input") + F.col("parse_failures"), "variants_collapsed": F.col("distinct_messages") - F.col("parsed_input")}).drop("_near")

"""Release ledger: what coverage and census say of each other, set comparisons, windows, orders, and small projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import safe_rules
from ..functions.privacy import sanitized
from ..functions.safe import safe_text
from ..shared import kept, numbered


def bind_coverage(census: DataFrame, coverage: DataFrame) -> DataFrame:
    """census (brand, ...) with source_completeness, ingestion_errors, early_gate_ready and hook_eligible from coverage.

    coverage: brand, source_completeness, errors, broadcast, observed_days, hook_gate, with a TOTAL row. A brand is
    complete only if its row and the total are; one without a row is partial and not eligible.
    """
    total = coverage.where("brand = 'TOTAL'").select(F.lit(1).alias("_one"), F.col("source_completeness").alias("_all"))
    rows = coverage.where("brand <> 'TOTAL'").withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")  # one row
    whole, own = F.col("_all") == "complete", F.col("source_completeness") == "complete"
    state = F.when(whole & own, "complete").when(~own, F.col("source_completeness")).otherwise(F.col("_all"))
    early = (F.col("broadcast") >= R.GATE_BRAND) & (F.col("observed_days") >= R.GATE_DAYS)
    known = rows.select("brand", state.alias("source_completeness"), F.col("errors").alias("ingestion_errors"), early.alias("early_gate_ready"), (whole & own & (F.col("hook_gate") == "eligible")).alias("hook_eligible"))
    joined = census.select("brand").join(known, "brand", "left")
    return joined.select("brand", F.coalesce("source_completeness", F.lit("partial")).alias("source_completeness"), F.coalesce("ingestion_errors", F.lit(0)).alias("ingestion_errors"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("early_gate_ready", "hook_eligible")])


def complete_gate(coverage: DataFrame) -> DataFrame:
    """coverage with a hook_gate that only a complete row passes; others that would have are within 50 percent."""
    return coverage.withColumn("hook_gate", F.when((F.col("hook_gate") == "eligible") & (F.coalesce("source_completeness", F.lit("partial")) != "complete"), "within_50_percent").otherwise(F.col("hook_gate")))


def coverage_quadrant(scope: Column, offer: Column, seasonal: Column) -> Column:
    """The quadrant of a broadcast that is analyzed, else null."""
    name = F.when(offer & seasonal, R.QUADRANTS[2]).when(offer, R.QUADRANTS[1]).when(seasonal, R.QUADRANTS[3]).otherwise(R.QUADRANTS[0])
    return F.when((scope == "broadcast") & seasonal.isNotNull(), name)


def union_window(windows: DataFrame) -> DataFrame:
    """From the earliest start to the latest end of windows (start, end)."""
    return windows.agg(F.min("start").alias("start"), F.max("end").alias("end"))


def batch_differences(expected: DataFrame, got: DataFrame) -> DataFrame:
    """problem (missing, unexpected, repeated) and uid of what a batch (uid) should have brought; none, if it is complete."""
    want = expected.select("uid").distinct().withColumn("_want", F.lit(True))
    have = got.groupBy("uid").agg(F.count(F.lit(1)).alias("_n"))
    both = want.join(have, "uid", "full")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("_n") > 1, "repeated")
    return both.select(problem.alias("problem"), "uid").where("problem IS NOT NULL")


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows that only one side has, with side; none, if the sets are equal."""
    return left.subtract(right).withColumn("side", F.lit("left")).unionByName(right.subtract(left).withColumn("side", F.lit("right")))


def beyond(subset: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """The keys of subset that of lacks; none, if it is one."""
    return subset.select(key).distinct().join(of.select(key), key, "left_anti")


def ordered(rows: DataFrame, *order: Column, most: int | None = None) -> DataFrame:
    """rows with their place in the order, of which the first most stay. For tables of a row for each brand or label."""
    out = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return out if most is None else out.where(F.col("place") <= most)


def nested(rows: DataFrame) -> DataFrame:
    """Flat annotations as the structs offer, seasonality and intent."""
    return rows.select(
        "id", "scope", F.struct(F.col("offer").alias("present"), F.col("primary").alias("primary")).alias("offer"),
        F.struct(F.col("seasonal").alias("seasonal"), F.col("occasion").alias("occasion")).alias("seasonality"), F.struct(F.col("intent").alias("label"), F.col("intent_confidence").alias("confidence")).alias("intent"),
    )


def flat(rows: DataFrame) -> DataFrame:
    """The structs of nested() as columns again."""
    return rows.select("id", "scope", F.col("offer.present").alias("offer"), F.col("offer.primary.type").alias("offer_type"), F.col("offer.primary.depth").alias("depth"), F.col("seasonality.seasonal").alias("seasonal"), F.col("seasonality.occasion").alias("occasion"), F.col("intent.label").alias("intent"), F.col("intent.confidence").alias("intent_confidence"))


def bounded_confidence(value: Column, default: float = 0.8) -> Column:
    """A number as text within 0 and 1; the default where it is none."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def gallery_label(category: Column) -> Column:
    bare = F.trim(F.coalesce(category, F.lit("")))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in R.GALLERY_LABELS.items() for x in kv]), F.lower(bare))
    return F.when(F.length(bare) <= R.GALLERY_LABEL_CHARS, F.coalesce(named, F.lit(R.GALLERY_NO_LABEL))).otherwise(R.GALLERY_NO_LABEL)


def iso_day(value: Column) -> Column:
    """A real date of the form yyyy-mm-dd as text, else empty."""
    bare = F.trim(F.coalesce(value, F.lit("")))
    return F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$") & bare.try_cast("date").isNotNull(), bare).otherwise("")


def first_present(*names: Column, default: str = R.NO_BRAND, chars: int = R.BRAND_CHARS) -> Column:
    """The first of the columns that isn't blank, with white space collapsed, cut to chars, else the default."""
    clean = [F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")) for c in names]
    return F.coalesce(*[F.left(c, F.lit(chars)) for c in clean], F.lit(default))


def date_skew(header: Column, received: Column) -> Column:
    """struct(days, error): how far the sender's date is from the receipt, and a code if by more than a week."""
    days = F.abs(F.unix_micros(header.cast("timestamp")) - F.unix_micros(received.cast("timestamp"))) / 86_400_000_000
    return F.struct(F.round(days, 3).alias("days"), F.when(days > R.SKEW_DAYS, "header_date_skew_over_7_days").alias("error"))


def months_ago(now: Column, months: int, zone: str) -> Column:
    """The same wall time in zone so many months earlier, on the month's last day where that day is missing; in UTC."""
    if months < 1:
        raise ValueError("months must be at least 1")
    local = F.from_utc_timestamp(now, zone)
    since_midnight = F.unix_micros(local.cast("timestamp")) - F.unix_micros(F.date_trunc("day", local))
    return F.to_utc_timestamp(F.timestamp_micros(F.unix_micros(F.add_months(local, -months).cast("timestamp")) + since_midnight), zone)


def synthetic_items(brands: DataFrame) -> DataFrame:
    """Three made-up gallery items of each brand (brand, last_observed)."""
    categories = F.array(*[F.struct(F.lit(i + 1).alias("index"), F.lit(c).alias("name")) for i, c in enumerate(R.SYNTHETIC_CATEGORIES)])
    rows = brands.select("brand", "last_observed", F.explode(categories).alias("c"))
    return rows.select("brand", F.col("c.index").cast("long").alias("place"), F.coalesce(F.date_format("last_observed", "yyyy-MM-dd"), F.lit("")).alias("date"), F.concat(F.lit("Synthetic "), "c.name", F.lit(" preview")).alias("category"), F.sha2(F.concat("brand", F.lit("|"), F.col("c.index").cast("string")), 256).alias("seed"))


def interval_cells(start: Column, end: Column) -> tuple[Column, Column]:
    """The length class of a span, and the cells of that class's width that it lies in: two at most, so a long text is cut into many."""
    size = F.ceil(F.log2(F.greatest(F.lit(1), end - start).cast("double"))).cast("int")
    width = F.pow(F.lit(2), size).cast("long")
    return size, F.array_distinct(F.array(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width)))


def uncovered_spans(tokens: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """The spans (key, start, end) of tokens that no span of claims contains.

    Claims lie in cells of their length's class; a token asks the cell of its start in each class that there is. In a cell,
    in order of start, a token is covered if the greatest end so far reaches its own: no pair of token and claim is formed.
    """
    size, at = interval_cells(F.col("start"), F.col("end"))
    spans = claims.select(F.col(key).alias("_key"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).where(F.col("_key").isNotNull()).withColumn("size", size).withColumn("cell", F.explode(at))
    sizes = [r[0] for r in spans.select("size").distinct().collect()]  # 63 classes at most
    asked = tokens.select(F.col(key).alias("_key"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).where(F.col("_key").isNotNull()).distinct()
    asked = asked.withColumn("size", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).withColumn("cell", F.floor(F.col("start") / F.pow(F.lit(2), F.col("size"))))
    names = ["_key", "size", "cell", "start", "end"]
    both = spans.select(*names, F.lit(0).alias("asks")).unionByName(asked.select(*names, F.lit(1).alias("asks")))
    reach = F.max(F.when(F.col("asks") == 0, F.col("end"))).over(Window.partitionBy("_key", "size", "cell").orderBy("start", "asks").rowsBetween(Window.unboundedPreceding, 0))
    covered = both.withColumn("reach", reach).where((F.col("asks") == 1) & (F.col("reach") >= F.col("end"))).select("_key", F.col("start").alias("_start"), F.col("end").alias("_end")).distinct()
    return tokens.join(covered, (tokens[key] == covered["_key"]) & (tokens["start"] == covered["_start"]) & (tokens["end"] == covered["_end"]), "left_anti")


def contained_pairs(tokens: DataFrame, claims: DataFrame, key: str, claim: str) -> DataFrame:
    """claim and token of every token inside a span of claims (key, start, end, claim); claims and tokens meet in cells of the claim's length."""
    size, at = interval_cells(F.col("start"), F.col("end"))
    spans = kept(claims.select(F.col(key).alias("_key"), claim, F.col("start").alias("_start"), F.col("end").alias("_end"), size.alias("size"), F.explode(at).alias("cell")), "spans")
    sizes = [r[0] for r in spans.select("size").distinct().collect()]  # 63 classes at most
    asked = tokens.select(F.col(key).alias("_key"), "start", "end", "token", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("size")).withColumn("cell", F.floor(F.col("start") / F.pow(F.lit(2), F.col("size"))))
    met = asked.join(spans, ["_key", "size", "cell"]).where((F.col("_start") <= F.col("start")) & (F.col("end") <= F.col("_end")))
    return met.select(claim, "start", "token")


def bound_claims(tokens: DataFrame, claims: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """claim, metric, state of claims (key, claim, start, end, metric) against the frozen metrics (metric, token).

    bound: a number in the claim is the token of its metric; stale: the metric is known but no number there is its token; missing: no number
    stands there; unknown: the metric isn't frozen. A claim that names no metric is bound to the only metric of one of its
    numbers, ambiguous if several metrics have them, unbound if none has.
    """
    pairs = contained_pairs(tokens, claims, key, "claim")
    frozen = metrics.select(F.col("metric").alias("_metric"), F.col("token").alias("_token")).distinct()
    of = pairs.join(frozen, F.col("token") == F.col("_token"), "left").groupBy("claim").agg(F.count("token").alias("numbers"), F.array_sort(F.collect_set("_metric")).alias("metrics"))  # of the numbers of one claim
    known = frozen.select(F.col("_metric")).distinct()
    rows = claims.select("claim", "metric").join(of, "claim", "left").join(known, F.col("metric") == F.col("_metric"), "left")
    named = F.when(F.col("_metric").isNull(), "unknown").when(F.array_contains("metrics", F.col("metric")), "bound").otherwise("stale")
    free = F.when(F.size("metrics") == 0, "unbound").when(F.size("metrics") == 1, "bound").otherwise("ambiguous")
    state = F.when(F.coalesce("numbers", F.lit(0)) == 0, "missing").when(F.col("metric").isNotNull(), named).otherwise(free)
    return rows.select("claim", F.coalesce("metric", F.when(free == "bound", F.get("metrics", F.lit(0)))).alias("metric"), state.alias("state"))


def number_token(found: Column) -> Column:
    """A number without thousands' commas and trailing zeros of a fraction, with its sign of dollars or else of percent."""
    bare = F.regexp_replace(found, "[$,%]", "")
    short = F.when(F.contains(bare, F.lit(".")), F.regexp_replace(F.regexp_replace(bare, "0+$", ""), r"\.$", "")).otherwise(bare)
    return F.when(F.startswith(found, F.lit("$")), F.concat(F.lit("$"), short)).when(F.endswith(found, F.lit("%")), F.concat(short, F.lit("%"))).otherwise(short)


def classifier_payload(subject: Column, preheader: Column, body: Column) -> Column:
    """struct(subject, preheader, visible_text), redacted, cut, with placeholders that a reader outside understands: all that may leave."""
    out = []
    for name, text, most in zip(("subject", "preheader", "visible_text"), (subject, preheader, body), R.PAYLOAD_CHARS):
        cut = F.left(sanitized(F.coalesce(text, F.lit(""))), F.lit(most))
        out.append(F.replace(F.replace(cut, F.lit("[email]"), F.lit("[redacted email]")), F.lit("[url]"), F.lit("[redacted url]")).alias(name))
    return F.struct(*out)


def safe_payload(subject: Column, preheader: Column, body: Column) -> Column:
    """The same by the full rules: no field holds a direct identifier, and a cut opens no wrapper."""
    out = []
    for name, text, most in zip(("subject", "preheader", "visible_text"), (subject, preheader, body), R.PAYLOAD_CHARS):
        cut = safe_text(text, most=most)
        out.append(F.replace(F.replace(cut, F.lit(safe_rules.ADDRESS), F.lit("[redacted email]")), F.lit(safe_rules.LINK), F.lit("[redacted url]")).alias(name))
    return F.struct(*out)


def normalized_records(rows: DataFrame) -> DataFrame:
    """Stored records (id, source_type, trusted, source_completeness, variant_ids) as they are loaded.

    A mailbox export without a trust flag isn't trusted, a curated source makes its rows curated, the own id is the
    first variant, none stands twice, and the count is theirs.
    """
    ids = F.array_distinct(F.concat(F.array("id"), F.coalesce("variant_ids", F.array().cast("array<string>"))))
    made = F.when(F.col("source_type") == "curated_export", "curated_export").otherwise(F.coalesce("source_completeness", F.lit("complete")))
    return rows.withColumns({"trusted": F.coalesce("trusted", F.col("source_type") != "mbox"), "source_completeness": made, "variant_ids": ids, "variant_count": F.size(ids).cast("long")})


def unseen_variants(arrived: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of arrived whose id is no variant of a stored record (variant_ids)."""
    return arrived.join(stored.select(F.explode("variant_ids").alias("_seen")).distinct(), arrived["id"] == F.col("_seen"), "left_anti")


def census_completeness(rows: DataFrame) -> DataFrame:
    """brand and source_completeness: partial where a row was not parsed or has no trusted date, else curated_export where any is, else complete."""
    bad = F.bool_or((F.coalesce("parse_status", F.lit("ok")) != "ok") | F.col("observed").isNull())
    curated = F.bool_or(F.col("source_type") == "curated_export")
    return rows.groupBy("brand").agg(F.when(bad, "partial").when(curated, "curated_export").otherwise("complete").alias("source_completeness"))


def within_budget(items: DataFrame, most: int = R.GALLERY_BYTES) -> DataFrame:
    """The items (brand, place, bytes, ...) that fit into a budget of bytes in all.

    Brands come by name in lower case, items by place; an item that no longer fits ends its brand, and later brands may
    still fit. Up to the first item that doesn't fit, sums by ranges decide. What is left of the budget then only shrinks, so
    of the rest only brands whose first item fits into it are looked at, one after the other, with two numbers as state.
    """
    line = items.select(F.lower("brand").alias("key"), "brand", F.col("place").cast("long").alias("place"), F.col("bytes").cast("long").alias("bytes"))
    rows, _ = numbered(line.repartitionByRange("key", "brand", "place").sortWithinPartitions("key", "brand", "place"), 0, "at")
    cuts = F.floor(F.col("at") / 10_000)  # sums go through a window of one row for each so many items
    sums = rows.groupBy(cuts.alias("cut")).agg(F.sum("bytes").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("bytes").over(Window.partitionBy("cut").orderBy("at"))
    summed = kept(rows.withColumn("cut", cuts).withColumn("within", within).join(sums.select("cut", before.alias("before")), "cut").withColumn("total", F.col("before") + F.col("within")), "summed")
    over = summed.where(F.col("total") > most).agg(F.min("at").alias("at"), F.min_by("brand", "at").alias("brand")).first()
    first = summed.where(F.col("at") < over["at"]) if over["at"] is not None else summed
    names = ["brand", "place"]
    if over["at"] is None:
        return items.join(first.select(*names), names, "left_semi")
    left = most - (first.agg(F.max("total")).first()[0] or 0)
    later = summed.where((F.col("at") > over["at"]) & ~F.col("brand").eqNullSafe(F.lit(over["brand"])))
    openings = later.groupBy("brand").agg(F.min_by("bytes", "at").alias("opening")).where(F.col("opening") <= left).select("brand")
    rest = later.join(openings, "brand", "left_semi").select("at", "brand", "place", "bytes").coalesce(1).sortWithinPartitions("at")

    def fill(batches):
        room, ended = left, None
        for batch in batches:
            fits = []
            for r in batch.itertuples(index=False):
                if r.brand != ended and r.bytes > room:
                    ended = r.brand
                fits.append(r.brand != ended)
                room -= r.bytes if fits[-1] else 0
            yield batch[fits][names]

    more = rest.mapInPandas(fill, "brand string, place long")
    return items.join(first.select(*names).union(more), names, "left_semi")


def running_ids(*lists: Column) -> Column:
    """The ids of several lists in order, each once, where it comes first."""
    return reduce(F.array_union, lists)

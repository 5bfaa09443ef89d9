"""Queries over the derived messages and the text tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import rules as R
from .functions import text as X
from .operators import census, dedupe, resend
from .plans.messages import TEMPLATES, analyzed, messages, spread, stored_once
from .functions.html import visible_text
from .functions.safe import let
from .functions.spots import signed


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# What the reports must find in each template of plans.messages.TEMPLATES, read from the rules by hand, for the SQL alone:
# lifecycle wording and its confidence, marketing words, kind, depth and field of the primary offer, occasion with its
# months (none: any) and field, intent.
GOLDEN = (
    ("", 0, True, "%off", "n", "subject", "", (), "", "Promotion/offer"),
    ("", 0, True, "%off", "n", "subject", "", (), "", "Promotion/offer"),
    ("", 0, True, "", "", "", "", (), "", "Featured products"),
    ("", 0, False, "$off", "10", "subject", "", (), "", "Promotion/offer"),
    ("", 0, False, "bogo", "", "subject", "", (), "", "Promotion/offer"),
    ("", 0, True, "", "", "", "", (), "", "New product launch"),
    ("", 0, True, "", "", "", "", (), "", "Ingredient/education"),
    ("", 0, False, "", "", "", "", (), "", "Founder/brand story"),
    ("", 0, False, "", "", "", "", (), "", "Social proof/UGC"),
    ("", 0, True, "", "", "", "", (), "", "Upsell"),
    ("", 0, False, "", "", "", "", (), "", "Cross-sell"),
    ("", 0, False, "", "", "", "", (), "", "Lifestyle/seasonal"),
    ("", 0, False, "", "", "", "", (), "", "Featured products"),
    ("", 0, False, "%off", "n", "subject", "Black Friday", (), "subject", "Promotion/offer"),
    ("", 0, False, "", "", "", "Black Friday", (), "subject", "Featured products"),
    ("", 0, False, "", "", "", "New Year", (), "preheader", "Featured products"),
    ("", 0, False, "", "", "", "Holiday gifting", (), "subject", "Featured products"),
    ("", 0, False, "", "", "", "Mother's Day", (4, 5), "subject", "Featured products"),
    ("", 0, True, "", "", "", "Holiday gifting", (10, 11, 12), "subject", "Lifestyle/seasonal"),
    ("", 0, True, "", "", "", "Mother's Day", (4, 5), "preheader", "Lifestyle/seasonal"),
    ("", 0, True, "", "", "", "Summer", (6, 7, 8), "subject", "Featured products"),
    ("", 0, True, "", "", "", "Fall", (9, 10, 11), "subject", "Featured products"),
    ("", 0, True, "other", "", "preheader", "", (), "", "Promotion/offer"),
    ("welcome", 0.96, False, "", "", "", "", (), "", "Featured products"),
    ("", 0, True, "", "", "", "", (), "", "Featured products"),
    ("", 0, False, "", "", "", "", (), "", "Featured products"),
    ("transactional", 0.96, False, "", "", "", "", (), "", "Featured products"),
    ("transactional", 0.91, False, "", "", "", "", (), "", "Featured products"),
    ("welcome", 0.91, False, "", "", "", "", (), "", "Featured products"),
    ("welcome", 0.91, True, "", "", "", "", (), "", "Featured products"),
    ("", 0, True, "free_shipping", "", "subject", "", (), "", "Promotion/offer"),
    ("", 0, True, "", "", "", "", (), "", "Featured products"),
    ("", 0, True, "free_shipping", "", "visible_text", "", (), "", "Promotion/offer"),
    ("", 0, True, "", "", "", "", (), "", "Featured products"),
    ("", 0, False, "", "", "", "", (), "", "Featured products"),
    ("", 0, True, "", "", "", "", (), "", "Featured products"),
    ("", 0, True, "%off", "n", "visible_text", "", (), "", "Ingredient/education"),
    ("", 0, False, "%off", "n", "visible_text", "", (), "", "New product launch"),
    ("", 0, True, "gift", "", "subject", "", (), "", "Promotion/offer"),
    ("", 0, True, "bundle", "", "subject", "", (), "", "Promotion/offer"),
    ("", 0, True, "other", "", "preheader", "Halloween", (), "subject", "Promotion/offer"),
    ("", 0, False, "", "", "", "", (), "", "Featured products"),
)
_EMPTY = len(TEMPLATES) - 1
_TEMPLATE_ROWS = ", ".join(
    f"({i}, {q(subject)}, {q(preheader)}, {q(body)}, {q(g[0])}, {g[1]}::DOUBLE, {g[2]}, {q(g[3])}, {q(g[4])}, {q(g[5])}, {q(g[6])}, {list(g[7])}::INT[], {q(g[8])}, {q(g[9])})"
    for i, ((subject, preheader, body), g) in enumerate(zip(TEMPLATES, GOLDEN, strict=True))
)
_FILLED = ", ".join(f"nullif(replace(replace(x.{c}, '{{n}}', (round(l_discount * 100) + 5)::INT::VARCHAR), '{{p}}', p_name), '') AS {c}" for c in ("subject", "preheader", "visible_text"))
MESSAGES = rf"""
    WITH tpl(t, subject, preheader, visible_text, life, life_confidence, marketing, kind, number, kind_source, named, months, named_source, thesis) AS (VALUES {_TEMPLATE_ROWS}),
    raw AS (
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS id,
               concat_ws('-', l_orderkey, l_linenumber) AS message_id, CASE WHEN l_orderkey % 5 <> 0 THEN concat_ws('-', l_partkey, l_suppkey) END AS campaign_id, p_brand AS brand,
               l_shipdate::DATE AS received, l_shipdate + to_minutes((l_orderkey * 37 + l_linenumber * 11) % 1440) AS received_at,
               CASE l_linenumber WHEN 7 THEN 'curated_export' WHEN 6 THEN 'mbox' ELSE 'imap' END AS source_type, CASE WHEN l_linenumber <> 5 THEN l_linestatus <> 'O' END AS trusted,
               {_FILLED}, l_returnflag AS flag, (round(l_discount * 100) + 5)::INT AS n, (l_orderkey + 3 * l_linenumber + l_suppkey) % {len(TEMPLATES)} AS t
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN tpl x ON x.t = (l_orderkey + 3 * l_linenumber + l_suppkey) % {len(TEMPLATES)}
    ), g AS (
        SELECT raw.*, tpl.* EXCLUDE (t, subject, preheader, visible_text), source_type = 'curated_export' AS curated, CASE WHEN coalesce(trusted, source_type <> 'mbox') THEN received END AS observed,
               CASE WHEN named <> '' AND (len(months) = 0 OR list_contains(months, month(received)::INT)) THEN named END AS said
        FROM raw JOIN tpl USING (t)
    ), a AS (
        SELECT *, CASE WHEN curated THEN 'broadcast' WHEN life <> '' THEN 'lifecycle' WHEN t = {_EMPTY} THEN 'uncertain' WHEN campaign_id IS NOT NULL OR marketing THEN 'broadcast' ELSE 'uncertain' END AS scope,
               CASE WHEN curated THEN 'curated_export' WHEN life <> '' THEN 'lifecycle:' || life WHEN t = {_EMPTY} THEN 'insufficient_scope_evidence' WHEN campaign_id IS NOT NULL THEN 'bulk_or_list_header'
                    WHEN marketing THEN 'marketing_content' ELSE 'insufficient_scope_evidence' END AS reason,
               CASE WHEN curated THEN 1 WHEN life <> '' THEN life_confidence WHEN t = {_EMPTY} THEN 0.45 WHEN campaign_id IS NOT NULL THEN 0.96 WHEN marketing THEN 0.72 ELSE 0.55 END::DOUBLE AS scope_confidence,
               CASE WHEN kind <> '' THEN kind WHEN curated AND flag = 'A' THEN 'other' END AS type,
               CASE WHEN kind <> '' THEN kind_source WHEN curated AND flag = 'A' THEN 'curated_export' END AS source,
               CASE number WHEN 'n' THEN n ELSE try_cast(nullif(number, '') AS DOUBLE) END::DOUBLE AS depth,
               CASE WHEN said IS NOT NULL THEN said WHEN curated AND flag = 'R' THEN 'Summer' END AS occasion,
               CASE WHEN said IS NOT NULL THEN named_source WHEN curated AND flag = 'R' THEN 'curated_export' ELSE '' END AS occasion_source,
               CASE WHEN said IS NULL AND curated AND flag = 'R' THEN 0.8 WHEN said IS NOT NULL AND len(months) > 0 THEN 0.9 ELSE 1 END::DOUBLE AS occasion_confidence
        FROM g
    ), m AS (
        SELECT *, type IS NOT NULL AS offer, occasion IS NOT NULL AS seasonal,
               CASE WHEN type IS NOT NULL AND occasion IS NOT NULL THEN 'Seasonal promotion' WHEN type IS NOT NULL THEN 'Everyday promotion'
                    WHEN occasion IS NOT NULL THEN 'Seasonal content' ELSE 'Evergreen content' END AS quadrant,
               CASE WHEN curated AND type IS NOT NULL THEN 'Promotion/offer' WHEN curated AND thesis = 'Featured products' THEN 'Upsell' ELSE thesis END AS intent,
               CASE WHEN curated AND type IS NOT NULL THEN CASE WHEN source = 'curated_export' THEN 0.8 WHEN type = 'other' THEN 0.95 ELSE 1 END WHEN curated AND thesis = 'Featured products' THEN 0.8
                    WHEN thesis = 'Promotion/offer' THEN 1 WHEN thesis = 'Featured products' THEN 0.7 ELSE 0.9 END::DOUBLE AS intent_confidence
        FROM a
    ), b AS (SELECT * FROM m WHERE scope = 'broadcast'),
    s AS (
        SELECT brand, count(*) AS distinct_messages, count(*) FILTER (scope = 'broadcast') AS broadcast, count(*) FILTER (scope = 'lifecycle') AS lifecycle,
               count(*) FILTER (scope = 'uncertain') AS uncertain, min(observed) FILTER (scope = 'broadcast') AS first_observed, max(observed) FILTER (scope = 'broadcast') AS last_observed,
               coalesce(max(observed) FILTER (scope = 'broadcast') - min(observed) FILTER (scope = 'broadcast') + 1, 0)::BIGINT AS observed_days,
               count(DISTINCT strftime(observed, '%Y-%m')) FILTER (scope = 'broadcast') AS months, count(*) FILTER (scope = 'broadcast' AND offer) AS offers, count(*) FILTER (scope = 'broadcast' AND depth IS NOT NULL) AS numeric_offers,
               median(depth) FILTER (scope = 'broadcast') AS median_depth
        FROM m GROUP BY brand
    ), rollup_rows AS (
        SELECT *, ceil(observed_days / 7)::BIGINT AS observed_weeks,
               CASE WHEN observed_days < 1 THEN 'none' WHEN observed_days < 30 THEN 'library' WHEN observed_days < 90 THEN 'pulse' WHEN observed_days < 330 THEN 'mix' WHEN observed_days < 730 THEN 'annual' ELSE 'yoy' END AS coverage,
               broadcast >= 30 AND observed_days >= 90 AS hook_eligible, observed_days >= 330 AND broadcast > 0 AS seasonal_eligible
        FROM s
    )
"""  # fmt: skip
_SLUG = {x: x.lower().replace(" ", "_").replace("/", "_").replace("-", "_") for x in (*R.QUADRANTS, *R.INTENTS)}


def _of(report, *more):
    return lambda spark, d: report(analyzed(spark, d), *more)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).withColumn("content_hash", X.content_hash(*[F.coalesce(c, F.lit("")) for c in ("subject", "preheader", "visible_text")]))


def secret_scan(docs: DataFrame) -> DataFrame:
    """Addresses, long hexadecimal tokens and card-like numbers of each document, with a short hash of each match."""
    rules = {"address": R.EMAIL, "hex_token": r"\b[0-9a-f]{40}\b", "long_number": r"\b[0-9]{16}\b"}
    hits = F.array(*[F.struct(F.lit(k).alias("rule"), F.regexp_extract_all("text", F.lit(f"({p})" if not p.startswith("(?i)") else f"(?i)({p[4:]})"), 1).alias("hits")) for k, p in rules.items()])
    return docs.select("doc_id", F.inline(hits)).select("doc_id", "rule", F.explode("hits").alias("hit")).groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("matches"), F.min(F.substring(F.sha2("hit", 256), 1, 16)).alias("first_hash"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = _hashed(spark, d).withColumn("source_completeness", F.when(F.col("source_type") == "curated_export", "curated_export").otherwise("complete"))
    return rows.withColumns({"source_key": F.concat_ws(":", "source_type", "id"), "variant_ids": F.array().cast("array<string>"), "parse_errors": F.when(F.col("subject").isNull(), F.array(F.lit("empty")))})


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return stored_once(spark, d, "assigned", lambda: resend.deduplicated(_records(spark, d), components_too=False))


ASCII_BORDER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def secret_scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, rule, matches, first_hash (least short hash of a match) of each rule that a document matches: the reference's content rules.

    Addresses at reserved domains have a rule of their own, opaque tracking values count as tracking fragments, and a
    text that looks like raw mail is a match as a whole. Rules see the bytes of a text, each as one character.
    """
    none = F.array().cast("array<string>")
    reserved = lambda x: x.rlike(R.SECRET_RESERVED)
    opaque = lambda v: (F.length(v) >= 20) | v.rlike("[0-9A-Z]") | (F.length(F.regexp_replace(v, "[^-_.~]", "")) >= 2)

    def hits(x: Column) -> Column:
        data, low = x["data"], x["low"]
        every = lambda p, group=1: F.regexp_extract_all(data, F.lit(f"({p})".replace("(?im)", "(?imd)").replace(r"\b", ASCII_BORDER)), F.lit(group))
        found = {k: F.when(signed(low, (R.SECRET_SIGNS[k],)), every(p)).otherwise(none) for k, p in R.SECRET_RULES}
        alone = F.filter(F.arrays_zip(every(R.SECRET_STANDALONE).alias("hit"), every(R.SECRET_STANDALONE, 2).alias("value")), lambda x: opaque(x.getField("value")))
        alone = F.when(signed(low, (("=",),)), F.transform(alone, lambda x: x.getField("hit"))).otherwise(none)
        found["recipient_tracking_fragment"] = F.concat(found["recipient_tracking_fragment"], alone)
        mail = reduce(and_, [low.contains(x) for x in R.SECRET_MAIL_ALL]) & reduce(or_, [low.contains(x) for x in R.SECRET_MAIL_ANY])
        found["raw_mail_payload"] = F.when(mail, F.array(data)).otherwise(none)
        addresses = found.pop("email_address")
        split = let(addresses, lambda a: F.array(*[F.struct(F.lit(k).alias("rule"), F.filter(a, f).alias("hits")) for k, f in (("email_address", lambda h: ~reserved(h)), ("synthetic_email_address", reserved))]))
        return F.filter(F.concat(split, F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("hits")) for k, v in found.items()])), lambda x: F.size(x["hits"]) > 0)

    data = F.decode(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), "ISO-8859-1")
    both = let(data, lambda d: F.struct(d.alias("data"), F.lower(d).alias("low")))
    rows = docs.select("doc_id", F.inline(let(both, hits)))
    hashes = F.transform("hits", lambda x: F.substring(F.sha2(F.encode(x, "ISO-8859-1"), 256), 1, 16))
    return rows.select("doc_id", "rule", F.size("hits").cast("long").alias("matches"), F.array_min(hashes).alias("first_hash"))


def capped_levels(spark: SparkSession, d: str) -> DataFrame:
    """Level counts of a ledger cut so that their running sum stays within the collapsed messages (here: a third of the sum)."""
    counts = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    cap = F.floor(F.sum("n").over(Window.partitionBy()) / 3)
    prior = F.coalesce(F.sum("n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select("level", "n", F.greatest(F.lit(0), F.least(F.col("n"), cap - prior)).alias("capped"))



QUERIES = {
    "brand_rollup": _of(census.brand_rollup),
    "scope_counts": _of(census.scope_counts),
    "quadrant_census": _of(census.quadrant_census),
    "monthly_counts": _of(census.monthly_counts),
    "intent_counts": _of(census.grouped_counts, "intent"),
    "brand_quadrant_pivot": _of(census.brand_pivot, "quadrant", R.QUADRANTS),
    "brand_intent_pivot": _of(census.brand_pivot, "intent", R.INTENTS),
    "brand_posture": _of(census.brand_posture),
    "observed_window": _of(census.observed_window),
    "occasion_counts": _of(census.occasion_counts),
    "seasonal_planner": _of(census.seasonal_planner),
    "early_gate": _of(census.early_gate),
    "coverage_table": _of(census.coverage_table),
    "cross_foot": _of(census.cross_foot),
    "findings": _of(census.findings),
    "weekly_activity": _of(census.weekly_activity),
    "library_latest": _of(census.latest),
    "offers_percent": lambda s, d: analyzed(s, d).where("primary.type = '%off'").groupBy("depth").agg(F.count(F.lit(1)).alias("messages")),
    "seasonality": lambda s, d: analyzed(s, d).groupBy("occasion").agg(F.count(F.lit(1)).alias("messages")),
    "seasonality_evidence": lambda s, d: analyzed(s, d).select("id", F.col("season.occasion").alias("occasion"), F.col("season.source").alias("source"), F.col("season.confidence").alias("confidence")),
    "dedupe_l1_source": lambda s, d: dedupe.first_of(messages(s, d), "id").select("id"),
    "dedupe_l2_message_id": lambda s, d: dedupe.first_of(messages(s, d), "message_id").select("id", "message_id"),
    "dedupe_l3_content": lambda s, d: dedupe.by_content(_hashed(s, d)),
    "dedupe_l4_campaign": lambda s, d: dedupe.by_campaign(messages(s, d).where("campaign_id IS NOT NULL")),
    "dedupe_full": lambda s, d: _assigned(s, d).select("id", "canonical_id", "level"),
    "dedupe_fuzzy": lambda s, d: _assigned(s, d).where(F.col("level") == resend.LEVELS[4]).select("id", "canonical_id"),
    "dedupe_merged": lambda s, d: resend.merged(_records(s, d), _assigned(s, d)),
    "dedupe_report_full": lambda s, d: resend.report(_records(s, d), _assigned(s, d)),
    "dedupe_report": lambda s, d: dedupe.report(messages(s, d), dedupe.first_of(messages(s, d), "message_id")),
    "content_hash": lambda s, d: _documents(s, d).select("doc_id", X.content_hash(F.col("source"), F.col("lang"), F.col("text")).alias("content_hash")),
    "content_hash_documents": lambda s, d: _documents(s, d).select("doc_id", X.content_hash(F.col("source"), F.col("lang"), F.col("text")).alias("content_hash")),
    "normalize_domain": lambda s, d: _pages(s, d).select("page_id", X.normal_domain(F.col("url")).alias("domain")),
    "normalize_url": lambda s, d: _pages(s, d).select("page_id", X.normal_url(F.col("url")).alias("normal_url")),
    "redact_email_url": lambda s, d: _documents(s, d).select("doc_id", F.md5(X.redacted(F.col("text"))).alias("redacted_md5")),
    "strip_payload_lines": lambda s, d: _documents(s, d).select("doc_id", F.md5(X.without_payload_lines(F.col("text"))).alias("kept_md5")),
    "numeric_tokens": lambda s, d: _documents(s, d).select("doc_id", F.array_join(X.numeric_tokens(F.col("text")), " ").alias("numbers")),
    "secret_scan_three_rules": lambda s, d: secret_scan(_documents(s, d)),
    "secret_scan_documents": lambda s, d: secret_scan_documents(_documents(s, d)),
    "html_visible_text": lambda s, d: _pages(s, d).select("page_id", visible_text(F.col("html")).alias("visible_text")),
    "capped_levels": capped_levels,
}


def _leaders_sql(keys: str, source: str, days: int) -> str:
    names = [k.strip() for k in keys.split(",")]
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in names)
    return f"""
        {source}, counted AS (SELECT {keys}, received_at, count(*) AS n FROM x GROUP BY ALL),
        l AS (
            SELECT {keys}, min(received_at) AS leader FROM counted GROUP BY {keys}
            UNION ALL
            SELECT {keys}, next FROM (SELECT l.*, (SELECT min(received_at) FROM counted r WHERE {same("r", "l")} AND r.received_at > l.leader + INTERVAL {days} DAY) AS next FROM l) WHERE next IS NOT NULL
        )
        SELECT {", ".join(f"l.{k}" for k in names)}, l.leader, sum(r.n)::BIGINT AS variants FROM l JOIN counted r
        ON {same("r", "l")} AND r.received_at BETWEEN l.leader AND l.leader + INTERVAL {days} DAY GROUP BY ALL
    """


_ORACLE = {
    "brand_rollup": "SELECT * FROM rollup_rows",
    "scope_counts": "SELECT x.scope, count(m.id) AS messages FROM (VALUES ('broadcast'), ('lifecycle'), ('uncertain')) x(scope) LEFT JOIN m USING (scope) GROUP BY 1",
    "quadrant_census": "SELECT x.quadrant, count(b.id) AS messages, count(b.id) * 100.0 / (SELECT count(*) FROM b) AS percent FROM (VALUES ('Evergreen content'), ('Everyday promotion'), ('Seasonal promotion'), ('Seasonal content')) x(quadrant) LEFT JOIN b USING (quadrant) GROUP BY 1",
    "monthly_counts": "SELECT coalesce(strftime(observed, '%Y-%m'), 'Unknown receipt date') AS month, count(*) AS messages FROM b GROUP BY 1",
    "intent_counts": "SELECT intent, count(*) AS messages FROM b GROUP BY 1",
    "brand_quadrant_pivot": "SELECT brand, " + ", ".join(f"count(*) FILTER (quadrant = {q(x)}) AS {_SLUG[x]}" for x in R.QUADRANTS) + " FROM b GROUP BY 1",
    "brand_intent_pivot": "SELECT brand, " + ", ".join(f"count(*) FILTER (intent = {q(x)}) AS {_SLUG[x]}" for x in R.INTENTS) + " FROM b GROUP BY 1",
    "brand_posture": f""", c AS (SELECT brand, intent, count(*) AS n FROM b GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, intent) AS place, sum(n) OVER (PARTITION BY brand) AS total FROM c),
        t AS (SELECT brand, any_value(intent) FILTER (place = 1) AS leader, max(n) FILTER (place = 1) AS f, coalesce(max(n) FILTER (place = 2), 0) AS g, any_value(total) AS total FROM k GROUP BY 1)
        SELECT r.brand, CASE WHEN NOT hook_eligible THEN 'Insufficient history' WHEN f / total >= 0.35 AND (g = 0 OR f >= 1.25 * g) THEN CASE leader {" ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in R.POSTURE_LABELS.items())} END ELSE 'Mixed' END AS posture,
               CASE WHEN hook_eligible THEN leader ELSE '' END AS leading_intent, CASE WHEN hook_eligible THEN f / total ELSE 0 END::DOUBLE AS share, CASE WHEN hook_eligible THEN g / total ELSE 0 END::DOUBLE AS runner_up_share
        FROM rollup_rows r LEFT JOIN t USING (brand)""",
    "observed_window": "SELECT min(observed) AS first_observed, max(observed) AS last_observed, (max(observed) - min(observed) + 1)::BIGINT AS observed_days, count(observed) AS trusted, count(*) - count(observed) AS untrusted FROM b",
    "occasion_counts": "SELECT occasion, count(*) AS messages FROM b SEMI JOIN (SELECT brand FROM rollup_rows WHERE seasonal_eligible) e USING (brand) WHERE occasion IS NOT NULL GROUP BY 1",
    "seasonal_planner": "SELECT count(*) FILTER (seasonal_eligible) AS eligible_brands, count(*) AS brands, coalesce(sum(broadcast) FILTER (seasonal_eligible), 0)::BIGINT AS eligible_messages FROM rollup_rows",
    "early_gate": "SELECT sum(broadcast)::BIGINT AS total, bool_or(broadcast >= 15 AND observed_days >= 45) AS brand_ok, sum(broadcast) >= 300 AND bool_or(broadcast >= 15 AND observed_days >= 45) AS passed, (SELECT brand FROM rollup_rows ORDER BY least(broadcast / 15, observed_days / 45) DESC, lower(brand) LIMIT 1) AS closest_brand FROM rollup_rows",
    "coverage_table": ", v AS (SELECT CASE WHEN grouping(brand) = 1 THEN 'TOTAL' ELSE brand END AS brand, grouping(brand) AS total, count(*) AS messages, 0::BIGINT AS unclassified, count(*) FILTER (scope = 'broadcast') AS broadcast, count(*) FILTER (scope = 'lifecycle') AS lifecycle, count(*) FILTER (scope = 'uncertain') AS uncertain, "
    "CASE WHEN count(*) FILTER (scope = 'broadcast') > 0 THEN min(observed) FILTER (scope = 'broadcast') ELSE min(observed) END AS first_day, CASE WHEN count(*) FILTER (scope = 'broadcast') > 0 THEN max(observed) FILTER (scope = 'broadcast') ELSE max(observed) END AS last_day, "
    + ", ".join(f"count(*) FILTER (scope = 'broadcast' AND quadrant = {q(x)}) AS {_SLUG[x]}" for x in R.QUADRANTS)
    + " FROM m GROUP BY ROLLUP (brand)) SELECT * EXCLUDE (total), coalesce(last_day - first_day + 1, 0)::BIGINT AS observed_days, CASE WHEN total = 1 THEN 'summary' WHEN broadcast >= 30 AND last_day - first_day + 1 >= 90 THEN 'eligible' WHEN broadcast >= 15 AND last_day - first_day + 1 >= 45 THEN 'within_50_percent' ELSE 'insufficient' END AS hook_gate FROM v",
    "cross_foot": """, p AS (SELECT count(*) AS parsed, count(DISTINCT message_id) AS kept FROM raw), e AS (SELECT brand, broadcast FROM rollup_rows WHERE seasonal_eligible), o AS (SELECT count(*) AS n FROM b SEMI JOIN e USING (brand) WHERE occasion IS NOT NULL),
        c AS (SELECT (SELECT count(*) FROM m) AS n, (SELECT count(*) FROM b) AS sent, (SELECT count(*) FROM m WHERE observed IS NULL) AS failed)
        SELECT name, l::BIGINT AS left_side, r::BIGINT AS right_side, CASE WHEN name LIKE 'seasonal_occasions%' THEN l <= r ELSE l = r END AS passed FROM (
            SELECT 'raw_equals_failures_plus_parsed' AS name, n AS l, failed + (SELECT count(*) FROM m WHERE observed IS NOT NULL) AS r FROM c
            UNION ALL SELECT 'parsed_equals_collapsed_plus_distinct', n, kept FROM c, p UNION ALL SELECT 'distinct_equals_scopes', n, (SELECT count(*) FROM m WHERE scope IN ('broadcast', 'lifecycle', 'uncertain')) FROM c
            UNION ALL SELECT 'broadcast_equals_quadrants', sent, (SELECT count(quadrant) FROM b) FROM c UNION ALL SELECT 'brand_broadcasts_equal_global', sent, (SELECT sum(broadcast) FROM rollup_rows) FROM c
            UNION ALL SELECT 'monthly_broadcasts_equal_global', sent, (SELECT count(observed) FROM b) FROM c
            UNION ALL SELECT 'promotion_axes_reconcile', (SELECT count(*) FROM b WHERE offer), (SELECT count(*) FROM b WHERE quadrant LIKE '%promotion') FROM c
            UNION ALL SELECT 'seasonal_axes_reconcile', (SELECT count(*) FROM b WHERE seasonal), (SELECT count(*) FROM b WHERE quadrant LIKE 'Seasonal%') FROM c
            UNION ALL SELECT 'seasonal_planner_brand_count_matches', (SELECT count(*) FROM e), (SELECT count(DISTINCT brand) FROM e) FROM c
            UNION ALL SELECT 'seasonal_planner_messages_equal_eligible_brands', coalesce((SELECT sum(broadcast) FROM e), 0), (SELECT count(*) FROM b SEMI JOIN e USING (brand)) FROM c
            UNION ALL SELECT 'seasonal_occasions_within_eligible_messages', (SELECT n FROM o), coalesce((SELECT sum(broadcast) FROM e), 0) FROM c)""",
    "findings": ", c AS (SELECT count(*) AS n, count(*) FILTER (quadrant = 'Evergreen content') AS q0, count(*) FILTER (quadrant = 'Everyday promotion') AS q1, count(*) FILTER (quadrant = 'Seasonal promotion') AS q2, count(*) FILTER (quadrant = 'Seasonal content') AS q3 FROM b), "
    "f AS (SELECT 'Evergreen content share' AS label, q0 AS numerator, n AS denominator FROM c UNION ALL SELECT 'Promotion share', q1 + q2, n FROM c UNION ALL SELECT 'Seasonal share', q2 + q3, n FROM c UNION ALL SELECT 'Seasonal messages carrying an offer', q2, q2 + q3 FROM c "
    "UNION ALL SELECT 'Brands with cadence and mix coverage', count(*) FILTER (hook_eligible), count(*) FROM rollup_rows) SELECT *, CASE WHEN denominator > 0 THEN numerator / denominator ELSE 0 END::DOUBLE AS share FROM f",
    "weekly_activity": ", e AS (SELECT min(received) AS f, max(received) AS l, max(received) - min(received) + 1 AS span FROM b), k AS (SELECT least(51, ((received - f) * 52) // span) AS bucket, count(*) AS n FROM b, e GROUP BY 1), "
    "w AS (SELECT i AS bucket, (f + ((i * span) // 52)::INT)::DATE AS start_day, least(l, f + greatest((i * span) // 52, ((i + 1) * span) // 52 - 1)::INT)::DATE AS end_day, coalesce(n, 0) AS messages FROM e, range(52) r(i) LEFT JOIN k ON k.bucket = r.i) "
    "SELECT *, CASE WHEN messages = 0 THEN 0 ELSE greatest(1, least(4, ceil(messages * 4 / max(messages) OVER ()))) END::INT AS level FROM w",
    "library_latest": ", k AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY observed DESC NULLS LAST, brand DESC, id DESC)::INT AS place FROM m) SELECT scope, place, id, brand, observed, coalesce(subject, '') AS subject, quadrant, intent, coalesce(occasion, '') AS occasion, coalesce(type, '') AS offer_type, reason AS scope_reason FROM k WHERE place <= 6",
    "offers_percent": "SELECT depth, count(*) AS messages FROM m WHERE type = '%off' GROUP BY 1",
    "seasonality": "SELECT occasion, count(*) AS messages FROM m GROUP BY 1",
    "seasonality_evidence": "SELECT id, coalesce(occasion, '') AS occasion, occasion_source AS source, occasion_confidence AS confidence FROM m",
    "dedupe_l1_source": "SELECT DISTINCT id FROM raw",
    "dedupe_l2_message_id": ", k AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY received, id) AS place FROM raw) SELECT id, message_id FROM k WHERE place = 1",
    "dedupe_report": "SELECT count(*) AS input, count(DISTINCT message_id) AS distinct, count(*) - count(DISTINCT message_id) AS collapsed FROM raw",
}
_RECURSIVE = MESSAGES.replace("WITH tpl", "WITH RECURSIVE tpl")
ORACLE_SQL = {k: MESSAGES + v for k, v in _ORACLE.items()} | {
    "dedupe_l3_content": _RECURSIVE + _leaders_sql("brand, content_hash", r", x AS (SELECT * REPLACE (lower(brand) AS brand), sha256(trim(regexp_replace(lower(coalesce(subject, '') || chr(10) || coalesce(preheader, '') || chr(10) || coalesce(visible_text, '')), '\s+', ' ', 'g'))) AS content_hash FROM raw)", R.CONTENT_DAYS),
    "dedupe_l4_campaign": _RECURSIVE + _leaders_sql("brand, campaign_id", ", x AS (SELECT * REPLACE (lower(brand) AS brand) FROM raw WHERE campaign_id IS NOT NULL)", R.CAMPAIGN_DAYS),
    "content_hash": r"SELECT doc_id, sha256(trim(regexp_replace(lower(concat_ws(chr(10), source, lang, text)), '[\t\n\x0B\f\r ]+', ' ', 'g'))) AS content_hash FROM documents",
    "content_hash_documents": r"SELECT doc_id, sha256(trim(regexp_replace(lower(concat_ws(chr(10), source, lang, text)), '[\t\n\x0B\f\r ]+', ' ', 'g'))) AS content_hash FROM documents",
    "normalize_domain": r"SELECT page_id, regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)', 1), '^www\.', ''), '\.+$', '') AS domain FROM pages",
    "normalize_url": r"""WITH n AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(url), '[.,;:!?)]+$', ''), '#.*$', ''), '/+$', '') AS u FROM pages),
        h AS (SELECT *, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1) AS head FROM n) SELECT page_id, lower(head) || substr(u, length(head) + 1) AS normal_url FROM h""",
    "redact_email_url": f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, {q(R.URL)}, '[url]', 'g'), {q(R.EMAIL)}, '[email]', 'g')) AS redacted_md5 FROM documents",
    "strip_payload_lines": r"SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(x) < 1000 AND NOT regexp_matches(x, '^\s*[.#@]?[a-zA-Z0-9_, -]+\{[^}]*\}\s*$')), chr(10))) AS kept_md5 FROM documents",
    "numeric_tokens": r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '\$?\d[\d,]*(?:\.\d+)?%?'), lambda x: regexp_replace(x, '[$,]', '', 'g')), ' ') AS numbers FROM documents",
    "secret_scan_three_rules": rf"""WITH h AS (SELECT doc_id, 'address' AS rule, unnest(regexp_extract_all(text, {q(R.EMAIL)})) AS hit FROM documents
        UNION ALL SELECT doc_id, 'hex_token', unnest(regexp_extract_all(text, '\b[0-9a-f]{{40}}\b')) FROM documents UNION ALL SELECT doc_id, 'long_number', unnest(regexp_extract_all(text, '\b[0-9]{{16}}\b')) FROM documents)
        SELECT doc_id, rule, count(*) AS matches, min(substr(sha256(hit), 1, 16)) AS first_hash FROM h GROUP BY 1, 2""",
    "capped_levels": "WITH c AS (SELECT event_type AS level, count(*) AS n FROM events GROUP BY 1), k AS (SELECT *, floor(sum(n) OVER () / 3)::BIGINT AS cap, coalesce(sum(n) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior FROM c) SELECT level, n, greatest(0, least(n, cap - prior))::BIGINT AS capped FROM k",
}

"""Queries of the release ledger, with DuckDB SQL but where that lacks lookarounds."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules as R
from .functions.spots import outside, searchable, spans, spots, wide
from .message_queries import _ITEMS, _NEWEST, _items, _sanitize_sql, _table, failures
from .operators import census, gallery, ledger, store
from .plans.messages import analyzed, messages
from .queries import MESSAGES, q, secret_scan_documents

NUMBER, CLAIM = r"\d[\d,]*(?:\.\d+)?", r"\$?\d[\d,]*(?:\.\d+)?\s*(?:%|percent)"


def _coverage(s: SparkSession, d: str) -> DataFrame:
    """The coverage table with completeness and errors of each brand and of all."""
    table = census.coverage_table(analyzed(s, d)).select("brand", "broadcast", "observed_days", "hook_gate")
    rows = messages(s, d).withColumn("source_completeness", F.when(F.col("source_type") == "curated_export", "curated_export").otherwise("complete"))
    bad = failures(s, d)
    everything = [df.unionByName(df.withColumn("brand", F.lit("TOTAL"))) for df in (rows.select("brand", "source_completeness"), bad.select("brand"))]
    state = store.completeness(*everything)
    errors = everything[1].groupBy("brand").agg(F.count(F.lit(1)).alias("errors"))
    return table.join(state, "brand", "left").join(errors, "brand", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))


def census_binding(s: SparkSession, d: str) -> DataFrame:
    return ledger.bind_coverage(census.brand_rollup(analyzed(s, d)), _coverage(s, d))


def coverage_gate(s: SparkSession, d: str) -> DataFrame:
    return ledger.complete_gate(_coverage(s, d)).select("brand", "source_completeness", "hook_gate")


def coverage_quadrants(s: SparkSession, d: str) -> DataFrame:
    """Messages by coverage quadrant; those of mailbox exports are not analyzed here."""
    seasonal = F.when(F.col("source_type") != "mbox", F.col("seasonal"))
    quadrant = F.coalesce(ledger.coverage_quadrant(F.col("scope"), F.col("offer"), seasonal), F.lit("unclassified"))
    return analyzed(s, d).groupBy(quadrant.alias("quadrant")).agg(F.count(F.lit(1)).alias("messages"))


def coverage_window(s: SparkSession, d: str) -> DataFrame:
    """The window that the windows of all sources span."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    windows = messages(s, d).groupBy("source_type").agg(iso(F.min("received_at")).alias("start"), iso(F.max("received_at")).alias("end"))
    return ledger.union_window(windows)


def batch_check(s: SparkSession, d: str) -> DataFrame:
    """Customers asked for by orders against those of the customer table."""
    expected, got = _table(s, d, "orders").select(F.col("o_custkey").alias("uid")), _table(s, d, "customer").select(F.col("c_custkey").alias("uid"))
    return ledger.batch_differences(expected, got.union(got.where("uid % 10 = 3")))


def occasion_gaps(s: SparkSession, d: str) -> DataFrame:
    """Brand and occasion pairs that the table of occasions has and the messages lack, or the other way round."""
    rows = analyzed(s, d)
    table = s.createDataFrame([(o,) for o, _ in R.OCCASIONS], "occasion string")
    expected = rows.select("brand").distinct().withColumn("_one", F.lit(1)).join(F.broadcast(table.withColumn("_one", F.lit(1))), "_one").select("brand", "occasion")
    return ledger.set_differences(expected, rows.where("occasion IS NOT NULL").select("brand", "occasion"))


def brands_beyond(s: SparkSession, d: str) -> DataFrame:
    """Brands of parts that are not on any seasonal planner."""
    return ledger.beyond(_table(s, d, "part").select(F.col("p_brand").alias("brand")), census.brand_rollup(analyzed(s, d)).where("seasonal_eligible"), "brand")


def brand_order(s: SparkSession, d: str) -> DataFrame:
    return ledger.ordered(census.brand_rollup(analyzed(s, d)).select("brand", "broadcast"), F.desc("broadcast"), F.lower("brand"))


def coverage_order(s: SparkSession, d: str) -> DataFrame:
    return ledger.ordered(census.coverage_table(analyzed(s, d)).where("brand <> 'TOTAL'").select("brand", "messages"), F.lower("brand"))


def top_occasions(s: SparkSession, d: str) -> DataFrame:
    return ledger.ordered(census.occasion_counts(analyzed(s, d)), F.desc("messages"), F.col("occasion"), most=12)


def nested_round_trip(s: SparkSession, d: str) -> DataFrame:
    return ledger.flat(ledger.nested(analyzed(s, d)))


def confidences(s: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise((F.get_json_object("props", "$.k").cast("double") / 50 - 0.5).cast("string"))
    return _table(s, d, "events").select("event_id", ledger.bounded_confidence(value).alias("confidence"))


def gallery_labels(s: SparkSession, d: str) -> DataFrame:
    rows = analyzed(s, d)
    label = F.when(F.col("source_type") == "mbox", F.upper(F.replace("quadrant", F.lit(" "), F.lit("_")))).when(F.col("source_type") == "curated_export", F.concat(F.lit(" "), "quadrant")).otherwise(F.col("intent"))
    day = F.concat(F.date_format("received", "yyyy-MM-"), F.when(F.col("source_type") == "mbox", "31").otherwise(F.date_format("received", "dd")))
    return rows.select("id", ledger.gallery_label(label).alias("label"), ledger.iso_day(day).alias("day"))


def brand_labels(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "documents").select("doc_id", ledger.first_present(F.col("lang"), F.col("text")).alias("brand"))


def date_skews(s: SparkSession, d: str) -> DataFrame:
    """Header dates, here the ship date moved by the order, against receipts."""
    rows = messages(s, d).withColumn("hours", F.split("message_id", "-")[0].cast("long") % 400 - 200)
    header = F.timestamp_add("HOUR", F.col("hours").cast("int"), F.col("received_at"))
    return rows.select("id", ledger.date_skew(header, F.col("received_at")).alias("e")).select("id", "e.days", "e.error")


def month_bounds(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "orders").select("o_orderkey", ledger.months_ago(F.col("o_orderdate").cast("timestamp"), 3, "UTC").alias("since"))


def gallery_synthetic(s: SparkSession, d: str) -> DataFrame:
    return ledger.synthetic_items(census.brand_rollup(analyzed(s, d)).select("brand", F.col("last_observed")))


def uncovered_numbers(s: SparkSession, d: str) -> DataFrame:
    """Numbers of each document that stand in no statement of a percentage.

    A statement may begin inside a number, whose beginning then stays, but never ends inside one; so what is left without statements is counted.
    """
    rows = _table(s, d, "documents").where(F.col("text").rlike(wide(r"\d")))
    left = F.regexp_replace(searchable(F.col("text")), wide(CLAIM), " ")
    return rows.select("doc_id", F.regexp_count(left, F.lit(wide(NUMBER))).cast("long").alias("numbers")).where("numbers > 0")


def numeric_occurrences(s: SparkSession, d: str) -> DataFrame:
    """Numbers of each document in one spelling, but those inside links, clock times, hashes and versions, with how often they stand there.

    Each text is decided by itself, in the few words around its digits; places are looked up only where such words hold an identifier.
    """
    rows = _table(s, d, "documents").where(F.col("text").rlike(wide(r"\d"))).select("doc_id", searchable(F.col("text")).alias("t"))
    words = rows.select("doc_id", F.explode(F.regexp_extract_all("t", F.lit(wide(R.NUMBERED_WORDS)), 0)).alias("w"))
    w = F.col("w")
    named = reduce(or_, [w.rlike(wide(p)) for p in R.IDENTIFIER_SPANS])
    apart = outside(spans(w, R.NUMBER), F.concat(*[spans(w, p) for p in R.IDENTIFIER_SPANS]))
    found = words.select("doc_id", F.explode(F.when(named, apart).otherwise(F.regexp_extract_all(w, F.lit(wide(R.NUMBER)), 0))).alias("found"))
    return found.groupBy("doc_id", ledger.number_token(F.col("found")).alias("token")).agg(F.count(F.lit(1)).alias("times"))


def classifier_payload(s: SparkSession, d: str) -> DataFrame:
    """The hashes of what a classifier outside may see of each document: source and text, redacted and cut."""
    fields = ledger.classifier_payload(F.col("source"), F.lit(None).cast("string"), F.col("text"))
    return _table(s, d, "documents").select("doc_id", fields.alias("p")).select("doc_id", F.md5("p.subject").alias("subject_md5"), F.md5("p.visible_text").alias("text_md5"))


def safe_payload(s: SparkSession, d: str) -> DataFrame:
    """What a classifier outside may see of each document by the full rules; no SQL, as RE2 has no lookarounds."""
    fields = ledger.safe_payload(F.col("source"), F.lit(None).cast("string"), F.col("text"))
    return _table(s, d, "documents").select("doc_id", fields.alias("p")).select("doc_id", "p.subject", "p.visible_text")


def failures_by_brand(s: SparkSession, d: str) -> DataFrame:
    return store.unique_failures(failures(s, d)).groupBy("brand").agg(F.count(F.lit(1)).alias("failures"))


def audit_rollup(s: SparkSession, d: str) -> DataFrame:
    """Matches and documents of each kind of finding in the scan of secrets."""
    kind = F.when(F.col("rule") == "synthetic_email_address", "synthetic").otherwise("violation")
    return secret_scan_documents(_table(s, d, "documents")).groupBy(kind.alias("kind"), "rule").agg(F.sum("matches").alias("matches"), F.count(F.lit(1)).alias("documents"))


def _stored(s: SparkSession, d: str) -> DataFrame:
    """Records as they might be stored: each message with the ids of the messages of its message_id."""
    rows = messages(s, d)
    same = rows.groupBy("message_id").agg(F.sort_array(F.collect_set("id")).alias("variant_ids"))
    return rows.dropDuplicates(["id"]).join(same, "message_id").select("id", "source_type", F.when(F.col("source_type") != "mbox", F.col("trusted")).alias("trusted"), F.lit(None).cast("string").alias("source_completeness"), "variant_ids")


def record_normalization(s: SparkSession, d: str) -> DataFrame:
    return ledger.normalized_records(_stored(s, d)).select("id", "trusted", "source_completeness", "variant_count", F.col("variant_ids")[0].alias("first_variant"))


def new_variants(s: SparkSession, d: str) -> DataFrame:
    """Messages that are no variant of a curated record."""
    return ledger.unseen_variants(messages(s, d).select("id"), _stored(s, d).where("source_type = 'curated_export'"))


def completeness_of_census(s: SparkSession, d: str) -> DataFrame:
    """Completeness as the census sees it, over messages that are not mailbox exports."""
    return ledger.census_completeness(analyzed(s, d).where("source_type <> 'mbox' AND trusted IS NOT NULL AND month(received) < 7").withColumn("parse_status", F.when(F.col("scope") == "uncertain", "failed")).withColumn("observed", F.col("received")))


def gallery_budget(s: SparkSession, d: str, most: int = 900) -> DataFrame:
    """The newest items of all brands within a budget, here of a few hundred bytes."""
    return ledger.within_budget(gallery.newest_items(_items(s, d)), most).select("brand", F.col("place").cast("long").alias("place"), "bytes")


QUERIES = {
    f.__name__: f
    for f in (census_binding, coverage_gate, coverage_quadrants, coverage_window, batch_check, occasion_gaps, brands_beyond, brand_order, coverage_order, top_occasions, nested_round_trip, confidences, gallery_labels, brand_labels, date_skews, month_bounds, gallery_synthetic, uncovered_numbers, numeric_occurrences, classifier_payload, safe_payload, failures_by_brand, audit_rollup, record_normalization, new_variants, completeness_of_census, gallery_budget)
}

_FAILED = "subject IS NULL AND trusted IS NULL AND campaign_id IS NULL"
_STATE = f"CASE WHEN bool_or({_FAILED}) THEN 'partial' WHEN bool_or(source_type = 'curated_export') THEN 'curated_export' ELSE 'complete' END"
ORACLE_SQL = {k: MESSAGES + v for k, v in {
    "census_binding": f", c AS (SELECT brand, {_STATE} AS state, count(*) FILTER ({_FAILED}) AS errors FROM raw GROUP BY 1), w AS (SELECT {_STATE} AS whole FROM raw) SELECT brand, CASE WHEN state <> 'complete' THEN state ELSE whole END AS source_completeness, errors AS ingestion_errors, broadcast >= 15 AND observed_days >= 45 AS early_gate_ready, whole = 'complete' AND hook_eligible AS hook_eligible FROM rollup_rows JOIN c USING (brand), w",
    "coverage_gate": f", c AS (SELECT CASE WHEN grouping(brand) = 1 THEN 'TOTAL' ELSE brand END AS brand, {_STATE} AS state FROM raw GROUP BY ROLLUP (brand)) SELECT brand, state AS source_completeness, CASE WHEN brand = 'TOTAL' THEN 'summary' WHEN hook_eligible AND state = 'complete' THEN 'eligible' WHEN broadcast >= 15 AND observed_days >= 45 THEN 'within_50_percent' ELSE 'insufficient' END AS hook_gate FROM c LEFT JOIN rollup_rows USING (brand)",
    "coverage_quadrants": " SELECT CASE WHEN scope = 'broadcast' AND source_type <> 'mbox' THEN quadrant ELSE 'unclassified' END AS quadrant, count(*) AS messages FROM m GROUP BY 1",
    "coverage_window": " SELECT strftime(min(received_at), '%Y-%m-%dT%H:%M:%SZ') AS start, strftime(max(received_at), '%Y-%m-%dT%H:%M:%SZ') AS \"end\" FROM raw",
    "occasion_gaps": f", e AS (SELECT DISTINCT brand, o.occasion FROM m, (VALUES {', '.join(f'({q(o)})' for o, _ in R.OCCASIONS)}) o(occasion)), h AS (SELECT DISTINCT brand, occasion FROM m WHERE occasion IS NOT NULL) SELECT *, 'left' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM h) UNION ALL SELECT *, 'right' FROM (SELECT * FROM h EXCEPT SELECT * FROM e)",
    "brands_beyond": " SELECT DISTINCT p_brand AS brand FROM part WHERE p_brand NOT IN (SELECT brand FROM rollup_rows WHERE seasonal_eligible)",
    "brand_order": " SELECT brand, broadcast, row_number() OVER (ORDER BY broadcast DESC, lower(brand)) AS place FROM rollup_rows",
    "coverage_order": " SELECT brand, distinct_messages AS messages, row_number() OVER (ORDER BY lower(brand)) AS place FROM rollup_rows",
    "top_occasions": " SELECT * FROM (SELECT occasion, count(*) AS messages, row_number() OVER (ORDER BY count(*) DESC, occasion) AS place FROM b SEMI JOIN (SELECT brand FROM rollup_rows WHERE seasonal_eligible) e USING (brand) WHERE occasion IS NOT NULL GROUP BY 1) WHERE place <= 12",
    "nested_round_trip": " SELECT id, scope, offer, type AS offer_type, depth, seasonal, occasion, intent, intent_confidence FROM m",
    "gallery_labels": ", l AS (SELECT id, quadrant, intent, source_type, strftime(received, '%Y-%m-') || CASE WHEN source_type = 'mbox' THEN '31' ELSE strftime(received, '%d') END AS day FROM m) SELECT id, CASE WHEN source_type IN ('mbox', 'curated_export') THEN quadrant ELSE 'Safe creative preview' END AS label, coalesce(strftime(try_cast(day AS DATE), '%Y-%m-%d'), '') AS day FROM l".replace("CASE WHEN source_type IN ('mbox', 'curated_export') THEN quadrant", "CASE WHEN source_type = 'mbox' AND quadrant = 'Evergreen content' THEN 'Safe creative preview' WHEN source_type IN ('mbox', 'curated_export') THEN quadrant"),
    "date_skews": ", h AS (SELECT id, abs(split_part(message_id, '-', 1)::BIGINT % 400 - 200) / 24 AS days FROM raw) SELECT id, round(days, 3) AS days, CASE WHEN days > 7 THEN 'header_date_skew_over_7_days' END AS error FROM h",
    "gallery_synthetic": " SELECT brand, i AS place, coalesce(strftime(last_observed, '%Y-%m-%d'), '') AS date, 'Synthetic ' || c || ' preview' AS category, sha256(brand || '|' || i) AS seed FROM rollup_rows, (VALUES (1::BIGINT, 'editorial'), (2, 'offer'), (3, 'seasonal')) k(i, c)",
    "failures_by_brand": f" SELECT brand, count(DISTINCT (source_type, id)) AS failures FROM raw WHERE {_FAILED} GROUP BY 1",
    "record_normalization": " SELECT DISTINCT id, CASE WHEN source_type = 'mbox' THEN false ELSE coalesce(trusted, true) END AS trusted, CASE WHEN source_type = 'curated_export' THEN source_type ELSE 'complete' END AS source_completeness, variants AS variant_count, id AS first_variant FROM raw JOIN (SELECT message_id, count(DISTINCT id) AS variants FROM raw GROUP BY 1) USING (message_id)",
    "new_variants": " SELECT id FROM raw WHERE message_id NOT IN (SELECT message_id FROM raw WHERE source_type = 'curated_export')",
    "completeness_of_census": " SELECT brand, CASE WHEN bool_or(scope = 'uncertain') THEN 'partial' WHEN bool_or(curated) THEN 'curated_export' ELSE 'complete' END AS source_completeness FROM m WHERE source_type <> 'mbox' AND trusted IS NOT NULL AND month(received) < 7 GROUP BY 1",
    "gallery_budget": _ITEMS + ", " + _NEWEST.format("items") + ", line AS (SELECT brand, place, bytes, row_number() OVER (ORDER BY lower(brand), brand, place) AS k FROM placed WHERE place <= 5), fold AS (SELECT 0::BIGINT AS k, 0::BIGINT AS total, '' AS ended, false AS kept UNION ALL SELECT l.k, CASE WHEN l.brand <> f.ended AND f.total + l.bytes <= 900 THEN f.total + l.bytes ELSE f.total END, CASE WHEN l.brand <> f.ended AND f.total + l.bytes > 900 THEN l.brand ELSE f.ended END, l.brand <> f.ended AND f.total + l.bytes <= 900 FROM fold f JOIN line l ON l.k = f.k + 1) SELECT brand, place, bytes FROM line JOIN fold USING (k) WHERE kept",
}.items()} | {
    "batch_check": "SELECT * FROM (SELECT 'missing' AS problem, o_custkey AS uid FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'unexpected' ELSE 'repeated' END, c_custkey FROM customer WHERE c_custkey % 10 = 3 OR c_custkey NOT IN (SELECT o_custkey FROM orders))",
    "confidences": "SELECT event_id, CASE WHEN event_type = 'error' THEN 0.8 ELSE greatest(0, least(1, (props::JSON ->> '$.k')::DOUBLE / 50 - 0.5)) END::DOUBLE AS confidence FROM events",
    "brand_labels": r"SELECT doc_id, coalesce(nullif(trim(regexp_replace(lang, '\s+', ' ', 'g')), ''), left(nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), ''), 120), 'Unknown brand') AS brand FROM documents",
    "month_bounds": "SELECT o_orderkey, (o_orderdate - INTERVAL 3 MONTH)::TIMESTAMP AS since FROM orders",
    "classifier_payload": "SELECT doc_id, " + ", ".join(f"md5(replace(replace(left({_sanitize_sql(f'coalesce({c}, chr(0))').replace('chr(0)', q(''))}, {n}), '[email]', '[redacted email]'), '[url]', '[redacted url]')) AS {a}" for c, n, a in (("source", R.PAYLOAD_CHARS[0], "subject_md5"), ("text", R.PAYLOAD_CHARS[2], "text_md5"))) + " FROM documents",
    "uncovered_numbers": rf"SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '{CLAIM}', ' ', 'g'), '{NUMBER}')) AS numbers FROM documents WHERE numbers > 0",
}
ORACLE_SQL["gallery_budget"] = ORACLE_SQL["gallery_budget"].replace("WITH tpl", "WITH RECURSIVE tpl")

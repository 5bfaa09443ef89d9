"""Queries of offers, scope and intent with evidence, privacy rules, the store, the gallery and release checks, each with DuckDB SQL.

The SQL of the derived messages rests on labels read from the rules by hand (queries.GOLDEN), not on the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import offers as O
from .functions import privacy as P
from .functions import rules as R
from .functions import safe
from .functions.lint import lint
from .functions import scoring as S
from .functions import text as X
from .operators import census, gallery, store
from .plans.messages import analyzed, messages, spread
from .queries import _SLUG, MESSAGES, q


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


FIELDS = ("subject", "preheader", "visible_text")


def offer_primary(s: SparkSession, d: str) -> DataFrame:
    return analyzed(s, d).where("offer").select("id", "primary.type", "primary.depth", "primary.source")


def offer_support_violations(s: SparkSession, d: str) -> DataFrame:
    """Claims of a percentage in the subject, one for each message, that the subject doesn't support."""
    rows = analyzed(s, d)
    claimed = F.coalesce("depth", F.lit(7.0))
    evidence = F.concat(claimed.cast("int").cast("string"), F.lit("% off"))
    claims = rows.select("id", *FIELDS, F.lit("%off").alias("type"), claimed.alias("depth"), F.lit("subject").alias("source"), evidence.alias("evidence"))
    return O.unsupported(claims).select("id", "depth")


def offers_dollar(s: SparkSession, d: str) -> DataFrame:
    found = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in R.OFFER_DOLLAR])
    return _table(s, d, "documents").select("doc_id", F.transform(found, lambda x: x.cast("double")).alias("f")).select("doc_id", F.size("f").cast("long").alias("offers"), F.array_max("f").alias("deepest"))


def offers_semantic(s: SparkSession, d: str) -> DataFrame:
    """Documents and which kinds of offer without a number they state, by the full rules: standing policies, denials and what lies beyond the window don't count."""
    empty = F.lit(None).cast("string")
    rows = O.with_offers(_table(s, d, "documents").select("doc_id", "text"), empty, empty, F.col("text"))
    kinds = F.transform("offers", lambda o: o["type"])
    return rows.select("doc_id", *[F.array_contains(kinds, k).alias(k) for k, _ in R.OFFER_SEMANTIC])


def offers_semantic_plain(s: SparkSession, d: str) -> DataFrame:
    """Whether a document has the plain wording of each kind, of those whose pattern RE2 can state."""
    return _table(s, d, "documents").select("doc_id", *[F.col("text").rlike(p).alias(k) for k, p in R.OFFER_SEMANTIC if k != "gift"])


def scope_classify(s: SparkSession, d: str) -> DataFrame:
    return analyzed(s, d).select("id", "scope_evidence.scope", "scope_evidence.reason", "scope_evidence.confidence")


def intent_scores(s: SparkSession, d: str) -> DataFrame:
    """What each message is about, offers apart."""
    rows = messages(s, d).fillna("", list(FIELDS))
    texts = rows.select(*FIELDS).distinct().repartition(int(s.conf.get("spark.sql.shuffle.partitions")), *FIELDS)
    scored = texts.withColumn("e", S.content_intent(*map(F.col, FIELDS)))
    return rows.join(scored, list(FIELDS)).select("id", "e.intent", "e.confidence")


def intent_documents(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "documents").select("doc_id", S.content_intent(F.col("source"), F.lit(""), F.col("text")).alias("e")).select("doc_id", "e.intent", "e.confidence")


def intent_with_offers(s: SparkSession, d: str) -> DataFrame:
    return analyzed(s, d).select("id", "intent", F.col("intent_confidence").alias("confidence"))


def pii_detect(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "documents").select("doc_id", F.inline(P.identifiers(F.col("text"))))


def sanitize_core(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "documents").select("doc_id", F.md5(P.sanitized(F.col("text"))).alias("sanitized_md5"))


def deny_terms(s: SparkSession, d: str) -> DataFrame:
    address = F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit(".")), F.lit("+news@"), F.lower("c_mktsegment"), F.lit(".example"))
    return _table(s, d, "customer").select("c_custkey", F.array_join(P.deny_terms(address), " ").alias("terms"))


def sanitize_documents(s: SparkSession, d: str) -> DataFrame:
    """Every whole text without direct identifiers; no SQL, as RE2 has no lookarounds (tests/test_safe.py holds its cases)."""
    return _table(s, d, "documents").select("doc_id", safe.safe_text(F.col("text")).alias("safe_text"))


def identifiers_documents(s: SparkSession, d: str) -> DataFrame:
    """What shows that a document holds an identifier, a row for each reason."""
    return _table(s, d, "documents").select("doc_id", F.explode(safe.direct_identifiers(F.col("text"))).alias("reason"))


def recipient_terms(s: SparkSession, d: str) -> DataFrame:
    header = F.concat(F.lit('"'), "c_name", F.lit('" <'), F.replace(F.lower("c_name"), F.lit("#"), F.lit(".")), F.lit("+news@x.example>, info@y.example"))
    return _table(s, d, "customer").select("c_custkey", F.array_join(safe.recipient_terms(F.array(header)), "|").alias("terms"))


def safe_brands(s: SparkSession, d: str) -> DataFrame:
    """Names of suppliers as senders write them; every third has none and is named by its domain."""
    name = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.replace("s_name", F.lit("#"), F.lit("* ")), F.lit(" Newsletter")))
    domain = F.concat(F.lit("news.house-"), F.col("s_suppkey").cast("string"), F.lit(".example"))
    return _table(s, d, "supplier").select("s_suppkey", safe.safe_brand(name, domain).alias("brand"))


def identifiers(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "pages").select("page_id", store.identifier("list", F.col("url")).alias("list_key"))


def unseen_sources(s: SparkSession, d: str) -> DataFrame:
    """Keys of event sources that never sent more than 90."""
    events = _table(s, d, "events")
    return store.unseen(events.select("event_type", "user_id"), events.where("value > 90"), ["event_type", "user_id"])


def brand_aliases(s: SparkSession, d: str) -> DataFrame:
    supplier, nation = _table(s, d, "supplier"), _table(s, d, "nation")
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_name").alias("sender_domain"), F.concat(F.lit(" "), F.lower("n_name")).alias("brand"))
    aliases = nation.where("n_regionkey < 3").select(F.col("n_name").alias("alias"), F.concat("n_name", F.lit(" Group")).alias("canonical")).union(supplier.where("s_acctbal > 5000").select("s_name", F.concat("s_name", F.lit(" Direct"))))
    return store.branded(rows, aliases).select("s_suppkey", "canonical_brand")


def pipeline_counts(s: SparkSession, d: str) -> DataFrame:
    return store.pipeline_counts(messages(s, d).groupBy("brand", "campaign_id").agg(F.count(F.lit(1)).alias("variant_count")))


def brand_ledger(s: SparkSession, d: str) -> DataFrame:
    rows = analyzed(s, d)
    return store.brand_ledger(records=rows, lifecycle=rows.where("scope = 'lifecycle'"), parts=_table(s, d, "part").select(F.col("p_brand").alias("brand")))


def failures_unique(s: SparkSession, d: str) -> DataFrame:
    events = _table(s, d, "events").select(F.col("event_type").alias("source_type"), F.col("user_id").alias("source_uid"), F.floor(F.col("value") / 50).alias("error_code"))
    return store.unique_failures(events).groupBy("source_type").agg(F.count(F.lit(1)).alias("failures"))


def failures(s: SparkSession, d: str) -> DataFrame:
    """Parse failures: the messages of no text whose trust is unknown. A row each: brand, source_type, source_uid, error_code."""
    rows = messages(s, d).where("subject IS NULL AND trusted IS NULL AND campaign_id IS NULL")
    return rows.select("brand", "source_type", F.col("id").alias("source_uid"), F.lit("empty").alias("error_code"))


def source_completeness(s: SparkSession, d: str) -> DataFrame:
    rows = messages(s, d).withColumn("source_completeness", F.when(F.col("source_type") == "curated_export", "curated_export").otherwise("complete"))
    return store.completeness(rows, failures(s, d))


def uid_batches(s: SparkSession, d: str) -> DataFrame:
    return store.batches(_table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("uid")))


def _items(s: SparkSession, d: str) -> DataFrame:
    subject = F.coalesce("subject", F.lit(""))
    return messages(s, d).select("brand", F.sha2(subject, 256).alias("sha256"), F.col("received").alias("date"), F.col("id").alias("path"), F.octet_length(subject).cast("long").alias("bytes"))


def gallery_newest(s: SparkSession, d: str) -> DataFrame:
    return gallery.newest_items(_items(s, d)).withColumn("place", F.col("place").cast("long"))


def gallery_states(s: SparkSession, d: str) -> DataFrame:
    return gallery.brand_states(_items(s, d), _table(s, d, "part").select(F.col("p_brand").alias("brand")))


def manifest_accounting(s: SparkSession, d: str) -> DataFrame:
    """Each message as a requested item: rendered where it is trusted, skipped where it is not, else failed, or pending if it has no text and no campaign."""
    one = lambda c: c.cast("long")
    unknown, waits = F.col("trusted").isNull(), F.col("subject").isNull() & F.col("campaign_id").isNull()
    of = {"rendered": F.coalesce("trusted", F.lit(False)), "skipped": F.coalesce(~F.col("trusted"), F.lit(False)), "failed": unknown & ~waits, "pending": unknown & waits}
    return gallery.accounting(messages(s, d).select("brand", F.lit(1).cast("long").alias("requested"), *[one(c).alias(n) for n, c in of.items()]))


def coverage_violations(s: SparkSession, d: str) -> DataFrame:
    """Brands of which some broadcasts are not classified yet: here those of mailbox exports."""
    rows = analyzed(s, d).withColumn("quadrant", F.when(F.col("source_type") != "mbox", F.col("quadrant")))
    return census.coverage_cross_foot(census.coverage_table(rows))


def verify_recompute(s: SparkSession, d: str) -> DataFrame:
    """Metrics frozen from the trusted messages alone that differ from those of all."""
    rows = analyzed(s, d)
    return census.frozen_differences(census.freeze_metrics(rows.where("observed IS NOT NULL")), census.freeze_metrics(rows))


def metric_tokens(s: SparkSession, d: str) -> DataFrame:
    """Frozen metrics as the numbers that a text may state; shares have a percent sign."""
    number = F.regexp_replace(F.regexp_replace(F.format_string("%.1f", "value"), r"\.0$", ""), ",", "")
    return census.freeze_metrics(analyzed(s, d)).select("metric", F.when(F.col("metric").endswith("_share"), F.concat(number, F.lit("%"))).otherwise(number).alias("token"))


def anaphora(s: SparkSession, d: str) -> DataFrame:
    """Documents and how many runs of three lines begin with the same two words; lines of fewer words don't count."""
    starts = F.filter(F.transform(F.split("text", "\n"), lambda x: F.lower(F.regexp_extract(x, r"^\s*([A-Za-z]+ [A-Za-z]+)", 1))), lambda x: x != "")
    rows = _table(s, d, "documents").select("doc_id", starts.alias("p"))
    runs = F.filter("p", lambda x, i: (i >= 2) & (F.get("p", i - 1) == x) & (F.get("p", i - 2) == x))
    return rows.select("doc_id", F.size(runs).cast("long").alias("runs")).where("runs > 0")


def text_lint(s: SparkSession, d: str) -> DataFrame:
    """Issues of every document by rule and line; no SQL, as RE2 has no lookarounds (tests/test_lint.py has it in plain Python)."""
    return _table(s, d, "documents").select("doc_id", F.inline(lint(F.col("text"), plain=True)))


QUERIES = {
    f.__name__: f
    for f in (offer_primary, offer_support_violations, offers_dollar, offers_semantic, offers_semantic_plain, scope_classify, intent_scores, intent_documents, intent_with_offers, pii_detect, sanitize_core, sanitize_documents, identifiers_documents, deny_terms, recipient_terms, safe_brands, text_lint, identifiers, unseen_sources, brand_aliases, pipeline_counts, brand_ledger, failures_unique, source_completeness, uid_batches, gallery_newest, gallery_states, manifest_accounting, coverage_violations, verify_recompute, metric_tokens, anaphora)
} | {
    "quadrant_table": lambda s, d: census.quadrant_table(analyzed(s, d)),
    "freeze_metrics": lambda s, d: census.freeze_metrics(analyzed(s, d)),
    "hook_selection": lambda s, d: census.hook_selection(analyzed(s, d)),
}


def _intent_sql(source: str, key: str, subject: str, body: str, preheader: str = "''") -> str:
    """Content intents of a source in SQL: points, first field and place of each rule, then the best rule."""
    count = lambda f, p: f"len(regexp_extract_all({f}, {q(p)}))"
    place = lambda f, p: f"length(regexp_extract({f}, {q('(?is)^(.*?)(?:' + p.removeprefix('(?i)') + ')')}, 1))"
    rules = []
    for rank, (label, p) in enumerate(R.INTENT_RULES):
        launch = f"CASE WHEN regexp_matches(f0 || chr(10) || f1, {q(R.SUBJECT_LAUNCH)}) THEN {R.LAUNCH_POINTS} ELSE 0 END" if not rank else "0"
        points = " + ".join(f"CASE WHEN {count(f, p)} > 0 THEN {w} + least({count(f, p)} - 1, {R.MOST_REPEATS}) * {R.REPEAT_POINTS} ELSE 0 END" for f, w in (("f0", 6.0), ("f1", 4.0), ("f2", 2.0)))
        field = f"CASE WHEN {count('f0', p)} > 0 THEN 0 WHEN {count('f1', p)} > 0 THEN 1 WHEN {count('f2', p)} > 0 THEN 2 WHEN {launch} > 0 THEN 0 END"
        at = f"CASE WHEN {count('f0', p)} > 0 THEN {place('f0', p)} WHEN {count('f1', p)} > 0 THEN {place('f1', p)} WHEN {count('f2', p)} > 0 THEN {place('f2', p)} ELSE 0 END"
        rules.append(f"SELECT {key}, {rank} AS rank, {q(label)} AS label, {points} + {launch} AS points, {field} AS field, {at} AS place FROM t")
    return f"""t AS (SELECT {key}, coalesce({subject}, '') AS f0, coalesce({preheader}, '') AS f1, left(coalesce({body}, ''), {R.INTENT_CHARS}) AS f2 FROM {source}), u AS ({" UNION ALL ".join(rules)}),
        v AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY points DESC, field, place, rank) AS k FROM u),
        content AS (SELECT {key}, CASE WHEN points = 0 THEN 'Featured products' ELSE label END AS intent, CASE WHEN points = 0 THEN 0.7 WHEN field < 2 THEN 0.9 ELSE 0.86 END::DOUBLE AS confidence FROM v WHERE k = 1)
    """  # fmt: skip


_ITEMS = ", items AS (SELECT brand, sha256(coalesce(subject, '')) AS sha256, received AS date, id AS path, strlen(coalesce(subject, '')) AS bytes FROM raw)"
_NEWEST = "once AS (SELECT *, row_number() OVER (PARTITION BY brand, sha256 ORDER BY date DESC, path DESC) AS k FROM {0}), placed AS (SELECT brand, sha256, date, path, bytes, row_number() OVER (PARTITION BY brand ORDER BY date DESC, path DESC) AS place FROM once WHERE k = 1)"
_SUMS = ", ".join(f"count(*) FILTER (quadrant = {q(x)}) AS {_SLUG[x]}" for x in R.QUADRANTS)
_SHARES = ("promotions", "seasonal", *(_SLUG[x] for x in R.QUADRANTS))
def _frozen(name: str, where: str) -> str:
    """A table name(metric, value) of the metrics of the messages where."""
    return f""", {name}_m AS (SELECT * FROM m WHERE {where}), {name}_b AS (SELECT * FROM {name}_m WHERE scope = 'broadcast'),
    {name}_c AS (SELECT (SELECT count(*) FROM {name}_m) AS distinct_messages, count(*) AS broadcast, (SELECT count(*) FROM {name}_m WHERE scope = 'lifecycle') AS lifecycle, (SELECT count(*) FROM {name}_m WHERE scope = 'uncertain') AS uncertain,
    count(DISTINCT brand) AS brands, {_SUMS}, count(*) FILTER (offer) AS promotions, count(*) FILTER (seasonal) AS seasonal, coalesce(max(observed) - min(observed) + 1, 0) AS observed_days FROM {name}_b),
    {name}_w AS (SELECT {", ".join(f"{c}::DOUBLE AS {c}" for c in ("distinct_messages", *R.SCOPES, "brands", *(_SLUG[x] for x in R.QUADRANTS), "promotions", "seasonal", "observed_days"))},
        {", ".join(f"round({c} * 100.0 / broadcast, 1)::DOUBLE AS {c}_share" for c in _SHARES)} FROM {name}_c),
    {name} AS (UNPIVOT {name}_w ON COLUMNS(*) INTO NAME metric VALUE value)"""  # fmt: skip


_FREEZE = _frozen("z", "true")


def _sanitize_sql(text: str) -> str:
    for _, pattern, placeholder in P.PRIVACY_RULES:
        text = f"regexp_replace({text}, {q(pattern)}, {q(placeholder)}, 'g')"
    return text


ORACLE_SQL = {k: MESSAGES + v for k, v in {
    "offer_primary": " SELECT id, type, depth, source FROM m WHERE offer",
    "offer_support_violations": " SELECT id, coalesce(depth, 7.0)::DOUBLE AS depth FROM m WHERE NOT contains(lower(coalesce(subject, '')), coalesce(depth, 7)::INT || '% off')",
    "scope_classify": " SELECT id, scope, reason, scope_confidence AS confidence FROM m",
    "intent_scores": ", " + _intent_sql("(SELECT * FROM raw)", "id", "subject", "visible_text", "preheader") + " SELECT * FROM content",
    "intent_with_offers": " SELECT id, intent, intent_confidence AS confidence FROM m",
    "pipeline_counts": " SELECT count(*) AS distinct_messages, sum(n - 1)::BIGINT AS collapsed, sum(n)::BIGINT AS parsed FROM (SELECT count(*) AS n FROM raw GROUP BY brand, campaign_id)",
    "brand_ledger": " SELECT brand, coalesce(r, 0) AS records, coalesce(l, 0) AS lifecycle, coalesce(p, 0) AS parts FROM (SELECT brand, count(*) AS r, count(*) FILTER (scope = 'lifecycle') AS l FROM m GROUP BY 1) FULL JOIN (SELECT p_brand AS brand, count(*) AS p FROM part GROUP BY 1) USING (brand)",
    "source_completeness": " SELECT brand, CASE WHEN f THEN 'partial' WHEN c THEN 'curated_export' ELSE 'complete' END AS source_completeness FROM (SELECT brand, bool_or(source_type = 'curated_export') AS c, bool_or(subject IS NULL AND trusted IS NULL AND campaign_id IS NULL) AS f FROM raw GROUP BY 1)",
    "gallery_newest": _ITEMS + ", " + _NEWEST.format("items") + f" SELECT * FROM placed WHERE place <= {R.GALLERY_KEPT}",
    "gallery_states": _ITEMS + ", " + _NEWEST.format("items") + f", n AS (SELECT brand, count(*) AS n FROM placed WHERE place <= {R.GALLERY_KEPT} GROUP BY 1) SELECT p.brand, coalesce(n, 0) AS shown, CASE WHEN n >= {R.GALLERY_READY} THEN 'ready' WHEN n > 0 THEN 'insufficient' ELSE 'unavailable' END AS state FROM (SELECT DISTINCT p_brand AS brand FROM part) p LEFT JOIN n USING (brand)",
    "manifest_accounting": " SELECT brand, count(*) AS requested, count(*) FILTER (trusted) AS rendered, count(*) FILTER (NOT trusted) AS skipped, count(*) FILTER (trusted IS NULL AND (subject IS NOT NULL OR campaign_id IS NOT NULL)) AS failed, count(*) FILTER (trusted IS NULL AND subject IS NULL AND campaign_id IS NULL) AS pending, bool_and(trusted IS NOT NULL OR subject IS NOT NULL OR campaign_id IS NOT NULL) AS balanced FROM raw GROUP BY 1",
    "coverage_violations": " SELECT CASE WHEN grouping(brand) = 1 THEN 'TOTAL' ELSE brand END AS brand, 'unclassified' AS broken FROM b WHERE source_type = 'mbox' GROUP BY ROLLUP (brand) HAVING count(*) > 0",
    "verify_recompute": _FREEZE + _frozen("y", "observed IS NOT NULL") + " SELECT metric, y.value AS frozen, z.value AS found FROM y JOIN z USING (metric) WHERE y.value <> z.value",
    "freeze_metrics": _FREEZE + " SELECT metric, value FROM z",
    "metric_tokens": _FREEZE + r" SELECT metric, regexp_replace(printf('%.1f', value), '\.0$', '') || CASE WHEN metric LIKE '%\_share' ESCAPE '\' THEN '%' ELSE '' END AS token FROM z",
    "quadrant_table": ", n AS (SELECT CASE WHEN grouping(quadrant) = 1 THEN 'Total' ELSE quadrant END AS quadrant, count(*) AS messages, min(observed) AS first_day, max(observed) AS last_day FROM b GROUP BY ROLLUP (quadrant)) SELECT x.quadrant, coalesce(messages, 0) AS messages, round(coalesce(messages, 0) * 100.0 / max(messages) OVER (), 1)::DOUBLE AS percent, first_day, last_day "
    + f"FROM (VALUES {', '.join(f'({q(x)})' for x in (*R.QUADRANTS, 'Total'))}) x(quadrant) LEFT JOIN n USING (quadrant)",
    "hook_selection": ", h AS (SELECT brand, broadcast FROM rollup_rows WHERE hook_eligible ORDER BY broadcast DESC, lower(brand) LIMIT 1), n AS (SELECT b.brand, quadrant, count(*) AS n, any_value(broadcast) AS denominator FROM b JOIN h USING (brand) GROUP BY 1, 2 ORDER BY n DESC, quadrant DESC LIMIT 1) SELECT brand, denominator, quadrant, n AS numerator, round(n * 100.0 / denominator, 1)::DOUBLE AS percent FROM n",
}.items()} | {
    "offers_dollar": f"SELECT doc_id, len(f) AS offers, list_max(f) AS deepest FROM (SELECT doc_id, list_transform(list_concat({', '.join(f'regexp_extract_all(text, {q(p)}, 1)' for p in R.OFFER_DOLLAR)}), lambda x: x::DOUBLE) AS f FROM documents)",
    "offers_semantic_plain": "SELECT doc_id, " + ", ".join(f"regexp_matches(text, {q(dict(R.OFFER_SEMANTIC)[k])}) AS {k}" for k in ("bogo", "bundle", "free_shipping")) + " FROM documents",
    "intent_documents": "WITH " + _intent_sql("documents", "doc_id", "source", "text") + " SELECT * FROM content",
    "pii_detect": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, {q(n)} AS rule, len(regexp_extract_all(text, {q(p)})) AS matches FROM documents" for n, p, _ in P.PRIVACY_RULES) + ") WHERE matches > 0",
    "sanitize_core": f"SELECT doc_id, md5({_sanitize_sql('text')}) AS sanitized_md5 FROM documents",
    "deny_terms": r"SELECT c_custkey, array_to_string(list_filter(string_split(replace(lower(c_name), '#', '.'), '.'), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '\d+')), ' ') AS terms FROM customer",
    "identifiers": "SELECT page_id, CASE WHEN trim(url) <> '' THEN 'list:' || sha256('list' || chr(0) || lower(trim(url))) END AS list_key FROM pages",
    "unseen_sources": "SELECT DISTINCT event_type, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.value > 90 AND s.event_type = e.event_type AND s.user_id = e.user_id)",
    "brand_aliases": "SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN s_name || ' Direct' WHEN n_regionkey < 3 THEN n_name || ' Group' ELSE lower(n_name) END AS canonical_brand FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "failures_unique": "SELECT source_type, count(*) AS failures FROM (SELECT DISTINCT event_type AS source_type, user_id, floor(value / 50) AS e FROM events) GROUP BY 1",
    "recipient_terms": "SELECT c_custkey, replace(lower(c_name), '#', ' ') || '|' || lower(c_name) AS terms FROM customer",
    "safe_brands": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'House ' || s_suppkey ELSE replace(s_name, '#', ' ') END AS brand FROM supplier",
    "uid_batches": "SELECT o_custkey AS uid, (row_number() OVER (ORDER BY o_custkey) - 1) // 200 AS batch FROM (SELECT DISTINCT o_custkey FROM orders)",
    "anaphora": r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(regexp_extract(x, '^\s*([A-Za-z]+ [A-Za-z]+)', 1))), lambda x: x <> '') AS p FROM documents),
        r AS (SELECT doc_id, len(list_filter(range(3, len(p) + 1), lambda i: p[i] = p[i - 1] AND p[i] = p[i - 2])) AS runs FROM p) SELECT doc_id, runs FROM r WHERE runs > 0""",
}

"""Campaign messages derived from lineitem and part, their classification, and the store of it that all reports read.

These rows are fixtures: no ratio found in them says anything about real mail.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scoring as S
from ..functions.offers import CANDIDATE, with_offers
from ..functions.spots import searchable
from ..functions.text import quadrant_of
from ..shared import hadoop, kept, load_store, passing, save_store, written

#: Bytes of distinct texts and their wording that may go to all tasks, and bytes of a wording as taken for that.
SENT_BYTES, TEXT_BYTES = 64_000_000, 700
LONG = "Every piece is measured twice and cut once by hand in a quiet room near the river. " * 6
#: Subject, preheader and body; {p} is the part's name, {n} the line's percentage.
TEMPLATES = (
    ("Take {n}% off {p}", "Today only", "Shop the range."),
    ("Save {n}% on {p}", "", "A note from the product team."),
    ("Save {n}% more water with {p}", "", "Field notes."),
    ("$10 off your next {p}", "", "Use it this week."),
    ("BOGO on every {p}, plus {n}% off", "", ""),
    ("Meet the new {p}", "Now available", "Just dropped this morning."),
    ("How it works: {p}", "The science of fit", "Learn about the material."),
    ("A letter about {p}", "Our story so far", "Our mission goes on."),
    ("Loved by runners: {p}", "Five-star reviews inside", ""),
    ("Upgrade your {p}", "Subscribe and save", ""),
    ("Pairs with your {p}", "Complete the look", ""),
    ("The travel edit: {p}", "What to wear", ""),
    ("A {p} in three colours", "", ""),
    ("Black Friday: {n}% off {p}", "", "Doors open at nine."),
    ("Black Friday reading list", "", "A {p} on every page."),
    ("Your {p} notes", "Ring in 2026 with us", ""),
    ("Season's greetings", "", "From all of us and a {p}."),
    ("Gifts for mom: {p}", "", ""),
    ("The gift guide: {p}", "", ""),
    ("Gift guide for mum: {p}", "The mum's gift guide", ""),
    ("Summer collection: {p}", "", ""),
    ("Autumn arrivals", "Shop {p}", ""),
    ("Spring walks", "A {p} for the sale", ""),
    ("Welcome to the club", "", "Meet {p}."),
    ("Welcome to summer", "Shop {p}", ""),
    ("Welcome aboard", "Join our team", "A {p} for every role."),
    ("Your order is confirmed", "", "Thank you for choosing {p}."),
    ("A note about {p}", "", "Your order has shipped and your payment is confirmed."),
    ("News of {p}", "", "Your welcome code is ready."),
    ("News of the {p}", "", "This offer is waiting."),
    ("Free shipping this week on {p}", "", ""),
    ("About {p}", "", "Free shipping on all orders."),
    ("About this {p}", "", "Free shipping ends tonight."),
    ("Final sale notes for {p}", "", ""),
    ("Deals and news: {p}", "", ""),
    ("A discount is not available on {p}", "", ""),
    ("Why we make {p}", "The science behind it", "Made with care. {n}% off this week."),
    ("Introducing {p}", "", LONG + "Take {n}% off."),
    ("Free gift with purchase of {p}", "", ""),
    ("Bundle and save: {p}", "", ""),
    ("Halloween at our place", "Early access to {p}", ""),
    ("", "", ""),
)


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to all cores where the scan has fewer tasks than that, as a file of one row group has; else rows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line: keys, source, dates, trust, the texts, and what a curated export says of them."""
    lines = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_discount", "l_returnflag", "l_linestatus"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand")
    line, order, flag = F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_returnflag")
    template = F.element_at(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(t, S.FIELDS)]) for t in TEMPLATES]), ((order + 3 * line + F.col("l_suppkey")) % len(TEMPLATES) + 1).cast("int"))
    percent = (F.round(F.col("l_discount") * 100) + 5).cast("int").cast("string")
    filled = lambda name: F.nullif(F.replace(F.replace(F.col(f"_template.{name}"), F.lit("{n}"), percent), F.lit("{p}"), F.col("p_name")), F.lit(""))
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    bulk, curated = order % 5 != 0, line == 7
    minutes = ((order * 37 + line * 11) % 1440).cast("int")
    joined = lines.withColumn("_template", template).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.concat_ws("-", *key, F.date_format("l_shipdate", "yyyyMMdd")).alias("id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("message_id"),
        F.when(bulk, F.concat_ws("-", "l_partkey", "l_suppkey")).alias("campaign_id"), F.col("p_brand").alias("brand"), F.to_date("l_shipdate").alias("received"),
        F.timestamp_add("MINUTE", minutes, F.col("l_shipdate").cast("timestamp")).alias("received_at"),
        F.when(curated, "curated_export").when(line == 6, "mbox").otherwise("imap").alias("source_type"),
        F.when(line != 5, F.col("l_linestatus") != "O").alias("trusted"), *[filled(n).alias(n) for n in S.FIELDS],
        F.when(curated & (flag == "A"), "other").alias("curated_offer"), F.when(curated & (flag == "R"), "summer").alias("curated_occasion"), F.when(curated, "upsell").alias("curated_intent"),
    )


def wording(texts: DataFrame) -> DataFrame:
    """The three text columns and all that depends on them alone: scope_wording, season_hints, offers, primary, content, thesis."""
    fields = [F.col(n) for n in S.FIELDS]
    rows = with_offers(texts, *fields).withColumns({"scope_wording": S.scope_wording(*fields), "season_hints": S.season_hints(*fields), "content": S.content_intent(*fields)})
    return rows.withColumn("thesis", S.content_thesis(*fields, F.col("content"), F.col("primary")))


def worded_once(rows: DataFrame) -> DataFrame:
    """rows with the wording of their texts, each distinct text searched once.

    The distinct texts are written; few of them go to all tasks, so no row is shuffled however many share them. Else rows
    meet them on two hashes, and the texts themselves come back with the wording.
    """
    key = [F.xxhash64(*S.FIELDS).alias("_text"), F.xxhash64(F.lit(1), *S.FIELDS).alias("_again")]
    texts = rows.select(*S.FIELDS).distinct().repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = kept(wording(texts).select("*", *key), "wording")
    if (known.agg(F.sum(F.length(F.concat(*S.FIELDS)) + TEXT_BYTES)).first()[0] or 0) <= SENT_BYTES:
        known = F.broadcast(known)
    names = [c for c in rows.columns if c not in S.FIELDS]
    made = [c for c in known.columns if c not in ("_text", "_again", *S.FIELDS)]
    return rows.select(*names, *key).join(known, ["_text", "_again"]).select(*rows.columns, *made)


def named(value: Column, names: tuple[str, ...]) -> Column:
    """The name that value spells, whatever its case, else null."""
    return F.coalesce(*[F.when(F.lower(F.trim(value)) == n.lower(), F.lit(n)) for n in names])


def classified(rows: DataFrame, once: bool = True) -> DataFrame:
    """rows with scope, offers, seasonality, intent, quadrant and observed (the trusted date).

    Bulk are messages with list headers (bulk, list_id); where a table has no such columns, those with a campaign id. A message
    that holds others of which none is surely its own (ambiguous) has an uncertain scope.
    once: equal texts, as the copies of one campaign are, are searched once and joined back; else each row by itself.
    Curated exports keep their scope, and what they say of offers (without numbers), occasions and intents counts where
    the texts give nothing.
    """
    if once:
        rows = worded_once(rows.fillna("", list(S.FIELDS)))
    else:
        rows = wording(rows)
    curated = F.col("source_type") == "curated_export"
    fallback = F.when(curated & F.col("primary").isNull() & F.col("curated_offer").isin(*R.OFFER_TYPES), F.struct(F.col("curated_offer").alias("type"), F.lit(None).cast("double").alias("depth"), F.lit("other").alias("unit"), F.lit("curated_export").alias("source"), F.lit("").alias("evidence"), F.lit(0.8).alias("confidence"), F.lit(0).alias("position")).cast(CANDIDATE))
    occasion = named(F.col("curated_occasion"), (*(o for o, _ in R.OCCASIONS), "Spring", "Summer", "Fall", "Winter"))
    given = F.struct(F.lit(True).alias("seasonal"), occasion.alias("occasion"), F.lit("curated_export").alias("source"), F.lit("").alias("evidence"), F.lit(0.8).alias("confidence"))
    kept = F.struct(F.lit("broadcast").alias("scope"), F.lit("curated_export").alias("reason"), F.lit(1.0).alias("confidence"))
    listed = [F.col(c).isNotNull() for c in ("campaign_id", "list_id") if c in rows.columns and not ("bulk" in rows.columns and c == "campaign_id")]
    bulk = reduce(or_, [*([F.coalesce("bulk", F.lit(False))] if "bulk" in rows.columns else []), *listed])
    unclear = F.struct(F.lit("uncertain").alias("scope"), F.lit("embedded_message_ambiguous").alias("reason"), F.lit(0.99).alias("confidence"))
    worded = S.scope_of(F.col("scope_wording"), bulk)
    if "ambiguous" in rows.columns:
        worded = F.when(F.col("ambiguous"), unclear).otherwise(worded)
    rows = rows.withColumns({
        "scope_evidence": F.when(curated, kept).otherwise(worded), "primary": F.coalesce("primary", fallback),
        "season": S.seasonality(F.col("season_hints"), F.month("received")), "observed": F.when(F.coalesce("trusted", F.col("source_type") != "mbox"), F.col("received")),
    })
    rows = rows.withColumns({"season": F.when(curated & ~F.col("season.seasonal") & occasion.isNotNull(), given).otherwise(F.col("season")), "offer": F.col("primary").isNotNull()})
    guessed = F.when(F.col("content.intent") == "Featured products", named(F.col("curated_intent"), R.INTENTS))
    offered = F.struct(F.lit("Promotion/offer").alias("intent"), F.col("primary.confidence").alias("confidence"))
    own = F.when(F.col("offer"), offered).when(guessed.isNotNull(), F.struct(guessed.alias("intent"), F.lit(0.8).alias("confidence"))).otherwise(F.struct("content.intent", "content.confidence"))
    found = F.when(curated, own).otherwise(S.intent_of(F.col("content"), F.col("primary"), F.col("thesis")))
    rows = rows.withColumns({
        "scope": F.col("scope_evidence.scope"), "depth": F.col("primary.depth"), "seasonal": F.col("season.seasonal"), "occasion": F.nullif(F.col("season.occasion"), F.lit("")),
        "intent": found["intent"], "intent_confidence": found["confidence"],
    })
    return rows.withColumn("quadrant", quadrant_of(F.col("offer"), F.col("seasonal"))).drop("scope_wording", "season_hints", "content", "thesis")


#: What classified adds to a message.
ANALYSIS = ("offers", "primary", "scope_evidence", "season", "observed", "offer", "scope", "depth", "seasonal", "occasion", "intent", "intent_confidence", "quadrant")
_STORES: dict[tuple, str] = {}


def stored_once(spark: SparkSession, sf_dir: str, name: str, made: Callable[[], DataFrame]) -> DataFrame:
    """made(), from a table that is written once for each session, name and state of the files (path, size, time) of the message tables under sf_dir."""
    state = []
    for table in ("lineitem", "part"):
        fs, path = hadoop(spark, f"{sf_dir}/{table}.parquet")
        files = fs.listFiles(path, True)
        while files.hasNext():
            file = files.next()
            state.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    state.sort()
    key = (spark.sparkContext.applicationId, sf_dir, name, *state)
    if key not in _STORES:
        with passing(spark) as folders:
            _STORES[key] = written(made(), name)
            folders.remove(_STORES[key])  # it stays, what it was made of goes
    return spark.read.parquet(_STORES[key])


def analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classified messages, written once; reports read the columns they need."""
    return stored_once(spark, sf_dir, "classified", lambda: classified(messages(spark, sf_dir)))


def analysis_rules() -> dict[str, Column]:
    """Breaches that stop a save of classified messages: a broadcast without a quadrant, or one against its axes, and a number that no text supports."""
    known = F.coalesce(F.col("quadrant").isin(*R.QUADRANTS), F.lit(False))
    field = F.coalesce(*[F.when(F.col("primary.source") == n, searchable(F.coalesce(F.col(n), F.lit("")))) for n in S.FIELDS], F.lit(""))
    numeric = F.col("primary.depth").isNotNull() & (F.col("primary.source") != "curated_export")
    return {
        "no quadrant": ~known, "a quadrant against its axes": known & (F.col("quadrant") != quadrant_of(F.col("offer"), F.col("seasonal"))),
        "a depth that its field doesn't state": F.coalesce(numeric & ~F.contains(F.lower(field), F.lower("primary.evidence")), F.lit(False)),
        "an offer without a kind": F.col("offer") != F.col("primary").isNotNull(),
    }


def reanalyzed(spark: SparkSession, root: str) -> DataFrame:
    """Classify all messages of the last save under root anew, and save them as its next version, which is returned.

    What an earlier analysis added goes first. The store must have messages; if one is lost on the way, or one breaks analysis_rules,
    nothing is saved.
    """
    rows = load_store(spark, root)
    if rows is None or rows.isEmpty():
        raise ValueError(f"{root} has no messages")
    return spark.read.parquet(save_store(classified(rows.drop(*ANALYSIS)), root, rules=analysis_rules(), rows=rows.count()))

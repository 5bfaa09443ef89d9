"""A classifier from outside, asked once for each distinct text, and what its answers change.

Its answers are kept by the hash of the model's name and the payload that it may see. A run asks only for what the cache lacks, in
batches on the executors, and publishes new answers together; what fails is a row of its own and leaves no answer, so
the next run asks again. Nothing that the classifier does can fail a message.

Edge cases: null fields are empty ones; only broadcasts are sent; an answer outside the allowed values falls back to the
neutral one; an empty table asks nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..commits import Commits
from ..functions import rules as R
from ..functions.text import quadrant_of
from ..shared import kept
from .ledger import safe_payload

FIELDS = ("subject", "preheader", "visible_text")
ANSWER = "key string, intent string, uniqueness int, benefit_theme string, offer_type string, bucket int"
ASKED = "key string, intent string, uniqueness int, benefit_theme string, offer_type string, error string"
# The neutral intent and what may be changed, the confidences of answers, characters of a theme, bounds of uniqueness.
NEUTRAL, NEUTRAL_CONFIDENCE, INTENT_CONFIDENCE, OFFER_CONFIDENCE, THEME_CHARS = "Featured products", 0.7, 0.8, 0.65, 80
LEAST_UNIQUE, MIDDLE_UNIQUE, MOST_UNIQUE = 1, 3, 5
PROMOTION = "Promotion/offer"
BUCKETS, FOLDERS = 64, 32


class Classifier(Protocol):
    """Anything with a model name that answers a batch of payloads (dicts of FIELDS): a dict, or an exception, for each."""

    model: str

    def classify(self, payloads: list[dict[str, str]]) -> list[dict | Exception]: ...


def sound(answer: dict) -> tuple[str, int, str, str]:
    """The answer with all values inside what is allowed."""
    intent, offer = str(answer.get("intent") or NEUTRAL), str(answer.get("offer_type") or "none")
    try:
        unique = max(LEAST_UNIQUE, min(MOST_UNIQUE, int(answer.get("uniqueness", MIDDLE_UNIQUE))))
    except (TypeError, ValueError):
        unique = MIDDLE_UNIQUE
    return intent if intent in R.INTENTS else NEUTRAL, unique, str(answer.get("benefit_theme") or "").strip()[:THEME_CHARS], offer if offer in R.OFFER_TYPES else "none"


def payload_key(model: str, payload: Column) -> Column:
    """SHA-256 of the canonical form of model and payload."""
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), payload.alias("payload"))), 256)


def asking(classifier: Classifier) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task that asks for its rows (key, and the payload's fields) batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ASKED.split(", ")]
        for batch in batches:
            payloads = batch[list(FIELDS)].to_dict("records")
            try:
                answers = list(classifier.classify(payloads))
                if len(answers) != len(payloads):
                    raise ValueError("answers are missing")
            except Exception as error:  # whatever a classifier raises is noted for its whole batch
                answers = [error] * len(payloads)
            out = []
            for key, answer in zip(batch["key"], answers):
                try:
                    out.append((key, *((None,) * 4 if isinstance(answer, Exception) else sound(answer)), type(answer).__name__ if isinstance(answer, Exception) else None))
                except Exception as error:  # an answer that is no dict
                    out.append((key, None, None, None, None, type(error).__name__))
            yield pd.DataFrame(out, columns=names)

    return run


def answers(spark: SparkSession, payloads: DataFrame, classifier: Classifier, root: str) -> tuple[DataFrame, DataFrame, int]:
    """Answers (by key) and failures (key, error) for distinct payloads (key, FIELDS), and how many were asked for."""
    commits = Commits(spark, root)
    base = commits.last()
    wanted = kept(payloads.dropDuplicates(["key"]).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")), "payloads")
    cached = commits.read(base, "answers", ANSWER)
    missing = kept(wanted.join(cached.select("key", "bucket"), ["key", "bucket"], "left_anti"), "missing")
    asked = missing.count()
    if not asked:
        return cached.drop("bucket"), spark.createDataFrame([], "key string, error string"), 0
    got = kept(missing.select("key", *FIELDS).mapInPandas(asking(classifier), ASKED), "asked")
    new = got.where("error IS NULL").drop("error").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    folders = list(base.tables.get("answers", []))
    if len(folders) >= FOLDERS:
        new, folders = cached.unionByName(new), []
    made = commits.publish(base, {"answers": [*folders, commits.write(new, "answers", by=("bucket",))]}, {"asked": asked})
    return commits.read(made, "answers", ANSWER).drop("bucket"), got.where("error IS NOT NULL").select("key", "error"), asked


def refined(rows: DataFrame, classifier: Classifier | None, root: str) -> DataFrame:
    """Classified rows with what the classifier says of broadcasts: model, uniqueness, benefit_theme and analysis_errors, and intent and offer changed by it.

    Its intent counts; its kind of offer only where the rules found none, and then the intent is a promotion. What a
    curated export says of itself stays as it is. Without a classifier nothing changes.
    """
    extra = {"model": "string", "uniqueness": "int", "benefit_theme": "string", "analysis_errors": "array<string>"}
    if classifier is None:
        return rows.withColumns({n: F.lit(None).cast(t) for n, t in extra.items()})
    spark = rows.sparkSession
    sent = F.col("scope") == "broadcast"
    texts = rows.where(sent).select(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in FIELDS]).distinct()
    keyed = texts.select(*[F.col(n).alias(f"_{n}") for n in FIELDS], safe_payload(*[F.col(n) for n in FIELDS]).alias("payload")).withColumn("_key", payload_key(classifier.model, F.col("payload")))
    keyed = kept(keyed, "keys")
    found, bad, _ = answers(spark, keyed.select(F.col("_key").alias("key"), "payload.*"), classifier, root)
    said = keyed.drop("payload").join(found.select(F.col("key").alias("_key"), F.struct("intent", "uniqueness", "benefit_theme", "offer_type").alias("_said")), "_key", "left").join(bad.select(F.col("key").alias("_key"), "error"), "_key", "left")
    same = [F.coalesce(rows[n], F.lit("")) == said[f"_{n}"] for n in FIELDS]
    both = rows.join(said, [rows["scope"] == "broadcast", *same], "left")
    curated, given = F.coalesce(F.col("source_type") == "curated_export", F.lit(False)), F.col("_said").isNotNull()
    offered = given & ~F.col("offer") & (F.col("_said.offer_type") != "none") & ~curated
    made = F.struct(F.col("_said.offer_type").alias("type"), F.lit(None).cast("double").alias("depth"), F.lit("other").alias("unit"), F.lit("ai").alias("source"), F.lit("").alias("evidence"), F.lit(OFFER_CONFIDENCE).alias("confidence"), F.lit(0).alias("position"))
    out = both.withColumns({
        "primary": F.when(offered, made.cast(rows.schema["primary"].dataType)).otherwise(F.col("primary")), "offer": F.col("offer") | offered,
        "intent": F.when(curated | ~given, F.col("intent")).when(offered, PROMOTION).otherwise(F.col("_said.intent")),
        "intent_confidence": F.when(curated | ~given, F.col("intent_confidence")).otherwise(F.lit(INTENT_CONFIDENCE)),
        "model": F.when(given, F.lit(classifier.model)), "uniqueness": F.col("_said.uniqueness"), "benefit_theme": F.col("_said.benefit_theme"),
        "analysis_errors": F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("AI classification unavailable: "), "error"))),
    })
    out = out.withColumn("quadrant", quadrant_of(F.col("offer"), F.col("seasonal")))
    return out.select(*rows.columns, *extra)

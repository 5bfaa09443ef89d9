"""Scope with evidence, seasonality and scored intents, as column expressions.

Each has a part that depends on a message's texts alone, so that equal texts are searched once, and a part that adds
what belongs to the message: its bulk headers, its month, its offer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .spots import first_and_count, searchable, stripped, wide

FIELDS = ("subject", "preheader", "visible_text")


def said(text: Column, pattern: str) -> Column:
    return text.rlike(wide(pattern))


def any_of(patterns: list[str]) -> str:
    """One pattern for all, which spares most texts the single ones."""
    return "(?im)(?:" + "|".join(p.partition(")")[2] for p in patterns) + ")"


def scope_wording(subject: Column, preheader: Column, body: Column) -> Column:
    """struct(label, confidence, empty, marketing): lifecycle wording in the headline fields, then in the body's lead."""
    head = F.concat_ws("\n", searchable(subject), searchable(preheader))
    lead = F.left(searchable(body), F.lit(R.LEAD_CHARS))
    both = F.concat_ws("\n", head, lead)

    def first(text: Column, table: list, confidence: float) -> Column:
        named = [F.when(said(text, p) & ~said(both, R.RECRUITING) if x == "welcome" else said(text, p), F.struct(F.lit(x).alias("label"), F.lit(confidence).alias("confidence"))) for x, p in table]
        return F.when(said(text, any_of([p for _, p in table])), F.coalesce(*named))

    label = F.coalesce(first(head, list(R.SCOPE_RULES), 0.96), first(lead, [r for r in R.SCOPE_RULES if r[0] in R.LEAD_LABELS], 0.91), F.when(said(lead, R.WELCOME_STATE), F.struct(F.lit("welcome").alias("label"), F.lit(0.91).alias("confidence"))))
    return F.struct(label.alias("lifecycle"), (stripped(both) == "").alias("empty"), said(both, R.MARKETING_LEAD).alias("marketing"))


def scope_of(wording: Column, bulk: Column) -> Column:
    """struct(scope, reason, confidence): lifecycle wording, then bulk headers, then marketing words."""
    verdict = lambda scope, reason, confidence: F.struct(F.lit(scope).alias("scope"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"))
    life = wording["lifecycle"]
    named = F.struct(F.lit("lifecycle").alias("scope"), F.concat(F.lit("lifecycle:"), life["label"]).alias("reason"), life["confidence"].alias("confidence"))
    rest = F.when(wording["empty"], verdict("uncertain", "insufficient_scope_evidence", 0.45)).when(bulk, verdict("broadcast", "bulk_or_list_header", 0.96)).when(wording["marketing"], verdict("broadcast", "marketing_content", 0.72)).otherwise(verdict("uncertain", "insufficient_scope_evidence", 0.55))
    return F.when(life.isNotNull(), named).otherwise(rest)


def scope_evidence(subject: Column, preheader: Column, body: Column, bulk: Column) -> Column:
    """struct(scope, reason, confidence) of a message."""
    return scope_of(scope_wording(subject, preheader, body), bulk)


def season_hints(*fields: Column) -> Column:
    """What the texts say of occasions, whatever the month: explicit ones, gifts for mothers, gift guides, season words next to trade."""
    texts = list(zip(FIELDS, map(searchable, fields)))
    hint = lambda occasion, source, evidence: F.struct(occasion.alias("occasion"), F.lit(source).alias("source"), stripped(evidence).alias("evidence"))
    found = lambda text, pattern: F.regexp_extract(text, wide(pattern), 0)

    def explicit(source: str, text: Column) -> Column:
        named = [F.when(said(text, p), hint(F.lit(occasion), source, found(text, p))) for occasion, p in R.OCCASIONS]
        return F.when(said(text, any_of([p for _, p in R.OCCASIONS])), F.coalesce(*named))

    def loose(occasion: str, pattern: str) -> Column:
        return F.coalesce(*[F.when(said(t, pattern), hint(F.lit(occasion), s, found(t, pattern))) for s, t in texts])

    seasons = F.array_compact(F.array(*[F.when(said(t, R.SEASON_WORD) & said(t, R.SEASON_CONTEXT), hint(F.lower(found(t, R.SEASON_WORD)), s, found(t, R.SEASON_WORD))) for s, t in texts]))
    return F.struct(F.coalesce(*[explicit(s, t) for s, t in texts]).alias("explicit"), loose("Mother's Day", R.MOTHERS_GIFT).alias("mothers"), loose("Holiday gifting", R.HOLIDAY_GIFT).alias("gifts"), seasons.alias("seasons"))


def seasonality(hints: Column, month: Column) -> Column:
    """struct(seasonal, occasion, source, evidence, confidence). An explicit occasion counts in any month, the others only in theirs; without a month none of these does."""
    fits = lambda word: reduce(lambda a, b: a | b, [(word == w) & month.isin(*months) for w, _, months in R.SEASONS])
    season = F.get(F.filter(hints["seasons"], lambda h: F.coalesce(fits(h["occasion"]), F.lit(False))), F.lit(0))
    named = F.coalesce(*[F.when(season["occasion"] == w, F.lit(label)) for w, label, _ in R.SEASONS])
    timely = F.coalesce(
        F.when(month.isin(*R.MOTHERS_MONTHS), hints["mothers"]), F.when(month.isin(*R.GIFT_MONTHS) & hints["mothers"].isNull(), hints["gifts"]),
        F.when(season.isNotNull(), F.struct(named.alias("occasion"), season["source"].alias("source"), season["evidence"].alias("evidence"))),
    )
    made = lambda h, confidence: F.struct(F.lit(True).alias("seasonal"), h["occasion"].alias("occasion"), h["source"].alias("source"), h["evidence"].alias("evidence"), F.lit(confidence).alias("confidence"))
    none = F.struct(F.lit(False).alias("seasonal"), F.lit("").alias("occasion"), F.lit("").alias("source"), F.lit("").alias("evidence"), F.lit(1.0).alias("confidence"))
    return F.when(hints["explicit"].isNotNull(), made(hints["explicit"], 1.0)).when(timely.isNotNull(), made(timely, 0.9)).otherwise(none)


def content_intent(subject: Column, preheader: Column, body: Column) -> Column:
    """struct(intent, confidence, field): the label of most points; ties go to the earliest wording, then to the order of the rules.

    A field gives its points once, and a little more for repeats; field counts from 0, 9 where no rule applies. Each
    pattern passes over a field once.
    """
    fields = [searchable(subject), searchable(preheader), F.left(searchable(body), F.lit(R.INTENT_CHARS))]
    launch = said(F.concat_ws("\n", *fields[:2]), R.SUBJECT_LAUNCH)
    hits = F.array(*[F.array(*[first_and_count(f, p) for f in fields]) for _, p in R.INTENT_RULES])

    def scored(hit: Column, rank: Column) -> Column:
        points = reduce(lambda a, b: a + b, [F.when(hit[i]["n"] > 0, w + F.least(hit[i]["n"] - 1, F.lit(R.MOST_REPEATS)) * R.REPEAT_POINTS).otherwise(0.0) for i, w in enumerate(R.INTENT_WEIGHTS)])
        field = F.coalesce(*[F.when(hit[i]["n"] > 0, i) for i in range(3)])
        place = F.coalesce(*[F.when(hit[i]["n"] > 0, hit[i]["at"]) for i in range(3)])
        lead = (rank == 0) & launch
        return F.struct((points + F.when(lead, R.LAUNCH_POINTS).otherwise(0.0)).alias("points"), (-F.coalesce(field, F.when(lead, 0))).alias("field"), (-F.coalesce(place, F.lit(0))).alias("place"), (-rank).alias("rank"))

    best = F.aggregate(F.transform(hits, scored), F.lit(None).cast("struct<points:double,field:int,place:int,rank:int>"), lambda a, b: F.greatest(a, b))
    labels = F.array(*[F.lit(x) for x, _ in R.INTENT_RULES])
    found = lambda b: F.struct(F.element_at(labels, 1 - b["rank"]).alias("intent"), F.when(b["field"] > -2, 0.9).otherwise(0.86).alias("confidence"), (-b["field"]).alias("field"))
    none = F.struct(F.lit("Featured products").alias("intent"), F.lit(0.7).alias("confidence"), F.lit(9).alias("field"))
    return F.get(F.transform(F.array(best), lambda b: F.when(b["points"] > 0, found(b)).otherwise(none)), F.lit(0))


def content_thesis(subject: Column, preheader: Column, body: Column, content: Column, primary: Column) -> Column:
    """Whether a message argues for something else and its offer, in the body, is an aside."""
    taught = (content["intent"] == "Ingredient/education") & said(F.concat_ws("\n", searchable(subject), searchable(preheader)), R.EDUCATIONAL_SUBJECT) & said(F.left(searchable(body), F.lit(900)), dict(R.INTENT_RULES)["Ingredient/education"])
    late = (primary["evidence"] != "") & (F.instr(F.lower(searchable(body)), F.lower(primary["evidence"])) > 400)
    return F.coalesce((primary["source"] == "visible_text") & (content["intent"] != "Featured products") & (content["field"] < 2) & (taught | late), F.lit(False))


def intent(subject: Column, preheader: Column, body: Column, primary: Column) -> Column:
    """struct(intent, confidence) with the primary offer: an offer decides unless the message has another thesis."""
    found = content_intent(subject, preheader, body)
    return intent_of(found, primary, content_thesis(subject, preheader, body, found, primary))


def intent_of(content: Column, primary: Column, thesis: Column) -> Column:
    offered = F.struct(F.lit("Promotion/offer").alias("intent"), F.lit(1.0).alias("confidence"))
    return F.when(primary.isNotNull() & ~thesis, offered).otherwise(F.struct(content["intent"].alias("intent"), content["confidence"].alias("confidence")))

"""Offers of a message, as column expressions.

Every pattern gives the places of its matches (see spots). What the words near a match say against it is a table of
rules, each with the kinds of offer, words and fields that it is for, the view of the text that it looks at, and a
pattern; one evaluator applies them all. Candidates are then ranked by sorting structs.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .spots import searchable, spots, stripped, wide

SOURCES = ("subject", "preheader", "visible_text")
BODY = SOURCES[2]
CANDIDATE = "struct<type:string,depth:double,unit:string,source:string,evidence:string,confidence:double,position:int>"
#: Kind, unit, greatest depth (0: no number), patterns; in order of appearance.
KINDS = (("%off", "percent", 99, R.OFFER_PERCENT), ("$off", "dollar", 10_000, R.OFFER_DOLLAR), *((kind, "other", 0, (pattern,)) for kind, pattern in R.OFFER_SEMANTIC))


class Against(NamedTuple):
    """A reason why a match is no offer: view is before, after, around or line, or from (reach is a place then)."""

    view: str
    reach: tuple[int, int]
    pattern: str
    kinds: tuple[str, ...] = R.OFFER_TYPES
    words: tuple[str, ...] = ()
    sources: tuple[str, ...] = SOURCES
    unless: str = ""


NEAR, ANYWHERE = (R.NEAR_CHARS, R.NEAR_CHARS), r"(?s)."
_STANDING = {"kinds": ("free_shipping",), "sources": (BODY,), "unless": R.SHIPPING_CAMPAIGN}
AGAINST = (
    Against("after", NEAR, R.DENIED_AFTER),
    Against("before", NEAR, R.DENIED_BEFORE),
    Against("line", NEAR, R.FINAL_SALE, ("other",), R.POLICY_NOUNS),
    Against("after", NEAR, R.STACKED_AFTER, ("other",), R.POLICY_NOUNS),
    Against("before", NEAR, R.STACKED_BEFORE, ("other",), R.POLICY_NOUNS),
    Against("around", R.DEALS_AROUND, R.NEWS_DEALS, ("other",), ("deal", "deals")),
    Against("around", NEAR, ANYWHERE, ("other",), ("savings",), (BODY,)),
    Against("around", R.CAMPAIGN_AROUND, R.SHIPPING_POLICY, **_STANDING),
    Against("line", NEAR, rf"(?i)^(?:{R.SHIPPING_PERK.removeprefix('(?i)')})$", **_STANDING),
    Against("from", (R.POLICY_FROM, 0), ANYWHERE, **_STANDING),
)


def view(text: Column, spot: Column, kind: str, reach: tuple[int, int]) -> Column:
    at, end = spot["at"], spot["at"] + F.length(spot["found"])
    if kind == "line":
        return F.concat(F.substring_index(F.left(text, at), "\n", -1), spot["found"], F.substring_index(F.substr(text, end + 1), "\n", 1))
    before = F.substr(text, F.greatest(at - reach[0], F.lit(0)) + 1, F.least(at, F.lit(reach[0])))
    after = F.substr(text, end + 1, F.lit(reach[1]))
    return {"before": before, "after": after}.get(kind, F.concat(before, spot["found"], after))


def stands(text: Column, spot: Column, kind: str, source: str) -> Column:
    """Whether nothing in the table speaks against a match."""
    out = []
    for rule in AGAINST:
        if kind in rule.kinds and source in rule.sources:
            said = spot["at"] >= rule.reach[0] if rule.view == "from" else view(text, spot, rule.view, rule.reach).rlike(wide(rule.pattern))
            if rule.words:
                said = F.lower(stripped(spot["found"])).isin(*rule.words) & said
            if rule.unless:
                said = said & ~view(text, spot, "around", R.CAMPAIGN_AROUND).rlike(wide(rule.unless))
            out.append(~said)
    return reduce(lambda a, b: a & b, out)


def candidates(text: Column, source: str, kind: str, unit: str, most: int, pattern: str, confidence: float = 1.0) -> Column:
    """The matches of one pattern that stand."""
    depth = (lambda s: F.regexp_extract(s["found"], wide(pattern), 1).cast("double")) if most else (lambda s: F.lit(None).cast("double"))
    given = spots(text, pattern)
    kept = F.filter(given, lambda s: depth(s).between(1, most) & stands(text, s, kind, source)) if most else F.filter(given, lambda s: stands(text, s, kind, source))
    made = lambda s: F.struct(F.lit(kind).alias("type"), depth(s).alias("depth"), F.lit(unit).alias("unit"), F.lit(source).alias("source"), stripped(s["found"]).alias("evidence"), F.lit(confidence).alias("confidence"), s["at"].alias("position"))
    return F.transform(kept, made).cast(f"array<{CANDIDATE}>")


def numeric(text: Column, source: str) -> Column:
    """Candidates with a number."""
    return F.concat(*[candidates(text, source, kind, unit, most, p) for kind, unit, most, patterns in KINDS if most for p in patterns])


def specific(text: Column, source: str) -> Column:
    """All candidates but general words of sale."""
    found = [candidates(text, source, kind, unit, most, p) for kind, unit, most, patterns in KINDS for p in patterns]
    if source != BODY:
        found.append(candidates(text, source, "gift", "other", 0, R.OFFER_FREE_ITEM))
    return F.concat(*found)


def general(text: Column, source: str) -> Column:
    return candidates(F.left(text, F.lit(R.GENERIC_CHARS)) if source == BODY else text, source, "other", "other", 0, R.OFFER_GENERIC, 0.95)


def ranked(rows: DataFrame, column: str) -> DataFrame:
    """rows with the candidates in column once for each (type, source, evidence), best first.

    A bogo next to a number comes first, then numbers, bogo and gift, the headline fields and the rest; then by field
    and place. Each step is a projection of its own, so that none is evaluated once for each element of another.
    """
    rows = rows.withColumn(column, F.transform(column, lambda o, i: F.struct(F.concat_ws("\0", o["type"], o["source"], F.lower(o["evidence"])).alias("key"), i.alias("i"), o.alias("o"))))
    rows = rows.withColumn(column, F.filter(column, lambda x: F.array_position(F.transform(column, lambda y: y["key"]), x["key"]) == x["i"] + 1))

    def keyed(x: Column) -> Column:
        o = x["o"]
        beside = F.exists(column, lambda y: y["o"]["depth"].isNotNull() & (y["o"]["source"] == o["source"]) & (F.abs(y["o"]["position"] - o["position"]) <= R.BOGO_NEAR))
        strength = F.when(o["depth"].isNotNull(), 0).when(o["type"].isin("bogo", "gift"), 1).when(o["source"] != BODY, 2).when(o["type"] == "other", 3).otherwise(4)
        place = F.array_position(F.array(*map(F.lit, SOURCES)), o["source"])
        return F.struct(F.when((o["type"] == "bogo") & beside, 0).otherwise(1).alias("a"), strength.alias("b"), place.alias("c"), o["position"].alias("d"), x["i"].alias("e"), o.alias("o"))

    return rows.withColumn(column, F.transform(F.array_sort(F.transform(column, keyed)), lambda x: x["o"]))


def with_offers(rows: DataFrame, subject: Column, preheader: Column, body: Column) -> DataFrame:
    """rows with offers, the ranked candidates of the three fields, and primary, the first of them or null."""
    names = list(rows.columns)
    texts = (searchable(subject), searchable(preheader), F.left(searchable(body), F.lit(R.OFFER_CHARS)))
    staged = rows.withColumns({f"_t{i}": t for i, t in enumerate(texts)})
    staged = staged.withColumns({f"_f{i}": specific(F.col(f"_t{i}"), s) for i, s in enumerate(SOURCES)})
    either = [F.when(F.size(f"_f{i}") > 0, F.col(f"_f{i}")).otherwise(general(F.col(f"_t{i}"), s)) for i, s in enumerate(SOURCES)]
    return ranked(staged.select(*names, F.concat(*either).alias("offers")), "offers").withColumn("primary", F.get("offers", F.lit(0)))


def unsupported(claims: DataFrame) -> DataFrame:
    """Claims (type, depth, source, evidence, and the three fields) that their evidence doesn't support.

    The source must be one of the fields, the evidence must stand in it whatever its case, and the evidence alone must
    give the same type and depth.
    """
    field = F.coalesce(*[F.when(F.col("source") == s, F.coalesce(F.col(s), F.lit(""))) for s in SOURCES])
    rows = claims.withColumns({"_field": field, "_evidence": searchable(stripped(F.col("evidence")))})
    rows = rows.withColumn("_again", numeric(F.col("_evidence"), SOURCES[0]))
    again = F.exists("_again", lambda o: (o["type"] == F.col("type")) & (o["depth"] == F.col("depth")))
    fine = F.col("_field").isNotNull() & (F.col("_evidence") != "") & F.contains(F.lower("_field"), F.lower("_evidence")) & again
    return rows.where(F.col("depth").isNotNull() & ~F.coalesce(fine, F.lit(False))).drop("_field", "_evidence", "_again")

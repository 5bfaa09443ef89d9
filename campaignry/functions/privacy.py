"""Redaction of direct identifiers and their detector, as column expressions from one table of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

# Rules in order of precedence, with the placeholder that replaces a match. No placeholder matches a rule.
PRIVACY_RULES = (
    ("merge_tag", r"\{\{[^{}]{0,200}\}\}|\*\|[^|]{1,100}\|\*|%%[^%\s]{1,60}%%", "[merge tag]"),
    ("mailto", r"(?i)\bmailto:[^\s<>\[\]\"']+", "[email]"),
    ("url", R.URL, "[url]"),
    ("email", R.EMAIL, "[email]"),
    ("token", r"(?i)\b(?:token|sid|uid|session|password|secret|api[_-]?key)\s*[=:]\s*[a-z0-9._~+/-]{8,}=*", "[token]"),
    ("card", r"\b[0-9](?:[ -]?[0-9]){12,18}\b", "[number]"),
    ("phone", r"(?:\+[0-9]{1,3}[ .-]?)?\(?\b[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b", "[phone]"),
    ("order_id", r"(?i)\b(?:order|account|member|invoice)\s*(?:number|no\.?|id|#)\s*:?\s*#?[a-z0-9-]*[0-9][a-z0-9-]*", "[identifier]"),
    ("greeting", r"(?m)^(?:Hi|Hello|Dear|Hey) [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?,", "Hello,"),
    ("opaque", r"\b[0-9a-f]{32,}\b", "[token]"),
)


def sanitized(text: Column) -> Column:
    """All rules applied in order; a second application changes nothing."""
    return reduce(lambda out, rule: F.regexp_replace(out, rule[1], rule[2].replace("$", r"\$")), PRIVACY_RULES, text)


def identifiers(text: Column) -> Column:
    """array of struct(rule, matches) of the rules that match."""
    counts = F.array(*[F.struct(F.lit(name).alias("rule"), F.regexp_count(text, F.lit(pattern)).cast("long").alias("matches")) for name, pattern, _ in PRIVACY_RULES])
    return F.filter(counts, lambda x: x["matches"] > 0)


def deny_terms(address: Column, stop: tuple[str, ...] = ("info", "mail", "hello", "news", "team")) -> Column:
    """Words of an address's local part, before any plus sign, that must not appear in a text: three letters or more, not numbers, longest first."""
    words = F.split(F.regexp_replace(F.split(F.split(F.lower(address), "@")[0], r"\+")[0], r"[._-]+", " "), " ")
    kept = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*stop) & ~w.rlike(r"^\d+$")))
    return F.transform(F.array_sort(F.transform(kept, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])

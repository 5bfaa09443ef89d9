"""What a text should not say, with the line of each place, as column expressions over tables of rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lint_rules as R
from .safe import let, says
from .spots import folded, searchable, signed, spots, wide

#: The first two words of a line in lower case; what a word has taken it doesn't give back.
TWO_WORDS = rf"({R.LEAD_WORD}+)[^a-z]*+({R.LEAD_WORD}+)"
ISSUES = "array<struct<rule:string,line:int>>"


def issue(rule: str, line: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), line.cast("int").alias("line"))


def repeated_leads(text: Column) -> Column:
    """The first line of each three in a row that begin with the same two words; lines of fewer words don't count."""

    def lead(line: Column, i: Column) -> Column:
        low = F.lower(F.regexp_replace(line, wide(R.LINE_LEAD), ""))
        words = lambda x: F.when(x.rlike(TWO_WORDS), F.concat_ws(" ", F.regexp_extract(x, TWO_WORDS, 1), F.regexp_extract(x, TWO_WORDS, 2)))
        return let(let(low, words), lambda w: F.when(w.isNotNull(), F.struct((i + 1).alias("line"), w.alias("lead"))))

    def runs(leads: Column) -> Column:
        same = lambda x, i: (i >= R.SAME_LEADS - 1) & (F.get(leads, i - 1)["lead"] == x["lead"]) & (F.get(leads, i - 2)["lead"] == x["lead"])
        marked = F.transform(leads, lambda x, i: F.when(same(x, i), issue("anaphora", F.get(leads, i - 2)["line"])))
        return F.filter(marked, lambda x: x.isNotNull())

    lines = F.split(F.regexp_replace(text, r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]", "\n"), "\n")
    return let(F.filter(F.transform(lines, lead), lambda x: x.isNotNull()), runs)


def lint(text: Column, plain: bool = False) -> Column:
    """array of struct(rule, line): every match of every rule, rules in order, then repeated leads.

    plain texts may have no bold or italic marks either, which are reported once, without a line. A text of white space
    alone, as null is, has the one issue empty_artifact.
    """

    def judged(x: Column) -> Column:
        t, low = x["text"], x["low"]

        def places(rule: str, pattern: str) -> Column:
            found = F.transform(spots(t, pattern), lambda s: issue(rule, F.regexp_count(F.left(t, s["at"]), F.lit("\n")) + 1))
            return F.when(signed(low, R.SIGNS[rule]) & says(t, pattern), found).otherwise(F.array().cast(ISSUES))

        parts = [places(*rule) for rule in (*R.PLACEHOLDERS, *R.TOKENS, *R.PHRASES)] + [repeated_leads(t)]
        if plain:
            parts += [F.when(signed(low, R.SIGNS[rule]) & says(t, p), F.array(issue(rule, F.lit(None)))).otherwise(F.array().cast(ISSUES)) for rule, p in R.FORMATTING]
        return F.when(t.rlike(r"\S"), F.concat(*parts)).otherwise(F.array(issue("empty_artifact", F.lit(None))))

    return let(let(searchable(text), lambda t: F.struct(t.alias("text"), folded(t).alias("low"))), judged)

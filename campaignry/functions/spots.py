"""All matches of a pattern in a text with their places, as column expressions; Spark has no function for that.

Matches are marked by one pass of regexp_replace with two private characters, and places are the running lengths of the
parts between them, so a text is searched once for each pattern.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "\ue000", "\ue001"


def wide(pattern: str) -> str:
    """The pattern with Unicode classes, and only a line feed as the end of a line."""
    flags = re.match(r"\(\?([a-z]+)\)", pattern)
    return f"(?{flags[1]}Ud){pattern[flags.end() :]}" if flags else f"(?Ud){pattern}"


def folded(text: Column) -> Column:
    """The text in lower case, with the four letters beyond ASCII that patterns take for one of ASCII, if case doesn't count, as that one."""
    odd = reduce(or_, [F.contains(text, F.lit(c)) for c in "\u0130\u0131\u017f\u212a"])
    return F.lower(F.when(odd, F.translate(text, "\u0130\u0131\u017f\u212a", "iisk")).otherwise(text))


def signed(low: Column, signs: tuple[tuple[str, ...], ...]) -> Column:
    """Whether a folded text holds one string of each tuple. Looking for strings takes a small part of the time of a pattern, so a rule is tried only where its signs stand."""
    return reduce(and_, [reduce(or_, [F.contains(low, F.lit(s)) for s in any_of]) for any_of in signs], F.lit(True))


def searchable(text: Column) -> Column:
    """The text, empty for null, with blanks for the two marks."""
    return F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, "  ")


def parts(text: Column, pattern: str) -> Column:
    """What precedes the first match, then for each match itself, a mark and what follows it up to the next."""
    return F.split(F.regexp_replace(text, wide(pattern), f"{OPEN}$0{CLOSE}"), OPEN)


def spots(text: Column, pattern: str) -> Column:
    """array of struct(at, found): every match, with the characters before it."""
    start = F.struct(F.lit(-1).alias("next"), F.array().cast("array<struct<at:int,found:string>>").alias("spots"))

    def step(state: Column, part: Column) -> Column:
        here = F.struct(state["next"].alias("at"), F.substring_index(part, CLOSE, 1).alias("found"))
        later = F.struct((state["next"] + F.length(part) - 1).alias("next"), F.array_append(state["spots"], here).alias("spots"))
        return F.when(state["next"] < 0, F.struct(F.length(part).alias("next"), state["spots"].alias("spots"))).otherwise(later)

    return F.aggregate(parts(text, pattern), start, step, lambda state: state["spots"])


def spans(text: Column, pattern: str) -> Column:
    """array of struct(start, end, found): every match, with the characters before it and up to its end."""
    return F.transform(spots(text, pattern), lambda x: F.struct(x["at"].alias("start"), (x["at"] + F.length(x["found"])).alias("end"), x["found"].alias("found")))


def outside(tokens: Column, covers: Column) -> Column:
    """What was found as tokens that no span of covers contains. Both are spans() of one text.

    In order of start, covers first, a token is contained if the greatest end of covers so far reaches its own: no pair of both is formed.
    """
    tagged = lambda array, tag: F.transform(array, lambda x: F.struct(x["start"].alias("start"), F.lit(tag).alias("tag"), x["end"].alias("end"), x["found"].alias("found")))
    begin = F.struct(F.lit(-1).alias("reach"), F.array().cast("array<string>").alias("left"))

    def step(state: Column, x: Column) -> Column:
        wider = F.struct(F.greatest(state["reach"], x["end"]).alias("reach"), state["left"].alias("left"))
        more = F.struct(state["reach"].alias("reach"), F.array_append(state["left"], x["found"]).alias("left"))
        return F.when(x["tag"] == 0, wider).when(x["end"] <= state["reach"], state).otherwise(more)

    return F.aggregate(F.array_sort(F.concat(tagged(covers, 0), tagged(tokens, 1))), begin, step, lambda state: state["left"])


def first_and_count(text: Column, pattern: str) -> Column:
    """struct(n, at): how many matches, and the characters before the first one."""
    return F.aggregate(
        parts(text, pattern), F.struct(F.lit(-1).alias("n"), F.lit(0).alias("at")),
        lambda state, part: F.struct((state["n"] + 1).alias("n"), F.when(state["n"] < 0, F.length(part)).otherwise(state["at"]).alias("at")),
    )


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, wide(r"^\s+|\s+$"), "")

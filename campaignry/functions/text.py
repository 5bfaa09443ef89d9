"""Text classifiers and redactions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


def quadrant_of(offer: Column, seasonal: Column) -> Column:
    return F.when(offer & seasonal, R.QUADRANTS[2]).when(offer, R.QUADRANTS[1]).when(seasonal, R.QUADRANTS[3]).otherwise(R.QUADRANTS[0])


def coverage_level(days: Column) -> Column:
    return reduce(lambda out, r: out.when(days < r[0], r[1]), R.COVERAGE_LEVELS[1:], F.when(days < R.COVERAGE_LEVELS[0][0], R.COVERAGE_LEVELS[0][1])).otherwise("yoy")


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts in lower case, lines joined, white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(F.concat_ws("\n", *parts)), r"\s+", " ")), 256)


def redacted(text: Column) -> Column:
    """URLs and addresses as placeholders."""
    return F.regexp_replace(F.regexp_replace(text, R.URL, "[url]"), R.EMAIL, "[email]")


def without_payload_lines(text: Column) -> Column:
    """Lines of 1000 characters or more, and lines of style rules, go."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.length(x) < 1000) & ~x.rlike(r"^\s*[.#@]?[a-zA-Z0-9_, -]+\{[^}]*\}\s*$"))
    return F.array_join(lines, "\n")


def normal_domain(url: Column) -> Column:
    """Host in lower case, without user, port, www. and trailing dots."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"\.+$", "")


def normal_url(url: Column) -> Column:
    """Trailing punctuation, fragment and trailing slashes go; scheme and host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), r"[.,;:!?)]+$", ""), r"#.*$", ""), r"/+$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))


def numeric_tokens(text: Column) -> Column:
    """Numbers of a text without signs of money and thousands, percentages kept as such."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\$?\d[\d,]*(?:\.\d+)?%?)"), 1), lambda x: F.regexp_replace(x, r"[$,]", ""))

"""What a reader sees of an HTML page, as column expressions: no row of text leaves the JVM.

Comments, declarations, scripts and styles go first. The page is then cut at the tags of hidden elements, whose depth is
counted over those tags alone, and only what lies at depth zero stays. Tags that begin or end a block become line feeds, all others
a mark that keeps what they part from running together until the character references are decoded.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that readers don't see, and those that begin and end lines.
HIDDEN = ("head", "script", "style", "svg", "template", "noscript")
BLOCKS = ("address", "article", "aside", "blockquote", "br", "div", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "li", "main", "nav", "p", "section", "table", "td", "th", "tr")
MARK = "\uffff"
_END = r"(?=[\s/>])"
_REST = r"""(?:[^>"']|"[^"]*"|'[^']*')*+>"""
REMARKS = r"(?s)<!--.*?--!?>|<!\[CDATA\[.*?\]\]>|<!(?!--)[^>]*>|<\?[^>]*>"
RAW = rf"(?is)<(script|style){_END}{_REST}.*?(?:</\1(?=[\s/>])[^>]*>|\z)"
HIDING = rf"(?is)</?(?:{'|'.join(HIDDEN)}){_END}{_REST}"
BREAKING = rf"(?is)</?(?:{'|'.join(BLOCKS)}){_END}{_REST}"
TAG = rf"(?is)</?[a-z]{_REST}|</[^>]*>"
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: White space as a reader's eye and Python's split() know it.
WHITE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_NAMES = json.dumps(html.entities.html5)  # the standard's own table, with and without semicolons
#: Numbers 128 to 159 mean what they mean in Windows-1252, where that has a character.
_WINDOWS = json.dumps({str(b): c for b in range(128, 160) if (c := bytes([b]).decode("cp1252", "ignore"))})


def _named(name: Column, table: Column) -> Column:
    """The characters of a named reference; of an unknown one those of its longest known beginning and the rest, or itself."""
    lengths = F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length(name) - 1)), lambda n: table[F.left(name, n)].isNotNull())
    most = F.array_max(lengths)
    begun = F.concat(table[F.left(name, most)], F.substr(name, most + 1, F.length(name)))
    return F.coalesce(table[name], F.when(most.isNotNull(), begun), F.concat(F.lit("&"), name))


def _numbered(name: Column) -> Column:
    """The character of a numbered reference; what is no character gives nothing or the sign of a lost one."""
    digits = F.replace(F.substr(name, F.lit(2), F.length(name)), F.lit(";"), F.lit(""))
    hexed = F.lower(F.left(digits, F.lit(1))) == "x"
    plain = F.regexp_replace(F.when(hexed, F.substr(digits, F.lit(2), F.length(digits))).otherwise(digits), "^0+(?=.)", "")
    code = F.when(F.length(plain) > 8, F.lit(0x7FFFFFFF).cast("long")).when(hexed, F.conv(plain, 16, 10).cast("long")).otherwise(F.conv(plain, 10, 10).cast("long"))
    windows = F.from_json(F.lit(_WINDOWS), "map<string,string>")[code.cast("string")]
    lost = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    nothing = code.between(0x1, 0x8) | (code == 0xB) | code.between(0xE, 0x1F) | code.between(0x7F, 0x9F) | code.between(0xFDD0, 0xFDEF) | (code % 0x10000 >= 0xFFFE)
    return F.when(lost, "\ufffd").when(windows.isNotNull(), windows).when(nothing, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(F.when(lost, 32).otherwise(code)), 8, "0")), "UTF-32"))


def decoded_references(text: Column) -> Column:
    table = F.from_json(F.lit(_NAMES), "map<string,string>")
    found = F.regexp_extract_all(text, F.lit(REFERENCE), 1)
    between = F.split(text, REFERENCE)
    said = F.transform(found, lambda r: F.when(F.startswith(r, F.lit("#")), _numbered(r)).otherwise(_named(r, table)))
    both = F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("a"), F.concat(said, F.array(F.lit(""))).alias("b")), lambda x: F.array(x["a"], x["b"]))), "")
    return F.when(F.contains(text, F.lit("&")), both).otherwise(text)


def shown(page: Column) -> Column:
    """What lies outside hidden elements. An end without a beginning hides nothing."""
    tags, parts = F.regexp_extract_all(page, F.lit(f"({HIDING})"), 1), F.split(page, HIDING)
    start = F.struct(F.lit(0).alias("depth"), F.array(F.lit(True)).alias("open"))

    def step(state: Column, tag: Column) -> Column:
        depth = F.when(F.endswith(tag, F.lit("/>")), state["depth"]).when(F.startswith(tag, F.lit("</")), F.greatest(F.lit(0), state["depth"] - 1)).otherwise(state["depth"] + 1)
        return F.struct(depth.alias("depth"), F.array_append(state["open"], depth == 0).alias("open"))

    opened = F.aggregate(tags, start, step, lambda s: s["open"])
    return F.array_join(F.transform(F.filter(F.arrays_zip(parts.alias("part"), opened.alias("open")), lambda x: x["open"]), lambda x: x["part"]), MARK)


def visible_text(page: Column) -> Column:
    """The lines that a reader sees, white space collapsed, empty lines gone; null gives an empty text. A tag or comment that never ends is text."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(page, F.lit("")), RAW, MARK), REMARKS, MARK)
    lines = F.regexp_replace(F.regexp_replace(shown(bare), BREAKING, "\n"), TAG, MARK)
    text = F.replace(decoded_references(lines), F.lit(MARK), F.lit(""))
    each = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, WHITE, " ")))
    return F.array_join(F.filter(each, lambda x: x != ""), "\n")

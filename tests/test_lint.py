"""The text lint against plain Python, the raw archive, and the re-analysis of a store."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from campaignry import catalog
from campaignry.functions import lint_rules as R
from campaignry.functions.lint import lint
from campaignry.operators import store
from campaignry.plans import messages as M
from campaignry.shared import load_store, save_store

SF = "/root/testdata/sf0.001"
TEXTS = (
    None, "", " \n ", "TODO: write\n<name> and {x} but [brand], [who] and [link](u)", "It's not big — it's great. MY_URL_HERE #tag a#b", "Most days\n- We ship it\n* We ship more\n3. We Ship now\nWe ship\nEnd",
    "This is not new.\nThis is old. **bold** and *it*", "why does it rain?\nHere's why:\nNo one. No two! No three?", "We go.\n\nx\nwe go!\n> we, go", "é leveraged\r\nrobust", "bad things, then\ngreat ones",
)


def plain_lint(text):
    text = text or ""
    if not text.strip():
        return [("empty_artifact", None)]
    out = [(rule, text.count("\n", 0, m.start()) + 1) for rule, p in (*R.PLACEHOLDERS, *R.TOKENS, *R.PHRASES) for m in re.finditer(p, text)]
    leads = []
    for number, line in enumerate(text.splitlines(), 1):
        words = re.findall(R.LEAD_WORD, re.sub(R.LINE_LEAD, "", line).lower())
        if len(words) > 1:
            leads.append((number, words[:2]))
    out += [("anaphora", a[0]) for a, b, c in zip(leads, leads[1:], leads[2:]) if a[1] == b[1] == c[1]]
    return out + [(rule, None) for rule, p in R.FORMATTING if re.search(p, text)]


def test_cases_equal_plain_python(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", lint(F.col("t"), plain=True).alias("found")).collect()
    for r in rows:
        assert [tuple(x) for x in r["found"]] == plain_lint(TEXTS[r["i"]]), TEXTS[r["i"]]
    assert {rule for t in TEXTS for rule, _ in plain_lint(t)} >= {"anaphora", "false_negative", "hashtag", "asyndeton", "rhetorical_question", "bold_formatting", "unresolved_square_token"}


def test_documents_equal_plain_python(spark):
    texts = duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = catalog.QUERIES["text_lint"](spark, SF).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *x)) for i, t in texts for x in plain_lint(t)) and got


def test_archive_keeps_each_identity_once(spark, tmp_path):
    schema, root = "source_type string, source_mailbox string, uidvalidity string, source_uid string, raw binary", str(tmp_path / "raw")
    first = [("imap", "inbox", "7", "1", b"a"), ("imap", " INBOX", "7", "1", b"b"), ("mbox", None, None, "1", b"c")]
    store.archive(spark.createDataFrame(first, schema), root)
    store.archive(spark.createDataFrame([*first, ("imap", "INBOX", "8", "1", b"\xff"), ("imap", "INBOX", "7", "1", b"z")], schema), root)
    store.archive(spark.createDataFrame([], schema), root)
    rows = spark.read.parquet(root).collect()
    assert len(rows) == len({r["key"] for r in rows}) == 3 and {bytes(r["raw"]) for r in rows} <= {b"a", b"b", b"c", b"\xff"}


def test_reanalysis_saves_a_version_and_refuses_an_empty_store(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no messages"):
        M.reanalyzed(spark, root)
    rows = M.messages(spark, SF).limit(300)
    stale = rows.withColumn("quadrant", F.lit("stale")).withColumn("scope", F.lit("stale")).withColumn("variant_ids", F.array("id"))
    save_store(stale, root)
    want = {r["id"]: (r["quadrant"], r["scope"]) for r in M.classified(load_store(spark, root).drop("quadrant", "scope")).collect()}
    made = M.reanalyzed(spark, root)
    assert {r["id"]: (r["quadrant"], r["scope"]) for r in made.collect()} == want and "variant_ids" in made.columns
    assert load_store(spark, root).where("quadrant = 'stale'").count() == 0
    M.reanalyzed(spark, root)
    assert {r["id"]: (r["quadrant"], r["scope"]) for r in load_store(spark, root).collect()} == want


def test_rules_are_tried_where_their_signs_stand(spark):
    """Every rule has signs, also for letters beyond ASCII that a pattern takes for one of ASCII."""
    assert set(R.SIGNS) == {rule for rule, _ in (*R.PLACEHOLDERS, *R.TOKENS, *R.PHRASES, *R.FORMATTING)}
    texts = {
        "TBD": "tbd", "a FIXME": "fixme", "Dummy URL": "dummy_word", "MY_BIG_LINK": "unresolved_named_token", "<x>": "unresolved_angle_token", "{x}": "unresolved_brace_token", "[x y]": "unresolved_square_token",
        "a &MDASH; b": "em_dash", "Most of it": "most_opener", "ſhifted": "shift_word", "baſically": "basically", "UTİLİZE": "utilize", "unlocKed": "unlock", "Here’s the thing": "heres_the_thing",
        "It’s not a, it’s b": "false_negative", "This wasn't so and that was": "false_negative", "Everyone thinks, but actually": "reversal_everyone", "No a. No b. No c.": "asyndeton", "Here's why:": "rhetorical_setup",
        "Why is it so?": "rhetorical_question", "in ways you cannot": "mechanism_contrast", "I see this constantly": "vague_authority", "bad, then GREAT": "clever_comparative", "so #Tag": "hashtag", "a **b": "bold_formatting", "a _b": "italic_formatting",
        "don'--t so\n1) Don' T at all\n> don', t x": "anaphora", "one\none\none": "", "o'ne\no'ne\no'ne": "",
    }
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.transform(lint(F.col("text"), plain=True), lambda x: x["rule"]).alias("rules")).collect()
    for r in rows:
        assert texts[r["text"]] in r["rules"] if texts[r["text"]] else r["rules"] == [], r

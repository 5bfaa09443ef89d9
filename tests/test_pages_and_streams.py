"""Visible text of pages, offers without numbers, the roll-up of the scan, weeks of a stream, and the ingest's queries."""

import os
import shutil
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from campaignry import catalog
from campaignry.functions.html import visible_text
from campaignry.functions.rules import OFFER_SEMANTIC
from campaignry.operators import ledger, store
from campaignry.sources.mail import html_text
from campaignry.streaming import weekly

SF = "/root/testdata/sf0.001"
HARD = [
    "<p>a<script>x</p></script>b", "a<!-- x --><b>c</b>&amp;&lt;&#39;&#x41;&#128;&#0;&#55296;&notit;&nosuch;&am</p>p", "x<svg/>y<svg><p>no</p></svg>z</svg>w", "<HEAD><title>t</title></HEAD>body", "a < b > c <3", "<p title='a>b'>q</p>",
    "<br/>x<br>y", "&copy 2026 &middot;x", "a<template><svg>n</template>m</svg>o", "end <p cla", "end &am", "<style>p{}", "<!-- open", "<p>one two\xa0three</p>", "&#xD7;&#9;t&#10;u", "<noscript>n</noscript>s", "</div>x</p>", "<a href=x>l</a>i", "&#1114112;&#x1F600;",
    "<!DOCTYPE html>q", "<?php x ?>y", None, "", "<svg>" * 50 + "n" + "</svg>" * 50 + "y", "&am<b>p;</b>",
]


def test_visible_text_equals_the_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").union(spark.createDataFrame([(h,) for h in HARD], "html string"))
    rows = pages.select("html", visible_text(F.col("html")).alias("got"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [(r["html"], r["got"], html_text(r["html"])) for r in rows.collect() if r["got"] != html_text(r["html"])] == []


def test_offers_without_numbers(spark, tmp_path):
    texts = ["BOGO on all rings", "Free shipping this week on rings", "Free shipping on all orders over $50, always", "A free gift with purchase", "BOGO is not available on rings", "x" * 2500 + " BOGO", None, ""]
    os.mkdir(tmp_path / "t")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/t/documents.parquet")
    got = {r["doc_id"]: {k for k, _ in OFFER_SEMANTIC if r[k]} for r in catalog.QUERIES["offers_semantic"](spark, f"{tmp_path}/t").collect()}
    assert got[0] == {"bogo"} and got[1] == {"free_shipping"} and got[3] == {"gift"}
    assert got[2] == got[4] == got[5] == got[6] == got[7] == set()


def test_audit_rollup_adds_up(spark):
    rows = catalog.QUERIES["secret_scan_documents"](spark, SF).collect()
    want, docs = Counter(), Counter()
    for r in rows:
        key = ("synthetic" if r["rule"] == "synthetic_email_address" else "violation", r["rule"])
        want[key] += r["matches"]
        docs[key] += 1
    got = {(r["kind"], r["rule"]): (r["matches"], r["documents"]) for r in catalog.QUERIES["audit_rollup"](spark, SF).collect()}
    assert got == {k: (want[k], docs[k]) for k in want} and got


def test_weeks_of_a_stream_equal_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = datetime(2026, 1, 5)
    rows = [(i, at + timedelta(hours=7 * i), i % 5, "ab"[i % 2], i / 3, None) for i in range(400)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"

    def come(part, name):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        for f in os.listdir(tmp_path / name):
            if f.endswith(".parquet"):
                shutil.copy(tmp_path / name / f, tmp_path / "in" / f"{name}.parquet")

    come(rows[:150], "a")
    weekly.closed_weeks(spark, f"{tmp_path}/in", schema, f"{tmp_path}/weeks", f"{tmp_path}/checkpoint")
    come(rows[140:400], "b")
    come([(999, None, 1, "a", 1.0, None)], "c")
    weekly.closed_weeks(spark, f"{tmp_path}/in", schema, f"{tmp_path}/weeks", f"{tmp_path}/checkpoint")
    key = lambda r: (r["week"], r["event_type"])
    whole = {key(r): (r["events"], r["value"]) for r in weekly.weeks(spark.read.schema(schema).parquet(f"{tmp_path}/in")).collect()}
    closed = {key(r): (r["events"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/weeks").collect()}
    assert closed and set(closed) < set(whole) and all(whole[k] == v for k, v in closed.items())
    assert all(k[0].weekday() == 0 for k in whole)
    every = weekly.all_weeks(spark, f"{tmp_path}/in", schema, f"{tmp_path}/other")
    assert {key(r): (r["events"], r["value"]) for r in every.collect()} == whole


def test_budget_equals_a_loop(spark):
    import random

    rng = random.Random(4)
    for most in (0, 50, 400, 10_000):
        items = sorted((f"{rng.choice('abcDEF')}{rng.randrange(30)}", p, rng.randrange(1, 60)) for p in range(200))
        items = list({(b, p): (b, p, n) for b, p, n in items}.values())
        total, ended, want = 0, None, []
        for b, p, n in sorted(items, key=lambda x: (x[0].lower(), x[0], x[1])):
            if b != ended:
                if total + n > most:
                    ended = b
                else:
                    total += n
                    want.append((b, p))
        got = ledger.within_budget(spark.createDataFrame(items, "brand string, place long, bytes long"), most).collect()
        assert sorted((r["brand"], r["place"]) for r in got) == sorted(want)


def test_batches_are_gapless(spark):
    uids = spark.createDataFrame([(str(i * 8 % 1001),) for i in range(3000)] + [("x",), (None,), ("007",)], "uid string").repartition(9)
    got = sorted((r["uid"], r["batch"]) for r in store.batches(uids, 10).collect())
    assert got == [(u, i // 10) for i, u in enumerate(range(1001))]


@pytest.mark.parametrize("name", ["deny_terms_documents", "path_findings", "weekly_events_stream"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall())) and got


def test_incremental_dedupe_equals_the_whole(spark):
    got = sorted(map(tuple, catalog.QUERIES["incremental_dedupe"](spark, SF).collect()))
    assert got == sorted(map(tuple, catalog.QUERIES["dedupe_full"](spark, SF).collect())) and len(got) > 1000


def test_spans_and_claims_equal_a_loop(spark):
    import random

    rng = random.Random(9)
    spans = lambda n, most: sorted({(rng.choice("ab"), s, s + rng.randrange(0, most)) for s in (rng.randrange(300) for _ in range(n))})
    tokens = [(*x, str(rng.randrange(9))) for x in spans(120, 6)] + [(None, 1, 2, "1")]
    claims = spans(40, 70)
    t = spark.createDataFrame(tokens, "k string, start long, end long, token string")
    c = spark.createDataFrame([(*x, i, rng.choice([None, "m0", "m1", "m9"])) for i, x in enumerate(claims)], "k string, start long, end long, claim long, metric string").cache()
    inside = lambda x, y: x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2]
    got = ledger.uncovered_spans(t, c, "k").select("k", "start", "end").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(x[:3]) for x in tokens if not any(inside(x, y) for y in claims))
    frozen = [("m0", "0"), ("m1", "1"), ("m2", "2"), ("m3", "2")]
    want = []
    for r in c.collect():
        here = {x[3] for x in tokens if inside(x, (r["k"], r["start"], r["end"]))}
        named = sorted({m for m, v in frozen if v in here})
        state = "missing" if not here else ("unknown" if r["metric"] == "m9" else "bound" if r["metric"] in named else "stale") if r["metric"] else ("unbound", "bound", "ambiguous")[min(2, len(named))]
        want.append((r["claim"], r["metric"] or (named[0] if len(named) == 1 else None), state))
    got = ledger.bound_claims(t, c, spark.createDataFrame(frozen, "metric string, token string"), "k").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len({w[2] for w in want}) == 6

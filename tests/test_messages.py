"""Offers, intents, scope, privacy, store and gallery: against DuckDB on the smallest tables, and cases of their rules."""

import glob
import os
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from campaignry import message_queries as M
from campaignry.functions import offers, privacy, scoring, spots
from campaignry.operators import census, gallery, store
from campaignry.plans import messages as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v.isoformat()[:10] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", ["offer_primary", "offer_support_violations", "coverage_violations", "verify_recompute", "manifest_accounting", "scope_classify", "intent_scores", "intent_with_offers", "pii_detect", "brand_aliases", "brand_ledger", "gallery_states", "freeze_metrics", "hook_selection", "uid_batches"])
def test_equals_duckdb(spark, duck, name):
    df = M.QUERIES[name](spark, SF)
    found = duck.execute(M.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str) == want


CASES = [
        ("subject", "Save 25% today", [("%off", 25.0)]),
        ("subject", "20% more protein", []),
        ("subject", "Save 20% more water", []),
        ("subject", "Take $10 off", [("$off", 10.0)]),
        ("subject", "Final sale", []),
        ("subject", "The summer sale", [("other", None)]),
        ("subject", "Deals and news", []),
        ("subject", "A discount is not available", []),
        ("visible_text", "Free shipping on all orders", []),
        ("visible_text", "Today: free shipping on all orders", [("free_shipping", None)]),
        ("visible_text", "savings", []),
        ("visible_text", "x" * 2400 + " 20% off", []),
        ("subject", None, []),
        ("preheader", "Save up to 40% market share", []),
        ("subject", "Get 15%!", [("%off", 15.0)]),
        ("subject", "0% off and 100% off", []),
        ("subject", "Ends tonight: free tote", [("gift", None)]),
        ("visible_text", "Ends tonight: free tote", []),
        ("subject", "Free shipping is not available", []),
        ("visible_text", "Sale cannot be combined", []),
        ("visible_text", "All sales are final", []),
        ("visible_text", "x\nFree shipping & easy returns\ny", []),
        ("visible_text", "x " * 300 + "free delivery", []),
        ("visible_text", "x " * 300 + "free delivery with code A1", [("free_shipping", None)]),
        ("subject", "\U0001f600\U0001f600 Sale \U0001f600 30% off", [("%off", 30.0)]),
]


def test_offers_of_a_field(spark):
    columns = {f: [] for f in offers.SOURCES}
    rows = spark.createDataFrame([(i, *[t if f == s else None for s in columns]) for i, (f, t, _) in enumerate(CASES)], "i int, subject string, preheader string, visible_text string")
    got = {r["i"]: [(o["type"], o["depth"]) for o in r["offers"]] for r in offers.with_offers(rows, *map(F.col, columns)).collect()}
    assert {i: got[i] for i in got} == {i: want for i, (*_, want) in enumerate(CASES)}


def test_places_and_words_of_matches(spark):
    rows = spark.createDataFrame([("\U0001f600 a1 b22\nc333",), ("none",), ("",)], "t string")
    got = [[tuple(x) for x in r["s"]] for r in rows.select(spots.spots(F.col("t"), r"(?i)[A-Z]\d+").alias("s")).collect()]
    assert got == [[(2, "a1"), (5, "b22"), (9, "c333")], [], []]
    assert [tuple(r["s"]) for r in rows.select(spots.first_and_count(F.col("t"), r"\d+").alias("s")).collect()] == [(3, 3), (0, 4), (0, 0)]


def test_claims_need_evidence_that_gives_them_again(spark):
    rows = [("%off", 20.0, "subject", "20% off", "Take 20% OFF", None), ("%off", 25.0, "subject", "20% off", "Take 20% off", None), ("%off", 20.0, "body", "20% off", "20% off", None), ("$off", 5.0, "preheader", "$5 off", "x", "now $5 off"), ("%off", 20.0, "subject", "", "20% off", None), ("%off", 20.0, "subject", "20% off", None, "20% off")]
    df = spark.createDataFrame([(i, *r, "") for i, r in enumerate(rows)], "i int, type string, depth double, source string, evidence string, subject string, preheader string, visible_text string")
    assert sorted(r["i"] for r in offers.unsupported(df).collect()) == [1, 2, 4, 5]


@pytest.mark.parametrize(
    ("texts", "month", "want"),
    [
        (("Ring in 2026", "", ""), 6, ("New Year", "subject", "Ring in 2026", 1.0)),
        (("", "Season\u2019s greetings", ""), 1, ("Holiday gifting", "preheader", "Season\u2019s greetings", 1.0)),
        (("Mothers' Day and Black Friday", "", ""), 1, ("Black Friday", "subject", "Black Friday", 1.0)),
        (("Gifts for mom", "", ""), 5, ("Mother's Day", "subject", "Gifts for mom", 0.9)),
        (("Gifts for mom", "the gift guide", ""), 11, ("", "", "", 1.0)),
        (("", "the gift guide", ""), 11, ("Holiday gifting", "preheader", "gift guide", 0.9)),
        (("Autumn sale", "", ""), 9, ("Fall", "subject", "Autumn", 0.9)),
        (("Summer then winter sale", "", ""), 1, ("", "", "", 1.0)),
        (("Spring sale", "", "The winter sale"), 1, ("Winter", "visible_text", "winter", 0.9)),
        (("Spring sale", "", ""), None, ("", "", "", 1.0)),
        ((None, None, None), 1, ("", "", "", 1.0)),
    ],
)
def test_seasonality(spark, texts, month, want):
    row = spark.createDataFrame([(*texts, month)], "a string, b string, c string, m int").select(scoring.seasonality(scoring.season_hints(F.col("a"), F.col("b"), F.col("c")), F.col("m")).alias("s")).first()["s"]
    assert (row["occasion"], row["source"], row["evidence"], row["confidence"]) == want and row["seasonal"] == bool(want[0])


def test_classifying_texts_once_changes_nothing(spark):
    rows = P.messages(spark, SF)
    a, b = (P.classified(rows.fillna("", list(P.S.FIELDS)), once).select("id", "scope", "offer", "depth", "occasion", "intent", "intent_confidence", "quadrant") for once in (True, False))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() == rows.count()


def test_offers_are_ranked_and_stand_once(spark):
    rows = spark.createDataFrame([("BOGO! Take 20% off, 20% OFF", "", "free gift with purchase"), ("Free shipping", None, "sale and 5% off"), (None, None, None)], "subject string, pre string, body string")
    got = offers.with_offers(rows, F.col("subject"), F.col("pre"), F.col("body")).collect()
    assert [(o["type"], o["evidence"]) for o in got[0]["offers"]][:3] == [("bogo", "BOGO"), ("%off", "Take 20% off"), ("%off", "20% off")]
    assert len(got[0]["offers"]) == 4 and got[1]["primary"]["type"] == "%off" and got[2]["primary"] is None


def test_scope_and_intent(spark):
    rows = spark.createDataFrame(
        [("Welcome to the club", "", False), ("Welcome to summer", "shop now", False), ("Welcome aboard", "join our team", False), ("Hi", "your order is confirmed", True), ("Hi", "there", True), ("", " ", True), ("Hi", "there", False)],
        "subject string, body string, bulk boolean",
    )
    e = scoring.scope_evidence(F.col("subject"), F.lit(None).cast("string"), F.col("body"), F.col("bulk"))
    got = [(r["e"]["reason"], r["e"]["confidence"]) for r in rows.select(e.alias("e")).collect()]
    assert got == [("lifecycle:welcome", 0.96), ("marketing_content", 0.72), ("insufficient_scope_evidence", 0.55), ("lifecycle:transactional", 0.91), ("bulk_or_list_header", 0.96), ("insufficient_scope_evidence", 0.45), ("insufficient_scope_evidence", 0.55)]
    texts = spark.createDataFrame([("New: a lamp", ""), ("Learn about linen", "just dropped"), ("", "our story"), ("Hello", None)], "s string, b string")
    got = [tuple(r["e"]) for r in texts.select(scoring.content_intent(F.col("s"), F.lit(""), F.col("b")).alias("e")).collect()]
    assert got == [("New product launch", 0.9, 0), ("Ingredient/education", 0.9, 0), ("Founder/brand story", 0.86, 2), ("Featured products", 0.7, 9)]


def test_sanitizing_twice_changes_nothing_and_leaves_nothing_to_detect(spark):
    raw = "Dear Anna Berg,\nwrite to anna.berg+x@mail.example or https://a.example/?q=1 or call 555-010-2030.\nOrder #A-1234 token=abcdefgh12 {{first}} 4111 1111 1111 1111\n20% off until Sunday"
    one = spark.createDataFrame([(raw,), (None,)], "t string").withColumn("s", privacy.sanitized(F.col("t"))).withColumn("again", privacy.sanitized(F.col("s")))
    first, null = one.select("*", privacy.identifiers(F.col("s")).alias("left")).collect()
    assert first["s"] == first["again"] and "Anna" not in first["s"] and "4111" not in first["s"] and "20% off until Sunday" in first["s"]
    assert first["left"] == [] and null["s"] is None
    assert one.select(privacy.deny_terms(F.lit("anna.bergman-12+x@a.example")).alias("d")).first()["d"] == ["bergman", "anna"]


def test_unseen_is_null_safe_and_once(spark):
    got = store.unseen(spark.createDataFrame([("1", None), ("1", None), ("2", "7"), ("3", "7")], "u string, v string"), spark.createDataFrame([("1", None), ("2", "8")], "u string, v string"), ["u", "v"])
    assert sorted(tuple(r) for r in got.collect()) == [("2", "7"), ("3", "7")]
    names = spark.createDataFrame([(" in\tbox ",), ("InBox",), ("Label  A",)], "m string")
    assert [r[0] for r in names.select(store.mailbox_name(F.col("m"))).collect()] == ["in box", "INBOX", "Label A"]


def test_gallery_shows_each_image_once(spark):
    items = spark.createDataFrame([("A", f"h{i // 2}", date(2026, 1, 1 + i), f"p{i}", 1) for i in range(14)] + [(" a", "z", date(2026, 1, 1), "p", 1)], "brand string, sha256 string, date date, path string, bytes int")
    assert [r["path"] for r in gallery.newest_items(items).where("brand = 'A'").orderBy("place").collect()] == ["p13", "p11", "p9", "p7", "p5"]
    states = gallery.brand_states(items.where("brand = 'A'"), spark.createDataFrame([("A",), ("B",)], "brand string"))
    assert sorted(tuple(r) for r in states.collect()) == [("A", 5, "ready"), ("B", 0, "unavailable")]


def test_a_broken_coverage_table_is_found(spark):
    columns = "brand string, messages long, broadcast long, lifecycle long, uncertain long, unclassified long, evergreen_content long, everyday_promotion long, seasonal_promotion long, seasonal_content long"
    rows = [("A", 3, 2, 1, 0, 0, 1, 1, 0, 0), ("B", 2, 1, 0, 0, 0, 1, 0, 0, 0), ("C", 2, 2, 0, 0, 1, 1, 0, 0, 0), ("TOTAL", 7, 5, 2, 0, 1, 3, 1, 0, 0)]
    assert [tuple(r) for r in census.coverage_cross_foot(spark.createDataFrame(rows, columns)).collect()] == [("B", "scopes"), ("C", "unclassified"), ("TOTAL", "unclassified")]

"""The release ledger against DuckDB on the smallest tables, and cases of its rules."""

import glob
import os
import random
import re
from collections import Counter
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from campaignry import ledger_queries as L
from campaignry import shared
from campaignry.functions import rules as R
from campaignry.operators import ledger

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v.isoformat()[:10] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", L.ORACLE_SQL)
def test_equals_duckdb(spark, duck, name):
    df = L.QUERIES[name](spark, SF)
    found = duck.execute(L.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str) == want


def test_a_complete_ledger_makes_brands_eligible(spark):
    coverage = spark.createDataFrame([("A", "complete", 0, 40, 100, "eligible"), ("B", "partial", 2, 40, 100, "eligible"), ("TOTAL", "complete", 0, 80, 100, "summary")], "brand string, source_completeness string, errors long, broadcast long, observed_days long, hook_gate string")
    got = {r["brand"]: tuple(r)[1:] for r in ledger.bind_coverage(spark.createDataFrame([("A",), ("B",), ("C",)], "brand string"), coverage).collect()}
    assert got == {"A": ("complete", 0, True, True), "B": ("partial", 2, True, False), "C": ("partial", 0, False, False)}


def test_month_bounds_keep_the_wall_time_of_a_zone(spark):
    rows = spark.createDataFrame([(datetime(2024, 3, 31, 12), 1), (datetime(2024, 4, 10, 3), 1)], "t timestamp, i int")
    got = [r[0] for r in rows.select(ledger.months_ago(F.col("t"), 1, "America/New_York")).collect()]
    assert got == [datetime(2024, 2, 29, 13), datetime(2024, 3, 10, 4)]  # Feb 29 8:00 EST; Mar 9 23:00 EST
    with pytest.raises(ValueError):
        ledger.months_ago(F.col("t"), 0, "UTC")


def test_small_projections(spark):
    rows = spark.createDataFrame([("0.5", " Seasonal_Promotion ", "2026-02-29", " a  b "), ("-3", "x" * 70, "2026-02-28", ""), ("nan", None, "2026-2-1", None), (None, "EVERGREEN", None, "c" * 200)], "v string, c string, d string, b string")
    got = [tuple(r) for r in rows.select(ledger.bounded_confidence(F.col("v")), ledger.gallery_label(F.col("c")), ledger.iso_day(F.col("d")), ledger.first_present(F.col("b"))).collect()]
    assert got == [(0.5, "Seasonal promotion", "", "a b"), (0.0, "Safe creative preview", "2026-02-28", "Unknown brand"), (0.8, "Safe creative preview", "", "Unknown brand"), (0.8, "Evergreen content", "", "c" * 120)]
    ids = spark.createDataFrame([(["b", "a"], ["a", "c", "b"])], "x array<string>, y array<string>")
    assert ids.select(ledger.running_ids(F.array(F.lit("z")), F.col("x"), F.col("y"))).first()[0] == ["z", "b", "a", "c"]


def test_sets_and_batches(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "uid long") for v in ([1, 2, 2, 3], [2, 3, 3, 4]))
    assert sorted((r["uid"], r["problem"]) for r in ledger.batch_differences(a, b).collect()) == [(1, "missing"), (3, "repeated"), (4, "unexpected")]
    assert sorted((r["uid"], r["side"]) for r in ledger.set_differences(a, b).collect()) == [(1, "left"), (4, "right")]
    assert ledger.set_differences(a, a).count() == 0 and [r["uid"] for r in ledger.beyond(a, b, "uid").collect()] == [1]


def test_an_item_over_the_budget_ends_its_brand_only(spark):
    items = spark.createDataFrame([("A", 1, 50), ("A", 2, 60), ("A", 3, 1), ("b", 1, 40), ("C", 1, 20), ("C", 2, 10)], "brand string, place long, bytes long")
    assert sorted((r["brand"], r["place"]) for r in ledger.within_budget(items, 100).collect()) == [("A", 1), ("b", 1)]
    assert sorted((r["brand"], r["place"]) for r in ledger.within_budget(items, 112).collect()) == [("A", 1), ("A", 2), ("A", 3)]


def test_a_store_keeps_the_last_whole_save(spark, tmp_path):
    root = str(tmp_path / "store")
    assert shared.load_store(spark, root) is None
    for n in (3, 5, 7):
        shared.save_store(spark.range(n).unionByName(shared.load_store(spark, root).limit(0)) if n > 3 else spark.range(n), root)
    assert shared.load_store(spark, root).count() == 7 and len([x for x in os.listdir(root) if x.startswith("v")]) == 2
    with pytest.raises(Exception, match="no good"):
        shared.save_store(spark.range(3).select(F.raise_error(F.lit("no good")).alias("id")), root)
    assert shared.load_store(spark, root).count() == 7


def plain_numbers(text):
    """Numbers of a text by Python's own patterns."""
    spans = [m.span() for p in R.IDENTIFIER_SPANS for m in re.finditer(p, text)]
    for m in re.finditer(R.NUMBER, text):
        if not any(a <= m.start() and m.end() <= b for a, b in spans):
            bare = m[0].replace(",", "").strip("$%")
            bare = bare.rstrip("0").rstrip(".") if "." in bare else bare
            yield "$" + bare if m[0].startswith("$") else bare + "%" * m[0].endswith("%")


def test_numeric_occurrences_equal_brute_force(spark, tmp_path):
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    rows += [(-1, "In 2025, $1,200.50 or 12.0% (1.5x) at 9:30 PM, v1.2.3, see https://a.example/12?x=34 and SHA-256; a12 12b 7, 8 " + "1" * 40 + " \U0001f600 5"), (-2, None), (-3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in L.QUERIES["numeric_occurrences"](spark, str(tmp_path)).select("doc_id", "token", "times").collect())
    assert got == sorted((i, token, n) for i, t in rows for token, n in Counter(plain_numbers(t or "")).items())
    assert {t for i, t, _ in got if i == -1} == {"2025", "$1200.5", "12%", "1", "7", "8", "5"}


def test_numeric_occurrences_decide_each_text_by_itself(spark, tmp_path):
    """The link of one text hides no number of another at the same place, whatever their keys; texts are read once, and only counts are dealt."""
    rows = [(1, "at https://a.example/7 now"), (1, "at 1234567 5, 6, 7, 8, 12 now"), (None, "v1.2 or 3"), (None, "10 or 3"), (None, None), (2, "no number")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = L.QUERIES["numeric_occurrences"](spark, str(tmp_path))
    want = Counter((i, token) for i, t in rows for token in plain_numbers(t or ""))
    assert {(r["doc_id"], r["token"]): r["times"] for r in got.collect()} == want and want[None, "3"] == 2
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan and "Window" not in plan


def test_numeric_occurrences_of_odd_texts_equal_brute_force(spark, tmp_path):
    """Texts of pieces that make, break or touch identifiers, with marks, wide blanks, digits beyond ASCII and long words."""
    pieces = ["9:30", "1:23", "12", "7,000", "0.50", "%", "$", "PM", "am", "Pm-5", " ", " ", "  ", "\n", "\u00a0", "\u3000", "\ue000", "\ue001", ",", ".", ";", "-", "_", "(", "]", "x", "\u00e9", "\u0663", "\U0001f600",
              "https://", "HTTP://a/", "v1.2", "V3.4.5.6", "sha-1", "SHA-256", "a" * 39 + "1", "1" * 40, "2" * 64, "b"]
    pick = random.Random(19)
    rows = [(i, "".join(pick.choices(pieces, k=pick.randint(1, 40)))) for i in range(3000)] + [(3000, "1:23PM;45," * 3000), (3001, "9 " * 20000), (3002, "\u4e00" * 50000 + "8"), (3003, "9:30 " + "PM " * 20000 + "4")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in L.QUERIES["numeric_occurrences"](spark, str(tmp_path)).select("doc_id", "token", "times").collect())
    assert got == sorted((i, token, n) for i, t in rows for token, n in Counter(plain_numbers(re.sub("[\ue000\ue001]", " ", t))).items())


def test_uncovered_numbers_of_odd_texts_equal_the_sql(spark, tmp_path):
    """One row a text, as the SQL has it, whatever its key; statements that begin inside numbers leave the beginning. Texts are read once."""
    pick = random.Random(20)
    pieces = ["12", "7,000", "1.2.3", "0", ",", ".", "%", "$", " ", "\n", "percent", "per", "x", "\u00e9"]
    rows = [(i // 2 or None, "".join(pick.choices(pieces, k=pick.randint(0, 25)))) for i in range(3000)] + [(7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = L.QUERIES["uncovered_numbers"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(L.ORACLE_SQL["uncovered_numbers"]).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan and "Window" not in plan

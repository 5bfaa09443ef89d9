"""Work that must grow with the input alone: long lines, many small folders, keys of one time, rows of few texts."""

import glob
import re
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from campaignry.functions.spots import spots
from campaignry.ingest_queries import NUMBERED_LINE
from campaignry.operators import windows
from campaignry.plans import messages as M
from campaignry.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_lines_with_numbers_read_each_character_once(spark):
    cases = ["", "7", "a1\n\nb\n2c\n", "no digit\r\nnone 4 here 5", "\n\n9", "x\n" * 3 + "5"]
    long = "word " * 60_000
    rows = spark.createDataFrame([(t,) for t in [*cases, long, long + "\n1"]], "t string")
    began = time.time()
    got = [[(x["at"], x["found"]) for x in r[0]] for r in rows.select(spots(F.col("t"), NUMBERED_LINE)).collect()]
    assert time.time() - began < 20  # a pattern that is tried at each character takes minutes
    want = [[(m.start(), m.group()) for m in re.finditer(r"[^\n]*\d[^\n]*", t)] for t in cases]
    assert got == [*want, [], [(len(long) + 1, "1")]]


def test_rows_of_few_texts_are_not_shuffled_by_them(spark, monkeypatch):
    rows = M.messages(spark, SF)
    few = M.classified(rows)
    assert "hashpartitioning(subject" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(M, "SENT_BYTES", 0)
    many, single = M.classified(rows), M.classified(rows.fillna("", list(M.S.FIELDS)), once=False)
    as_text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*sorted(few.columns)))).collect())
    assert as_text(few) == as_text(many) == as_text(single)


def test_a_commit_writes_few_files(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(f"id{i}", f"s{i}", None, "b", f"c{i}", None, start + timedelta(days=i % 200), True, f"word{i}", None, "", [], "complete", None) for i in range(600)]
    root = f"file://{tmp_path}/store"
    incremental.ingest(spark, root, lambda since: (spark.createDataFrame(rows, incremental.RECORD).repartition(4), None), "2026-01-05 00:00:00", rules={})
    files = lambda table: len(glob.glob(f"{tmp_path}/store/tables/{table}/**/*.parquet", recursive=True))
    folders = lambda table: len(glob.glob(f"{tmp_path}/store/tables/{table}/commit=*/**/part=*", recursive=True))
    assert files("records") <= 16 and files("keys") == folders("keys")  # a folder for each fortnight, one file in each
    assert incremental.records(spark, root).count() == 600 and incremental.records(spark, root).where("day IS NULL").count() == 0


def test_only_chained_times_go_through_pointers(spark, monkeypatch):
    asked = []
    real = windows.followers
    monkeypatch.setattr(windows, "followers", lambda points, span: asked.append(points.count()) or real(points, span))
    alone = [(f"k{i}", 100 * j + x) for i in range(20) for j in range(10) for x in (0, 4)]
    chain = [("c", 7 * j) for j in range(6)]
    got = {(r["key"], r["at"]): r["leader"] for r in windows.leaders(spark.createDataFrame(alone + chain, "key string, at long"), 10).collect()}
    assert got == {(k, a): a - a % 100 for k, a in alone} | {("c", a): a - a % 14 for _, a in chain}
    assert asked == [5]  # the start of the chain and four times beyond its window, of 406

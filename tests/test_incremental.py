"""The incremental store against one deduplication of all rows, and faults at every step of its commits."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from campaignry import commits
from campaignry.operators import resend, windows
from campaignry.streaming import incremental

from test_resend import made

NAMES = [c.split()[0] for c in incremental.RECORD.split(", ")]


def records(seed, n=160):
    """The rows of the deduplication's test as stored records, each id and source once."""
    out = []
    for i, (_, source, message, brand, content, campaign, at, subject, text, ids, whole, errors) in enumerate(made(seed, n)):
        out.append((f"id{i}", source, message, brand, content, campaign, at, i % 3 > 0, subject, None, text, ids, whole, errors))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, incremental.RECORD)


def outcome(rows):
    return sorted((r["id"], r["canonical_id"], r["level"]) for r in rows)


@pytest.mark.parametrize("seed,order", [(4, "in time"), (5, "shuffled")])
def test_batches_equal_one_run(spark, tmp_path, seed, order):
    rows = records(seed, 150)
    rows.sort(key=lambda r: r[6]) if order == "in time" else random.Random(seed).shuffle(rows)
    root = f"file://{tmp_path}/store"
    for k in range(3):
        part = rows[50 * k : 50 * k + 50] + rows[max(0, 50 * k - 10) : 50 * k]  # ten of the batch before come again
        incremental.ingest(spark, root, lambda since, part=part: (frame(spark, part), None), "2026-01-05 00:00:00", rules={})
    want = outcome(resend.deduplicated(frame(spark, rows)).collect())
    assert outcome(incremental.decisions(spark, root).collect()) == want
    assert incremental.records(spark, root).count() == len(rows)
    nodes = [r["node"] for r in incremental.records(spark, root).select("node").collect()]
    assert sorted(nodes) == list(range(len(rows)))
    before = commits.Commits(spark, root).last()
    after = incremental.ingest(spark, root, lambda since: (frame(spark, rows), None), "2026-01-06 00:00:00", rules={})
    assert after.state["new"] == 0 and after.tables == before.tables


def test_overlap_failures_and_rules(spark, tmp_path):
    root, at = f"file://{tmp_path}/store", datetime(2026, 3, 1)
    row = lambda i, at, trusted=True, subject="News": (f"id{i}", f"s{i}", None, "A", f"h{i}", None, at, trusted, subject, None, f"text {i}", None, "complete", None)
    bad = spark.createDataFrame([("mbox", "1:x", "HeaderParseError", "Unassigned"), ("mbox", "1:x", "HeaderParseError", "Unassigned")], incremental.FAILURE)
    asked = []

    def fetch(rows, failures=None):
        def run(since):
            asked.append(since)
            return frame(spark, rows), failures

        return run

    incremental.ingest(spark, root, fetch([row(1, at)], bad), "2026-03-01 12:00:00")
    incremental.ingest(spark, root, fetch([row(2, at - timedelta(13)), row(3, at - timedelta(20)), row(4, at - timedelta(20), False)], bad), "2026-03-02 00:00:00")
    assert asked[0] is None and asked[1].startswith("2026-02-15 12:00:00")
    assert sorted(r["id"] for r in incremental.records(spark, root).collect()) == ["id1", "id2", "id4"]
    assert incremental.failures(spark, root).count() == 1
    last = commits.Commits(spark, root).last()
    with pytest.raises(commits.Unsound, match="an identifier in subject"):
        incremental.ingest(spark, root, fetch([row(5, at, subject="Write to jo.doe@mail.example")]), "2026-03-03 00:00:00")
    assert commits.Commits(spark, root).last() == last
    attempt = commits.Commits(spark, root).attempts()
    assert [(a["state"], a["error"], a["last_success"]) for a in attempt] == [("failed", "Unsound", "2026-03-02 00:00:00")]


def test_a_fault_at_each_write_leaves_the_last_version(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    rows = records(6, 30)
    incremental.ingest(spark, root, lambda since: (frame(spark, rows[:20]), None), "2026-01-05 00:00:00", rules={})
    store = commits.Commits(spark, root)
    last, seen = store.last(), outcome(incremental.decisions(spark, root).collect())
    whole = commits.Commits.write
    for faulty in ("records", "keys", "seen", "decisions", "manifest"):

        def write(self, df, table, *a, faulty=faulty, **k):
            if table == faulty:
                raise OSError("disk full")
            return whole(self, df, table, *a, **k)

        monkeypatch.setattr(commits.Commits, "write", write)
        if faulty == "manifest":
            monkeypatch.setattr(commits, "put", lambda spark, path, document, put=commits.put: put(spark, path, document) if "/attempts/" in path else (_ for _ in ()).throw(OSError("disk full")))
        with pytest.raises(OSError):
            incremental.ingest(spark, root, lambda since: (frame(spark, rows), None), "2026-01-06 00:00:00", rules={})
        monkeypatch.undo()
        assert store.last() == last and outcome(incremental.decisions(spark, root).collect()) == seen
    assert len(store.attempts()) == 5 and all(a["last_success"] == "2026-01-05 00:00:00" for a in store.attempts())
    incremental.ingest(spark, root, lambda since: (frame(spark, rows), None), "2026-01-06 00:00:00", rules={})
    assert outcome(incremental.decisions(spark, root).collect()) == outcome(resend.deduplicated(frame(spark, rows)).collect())
    with pytest.raises(commits.Conflict):
        store.publish(last, {}, {})
    assert store.clean() > 0 and incremental.records(spark, root).count() == 30


def test_leader_windows_of_long_chains(spark):
    rng = random.Random(3)
    points = {(f"k{k}", t) for k, n in (("a", 400), ("b", 3), ("c", 1)) for t in rng.sample(range(0, 3000), n)} | {("kd", 10 * i) for i in range(200)}
    df = spark.createDataFrame(sorted(points), "key string, at long")
    got = {(r["key"], r["at"]): r["leader"] for r in windows.leaders(df, 10).collect()}
    want, held = {}, {}
    for key, at in sorted(points):
        if key not in held or at - held[key] > 10:
            held[key] = at
        want[key, at] = held[key]
    assert got == want and len({v for (k, _), v in want.items() if k == "kd"}) == 100


def test_one_brand_with_one_content_every_day(spark):
    at = datetime(2026, 1, 1)
    rows = [(f"id{i}", f"s{i}", None, "A", "h", None, at + timedelta(hours=9 * i), True, "Daily", None, "text", None, "complete", None) for i in range(300)]
    got = resend.deduplicated(frame(spark, rows))
    leaders = [r["id"] for r in got.where("level = ''").collect()]
    assert sorted(leaders, key=lambda x: int(x[2:])) == [f"id{i}" for i in range(0, 300, 3)]
    assert got.where("level = 'level_3_content'").count() == 200
    several = frame(spark, rows[:5]).withColumn("campaign_id", F.lit("c")).withColumn("content_hash", F.concat(F.lit("h"), F.pmod(F.substr("id", F.lit(3)).cast("int"), F.lit(2)).cast("string")))
    assert outcome(resend.deduplicated(several).collect()) == [("id0", "id0", ""), ("id1", "id0", "level_4_campaign"), ("id2", "id0", "level_3_content"), ("id3", "id0", "level_4_campaign"), ("id4", "id0", "level_4_campaign")]


def test_an_unsound_analysis_is_not_saved(spark, tmp_path):
    from campaignry import shared
    from campaignry.plans import messages as M

    root = f"file://{tmp_path}/classified"
    primary = "primary struct<type: string, depth: double, source: string, evidence: string>"
    one = [("Save 20% off", "Seasonal promotion", True, True, ("%off", 20.0, "subject", "20% OFF")), ("News", "Evergreen content", False, False, None), (None, "Everyday promotion", True, False, ("%off", 9.0, "curated_export", "")), ("A gift", "Everyday promotion", True, False, ("gift", None, "subject", "gift"))]
    rows = spark.createDataFrame(one, f"subject string, quadrant string, offer boolean, seasonal boolean, {primary}").withColumns({"preheader": F.lit(None).cast("string"), "visible_text": F.lit("x")})
    shared.save_store(rows, root, rules=M.analysis_rules(), rows=4)
    broken = {"no quadrant": ("quadrant", F.lit(None).cast("string")), "against its axes": ("seasonal", ~F.col("seasonal")), "doesn't state": ("subject", F.when(F.col("primary.depth").isNull(), F.col("subject")).otherwise("x")), "without a kind": ("offer", F.lit(True))}
    for said, (column, value) in broken.items():
        with pytest.raises(shared.Unsound, match=said):
            shared.save_store(rows.withColumn(column, value), root, rules=M.analysis_rules())
    with pytest.raises(shared.Unsound, match="4 rows instead of 5"):
        shared.save_store(rows, root, rows=5)
    assert [p for p in os.listdir(tmp_path / "classified") if p.startswith(("v", ".new"))] == ["v00000001"]


def test_wordings_meet_without_stored_keys(spark, tmp_path):
    """A late record that is near to a stored one changes its decision, though no key of its wording is stored; a far one is not touched."""
    at = datetime(2026, 1, 5)
    row = lambda i, hours, subject, text: (i, f"s{i}", None, "A", f"h{i}", None, at + timedelta(hours=hours), True, subject, None, text, None, "complete", None)
    rows = [row("b", 20, "Take 10 off every ring today", "Shop the range of rings."), row("c", 21, "Quite other news of boats", "On the river."), row("d", 300, "Take 10 off every ring today", "Shop the range of rings!")]
    late = [row("a", 10, "Take 15 off every ring today", "Shop the range of rings.")]
    root = f"file://{tmp_path}/store"
    for part, now in ((rows, "2026-01-01 00:00:00"), (late, "2026-01-02 00:00:00")):
        incremental.ingest(spark, root, lambda since, part=part: (frame(spark, part), None), now, rules={})
    store = commits.Commits(spark, root)
    assert {r["kind"] for r in store.read(store.last(), "keys", incremental.KEY).select("kind").distinct().collect()} == {"source", "content"}
    every = store.read(store.last(), "decisions", incremental.DECISION)
    assert outcome(incremental.decisions(spark, root).collect()) == [("a", "a", ""), ("b", "a", "level_4_fuzzy"), ("c", "c", ""), ("d", "d", "")]
    assert sorted(r["id"] for r in every.where("batch = 2").collect()) == ["a", "b"]

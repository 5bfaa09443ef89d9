"""Mailbox reading, HTML text and the streaming merge."""

import os
from datetime import datetime

import pytest

from campaignry.sources.mail import BLOCK_TAGS, html_text, read_mbox, records_and_failures
from campaignry.streaming.ingest import merge_stream

MBOX = b"""From a@b Thu Jan  1 00:00:00 2026
From: Shop <news@mail.shop.example>
Subject: Save 20% on socks
Message-ID: <1@shop>
Date: Thu, 01 Jan 2026 08:00:00 +0000

Plain text
From a@b Fri Jan  2 00:00:00 2026
From: Other <x@other.example>
Subject: Hello
X-Delivery-Time: 1767340800000
Content-Type: text/html

<style>x</style><p>One &amp; two</p>
From nobody
From: Late <y@shop.example>
Subject: Dated
Date: Sat, 03 Jan 2026 10:00:00 +0200
Content-Type: text/plain; charset=iso-8859-1
Content-Transfer-Encoding: 8bit

Caf\xe9
From -
From: None <z@other.example>
Subject: Undated

x
From q@r Sun Jan  4 00:00:00 2026
From: Hop <h@other.example>
Subject: Received
Received: from a by b; not a date
Received: from b by c; Mon, 05 Jan 2026 01:02:03 +0100

y
"""


def test_mbox(spark, tmp_path):
    path = tmp_path / "box.mbox"
    path.write_bytes(MBOX)
    os.utime(path, (1767600000, 1767600000))
    rows = {r["subject"]: r for r in read_mbox(spark, str(path)).collect()}
    times = {s: (r["received"], r["received_source"], r["trusted"]) for s, r in rows.items()}
    assert times == {
        "Save 20% on socks": (datetime(2026, 1, 1), "mbox_separator", True), "Hello": (datetime(2026, 1, 2, 8), "x_delivery_time", True), "Dated": (datetime(2026, 1, 3, 8), "message_date_untrusted", False),
        "Undated": (datetime(2026, 1, 5, 8), "file_mtime_untrusted", False), "Received": (datetime(2026, 1, 5, 0, 2, 3), "received_header", True),
    }
    assert rows["Save 20% on socks"]["sender_domain"] == "mail.shop.example" and rows["Hello"]["visible_text"] == "One & two" and rows["Dated"]["visible_text"] == "Caf\xe9"
    assert [s for s, _ in sorted(rows.items(), key=lambda x: x[1]["place"])] == ["Save 20% on socks", "Hello", "Dated", "Undated", "Received"]
    assert all(r["source_uid"].startswith(f"{r['place']}:") and len(r["source_uid"].partition(":")[2]) == 24 for r in rows.values())
    kept = read_mbox(spark, str(path), since="2026-02-01", domains=("shop.example",)).collect()
    assert [r["subject"] for r in kept] == ["Dated"]  # an untrusted time never drops a row


def test_places_hold_over_the_parts_of_a_file(spark, tmp_path):
    text = "".join(f"From a@b Thu Jan  1 00:00:00 2026\nSubject: {i}\n\n{'x' * (i % 97)}\n" for i in range(500))
    (tmp_path / "big.mbox").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    rows = read_mbox(spark, str(tmp_path / "big.mbox")).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["place"], int(r["subject"])) for r in rows) == [(i, i) for i in range(500)]


def test_failures_go_to_a_ledger(spark):
    rows = spark.createDataFrame([("0:a", "x", None), ("1:b", None, "LookupError")], "source_uid string, subject string, error string")
    good, bad = records_and_failures(rows)
    assert [r["source_uid"] for r in good.collect()] == ["0:a"] and [tuple(r) for r in bad.collect()] == [("mbox", "1:b", "LookupError", "Unassigned")]


@pytest.mark.parametrize("tag", BLOCK_TAGS)
def test_block_tags_begin_lines(tag):
    assert html_text(f"a<{tag}>b</{tag}>c").split("\n") == ["a", "b", "c"] and html_text("a<span>b</span><hr>c") == "abc"


def test_html_text():
    assert html_text("<head><title>t</title></head><p>a<br>b</p><script>x</script>&euro;") == "a\nb\n€"


def test_merge_adds_each_identity_once(spark, tmp_path):
    landing, store, mark = (str(tmp_path / x) for x in ("landing", "store", "mark"))
    schema = "uid string, validity string, text string"
    for rows in ([("1", None, "a"), ("1", None, "b"), ("2", "7", "c")], [("1", None, "d"), ("3", "7", "e")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        merge_stream(spark, landing, schema, store, mark, ["uid", "validity"])
    assert sorted(r["uid"] for r in spark.read.parquet(store).collect()) == ["1", "2", "3"]


def test_merge_reads_only_the_days_of_a_batch(spark, tmp_path):
    landing, store, mark = (str(tmp_path / x) for x in ("landing", "store", "mark"))
    schema = "uid string, at timestamp"
    days = [datetime(2026, 1, d, 5) for d in (1, 2, 3)]
    for rows in ([("a", days[0]), ("b", days[1]), ("c", None)], [("b", days[1]), ("d", days[2]), ("c", None)], [("a", days[0]), ("d", days[2]), ("e", days[2])]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        merge_stream(spark, landing, schema, store, mark, ["uid", "at"], "at")
    assert sorted(r["uid"] for r in spark.read.parquet(store).collect()) == ["a", "b", "c", "d", "e"]
    assert sorted(x for x in os.listdir(store) if x.startswith("received_day")) == ["received_day=1970-01-01", "received_day=2026-01-01", "received_day=2026-01-02", "received_day=2026-01-03"]

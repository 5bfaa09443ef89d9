"""From mbox bytes to the census: ranges, enclosed messages, records, deduplication, classification."""

import io
import random
from datetime import datetime

from campaignry.operators import census, resend
from campaignry.plans.messages import classified
from campaignry.sources import mail, mbox
from campaignry.streaming import incremental


def eml(subject, body, date="Thu, 01 Jan 2026 08:00:00 +0000", kind="text/plain", **headers):
    lines = ["From: Acme Newsletter <news@shop.acme.example>", "To: Jordan Miller <jordan.miller@home.example>", f"Subject: {subject}", f"Date: {date}", f"Content-Type: {kind}"]
    return "\n".join([*lines, *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items()), "", body]) + "\n"


INNER = eml("Spring sale: 30% off", "Take 30% off everything this week.", Message_ID="<in@x>", List_ID="<l.acme>")


def enclosing(subject, disposition="", n=1, **headers):
    head = f"Content-Disposition: {disposition}\n" if disposition else ""
    parts = "".join(f"--B\nContent-Type: message/rfc822\n{head}\n{INNER}\n" for _ in range(n))
    return eml(subject, f"--B\nContent-Type: text/plain\n\nOuter text\n{parts}--B--", kind='multipart/mixed; boundary="B"', **headers)


def parsed(text):
    return mail.parsed(text.encode())


def test_only_a_forward_is_unwrapped():
    row = parsed(enclosing("Fwd: look"))
    assert (row["subject"], row["visible_text"], row["notes"]) == ("Spring sale: 30% off", "Take 30% off everything this week.", ["forward_unwrapped"])
    for text in (enclosing("Look"), enclosing("Look", "attachment"), enclosing("Fwd: two", n=2), enclosing("Fwd: by a list", List_ID="<x>"), enclosing("Fwd: bulk", Precedence="bulk")):
        row = parsed(text)
        assert row["visible_text"] == "Outer text" and row["notes"] == ["embedded_message_not_unwrapped"]
    row = mail.parsed(("Subject: x\nContent-Type: message/rfc822\n\n" + INNER).encode())
    assert row["subject"] == "Spring sale: 30% off" and row["notes"] == ["forward_unwrapped"]


def test_attached_and_named_parts_are_not_copy():
    part = lambda head, text: f"--B\n{head}\n\n{text}\n"
    body = part("Content-Type: text/plain", "Seen") + part('Content-Type: text/plain; name="order.txt"', "Order 123") + part('Content-Type: text/plain\nContent-Disposition: inline; filename="r.txt"', "Receipt") + part("Content-Type: text/html\nContent-Disposition: attachment", "<p>Secret</p>")
    assert parsed(eml("x", body + "--B--", kind='multipart/mixed; boundary="B"'))["visible_text"] == "Seen"
    odd = parsed(eml("x", "caf\xe9", kind="text/plain; charset=no-such-charset"))
    assert odd["visible_text"].startswith("caf") and odd.get("error") is None
    assert parsed(eml("x", "y", date="yesterday"))["notes"] == ["invalid_header_date"]


def test_ranges_give_every_message_once():
    rng = random.Random(2)
    texts = [b"From a@b Thu Jan  1 00:00:00 2026\n" + b"".join(rng.choice([b"Fromage", b"\nFro", b"x\n", b"\n", b"From", b"\n>From "]) for _ in range(rng.randrange(40))) for _ in range(60)]
    data = b"\n".join(texts)
    whole = list(mbox.messages(io.BytesIO(data), 0, len(data)))
    assert len(whole) >= 60 and b"\n".join(b"From " + a + (b"\n" + b) for a, b in whole) == data
    for size in (1, 7, 64, 500, len(data)):
        assert [m for at in range(0, len(data), size) for m in mbox.messages(io.BytesIO(data), at, min(len(data), at + size))] == whole
    saved, mbox.READ = mbox.READ, 5
    assert [m for at in range(0, len(data), 100) for m in mbox.messages(io.BytesIO(data), at, min(len(data), at + 100))] == whole
    mbox.READ = saved


def test_from_mailbox_to_census(spark, tmp_path):
    box = tmp_path / "mail"
    box.mkdir()
    first = [
        eml("Save 20% on socks", "Hello Jordan Miller,\nSave 20% on socks today. Mail jordan.miller@home.example", Message_ID="<1@x>", X_Campaign_Id="c1", List_Unsubscribe="<https://x.example/u>"),
        eml("Save 20% on socks", "Hello Jordan Miller,\nSave 20% on socks today. Mail jordan.miller@home.example", Message_ID="<1@x>", X_Campaign_Id="c1", List_Unsubscribe="<https://x.example/u>"),
        enclosing("Fwd: look", Message_ID="<2@x>"), enclosing("Plain note"), eml("How it works", "The science of fit.", date="Fri, 20 Mar 2026 08:00:00 +0000", Precedence="bulk"),
    ]
    text = "".join(f"From a@b Thu Jan  1 0{i}:00:00 2026\n{m}" for i, m in enumerate(first))
    (box / "a.mbox").write_text(text)
    (box / "b.mbox").write_text("From a@b Fri Jan  2 00:00:00 2026\n" + eml("Your order is confirmed", "Thank you."))
    ranged = mail.read_mbox(spark, str(box), partition_bytes=700).drop("path")
    lines = mail.read_mbox(spark, str(box)).drop("path")
    key = lambda r: (r["source_uid"], r["subject"])
    assert sorted(map(key, ranged.collect())) == sorted(map(key, lines.collect())) and ranged.count() == 6
    rows = mail.normalized(mail.read_mbox(spark, str(box), partition_bytes=700)).cache()
    got = {r["subject"]: r for r in rows.collect()}
    sale = got["Save 20% on socks"]
    assert "jordan" not in sale["visible_text"].lower() and sale["brand"] == "Acme" and sale["sender_domain"] == "shop.acme.example"
    assert sale["bulk"] and sale["campaign_id"].startswith("campaign:") and sale["message_id"].startswith("message:") and sale["preheader"] == sale["visible_text"].split("\n")[0]
    assert got["Spring sale: 30% off"]["parse_errors"] == ["forward_unwrapped"] and got["Spring sale: 30% off"]["list_id"].startswith("list:")
    late = got["How it works"]
    assert late["date_skew_days"] > 70 and late["parse_errors"] == ["header_date_skew_over_7_days"]
    assert len({r["id"] for r in rows.collect()}) == 6
    root = f"file://{tmp_path}/store"
    bad = mail.records_and_failures(mail.read_mbox(spark, str(box)))[1]
    incremental.ingest(spark, root, lambda since: (rows, bad), "2026-01-03 00:00:00")
    decided = incremental.decisions(spark, root)
    assert decided.where("level <> ''").count() == 1 and decided.where("level = 'level_2_message_id'").count() == 1
    standing = rows.join(decided.where("level = ''").select("id"), "id")
    assert resend.merged(rows, decided).where("variant_count = 2").count() == 1
    done = classified(standing)
    scope = {r["subject"]: (r["scope"], r["scope_evidence"]["reason"]) for r in done.collect()}
    assert scope["Save 20% on socks"] == ("broadcast", "bulk_or_list_header") and scope["Plain note"] == ("uncertain", "embedded_message_ambiguous")
    assert scope["Your order is confirmed"][0] == "lifecycle" and scope["How it works"] == ("broadcast", "bulk_or_list_header")
    assert done.where("scope = 'broadcast' AND offer").count() == 2
    roll = {r["brand"]: r for r in census.brand_rollup(done).collect()}
    assert set(roll) == {"Acme"}
    assert [r["received_at"] for r in rows.orderBy("received_at").collect()][:5] == [datetime(2026, 1, 1, i) for i in range(5)]

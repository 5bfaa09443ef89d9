"""Deny terms against plain search, path rules, and the classifier with its cache."""

import random
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from campaignry import commits
from campaignry.operators import classifier, deny
from campaignry.plans.messages import classified


def plain(docs, lines):
    out = []
    for number, line in lines:
        term = (line or "").strip().encode()
        if term and not term.startswith(b"#"):
            for key, text in docs:
                found = list(re.finditer(re.escape(term), (text or "").encode(), re.I | re.A))
                if found:
                    out.append((key, number, len(found), len((text or "").encode()[: found[0].start()].decode()) + 1))
    return sorted(out, key=str)


def test_terms_equal_plain_search(spark):
    rng = random.Random(3)
    bits = ["secret", "Name", "a", "aa", "ß", "日本", " ", ".", "x-ray", "#", "code", "A very long private term of many words"]
    docs = [(i % 50 if i % 6 else None, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(120)] + [(1, None), (2, ""), (3, "aaaa"), (3, "aaaa")]
    lines = [(1, "aa"), (2, " secret"), (3, "# comment"), (4, ""), (5, None), (6, "NAMEa"), (7, "a very long private term of many WORDS"), (8, "ß日"), (9, "a very long private term of many wordsX"), (10, "aa"), (11, "."), (12, "never there")]
    df = spark.createDataFrame(docs, "key long, text string").repartition(3)
    terms = deny.deny_terms(spark.createDataFrame(lines, "n long, line string"), "n", "line")
    assert sorted(map(tuple, deny.denied(df, terms, "key", "text").collect()), key=str) == plain(docs, lines)
    assert deny.denied(df, terms.limit(0), "key", "text").count() == 0 and deny.denied(df.limit(0), terms, "key", "text").count() == 0


def test_anchors_across_parts(spark, monkeypatch):
    monkeypatch.setattr(deny, "PART", 16)
    docs = [(i, "x" * i + "a needle in hay" + "y" * 40) for i in range(40)]
    terms = deny.deny_terms(spark.createDataFrame([(1, "Needle in h"), (2, "x" * 30)], "n long, line string"), "n", "line")
    got = deny.denied(spark.createDataFrame(docs, "key long, text string"), terms, "key", "text")
    assert sorted(map(tuple, got.collect())) == sorted([(i, 1, 1, i + 3) for i in range(40)] + [(i, 2, 1, 1) for i in range(30, 40)])


def test_path_rules(spark):
    paths = ["src/a.py", "box/Mail.MBOX", "x/.gitmodules", "/home/jo/notes.txt", "c:\\Users\\jo\\x.db", "to/jo.doe@mail.acme/a.eml", "to/jo@example.com", "pic.JPG", ".eml", None]
    got = [(r["path"], r["rule"]) for r in deny.path_findings(spark.createDataFrame([(p,) for p in paths], "path string"), "path", F.sha2("path", 256)).collect()]
    assert ("box/Mail.MBOX", "mailbox_export") in got and ("x/.gitmodules", "submodule_manifest") in got and ("pic.JPG", "review") in got and ("to/jo@example.com", "synthetic_email_address") not in got
    rules = sorted(r for _, r in got)
    assert rules == sorted(["mailbox_export", "submodule_manifest", "absolute_home_path_in_path", "absolute_home_path_in_path", "database_file", "email_address_in_path", "raw_email_file", "synthetic_email_address", "review"])
    assert not any("jo" in p for p, _ in got)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the classifiers here go to workers that can't import this file


class Words:
    """Answers by the words of a subject; counts calls by files, as tasks run elsewhere."""

    model = "words-1"

    def __init__(self, folder):
        self.folder = folder

    def classify(self, payloads):
        import os
        import uuid

        out = []
        for p in payloads:
            open(os.path.join(self.folder, uuid.uuid4().hex), "w").write(p["subject"])
            if "broken" in p["subject"]:
                out.append(TimeoutError("no answer"))
            elif "odd" in p["subject"]:
                out.append({"intent": "No such", "uniqueness": 99, "benefit_theme": " t" * 99, "offer_type": "?"})
            else:
                out.append({"intent": "Upsell", "uniqueness": "4", "benefit_theme": "ease", "offer_type": "bundle" if "kit" in p["subject"] else "none"})
        return out


class Down:
    model = "down"

    def classify(self, payloads):
        raise ConnectionError("down")


@pytest.fixture(scope="module")
def messages(spark):
    subjects = ["The kit for you", "A note", "A broken one", "An odd one", "Take 20% off kit", "A note", "Your order is confirmed", None]
    rows = [(f"m{i}", "imap", s, None, "Shop the collection." if i != 7 else None, "c", None) for i, s in enumerate(subjects)] + [("m8", "curated_export", "A kit", None, "", "c", "upsell")]
    df = spark.createDataFrame(rows, "id string, source_type string, subject string, preheader string, visible_text string, campaign_id string, curated_intent string")
    return classified(df.withColumns({"received": F.to_date(F.lit("2026-02-03")), "received_at": F.lit("2026-02-03").cast("timestamp"), "trusted": F.lit(True), "brand": F.lit("A"), "curated_offer": F.lit(None).cast("string"), "curated_occasion": F.lit(None).cast("string")})).cache()


def test_answers_are_asked_for_once(spark, messages, tmp_path):
    (tmp_path / "calls").mkdir()
    root, calls = f"file://{tmp_path}/cache", lambda: len(list((tmp_path / "calls").iterdir()))
    words = Words(str(tmp_path / "calls"))
    first = {r["id"]: r for r in classifier.refined(messages, words, root).collect()}
    plainly = {r["id"]: r for r in messages.collect()}
    broad = {i for i, r in plainly.items() if r["scope"] == "broadcast"}
    asked = len({((plainly[i]["subject"] or ""), plainly[i]["visible_text"] or "") for i in broad})
    assert set(first) == set(plainly) and calls() == asked
    assert (first["m0"]["intent"], first["m0"]["primary"]["type"], first["m0"]["primary"]["confidence"], first["m0"]["offer"]) == ("Promotion/offer", "bundle", 0.65, True)
    assert (first["m1"]["intent"], first["m1"]["uniqueness"], first["m1"]["benefit_theme"], first["m1"]["model"]) == ("Upsell", 4, "ease", "words-1")
    assert first["m2"]["analysis_errors"] == ["AI classification unavailable: TimeoutError"] and first["m2"]["intent"] == plainly["m2"]["intent"] and first["m2"]["model"] is None
    assert (first["m3"]["intent"], first["m3"]["uniqueness"], len(first["m3"]["benefit_theme"])) == ("Featured products", 5, 80)
    assert first["m4"]["primary"] == plainly["m4"]["primary"] and first["m4"]["intent"] == "Upsell"
    assert first["m6"]["model"] is None and first["m8"]["intent"] == plainly["m8"]["intent"] and first["m8"]["primary"] == plainly["m8"]["primary"]
    before = commits.Commits(spark, root).last().number
    again = {r["id"]: r for r in classifier.refined(messages.where("id <> 'm2'"), words, root).collect()}
    assert calls() == asked and commits.Commits(spark, root).last().number == before
    assert all(again[i] == first[i] for i in again)


def test_a_failing_classifier_fails_no_row(spark, messages, tmp_path):
    got = classifier.refined(messages, Down(), f"file://{tmp_path}/cache").collect()
    kept = {r["id"]: r["intent"] for r in messages.collect()}
    assert {r["id"]: r["intent"] for r in got} == kept and any(r["analysis_errors"] == ["AI classification unavailable: ConnectionError"] for r in got)
    assert {r["id"]: r["intent"] for r in classifier.refined(messages, None, "").collect()} == kept

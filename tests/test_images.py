"""A gallery's manifest over real files: unsafe paths, wrong kinds, wrong hashes, lengths, budgets, provenance."""

import base64
import hashlib

from campaignry.sources import images

PNG, JPG, WEBP = b"\x89PNG\r\n\x1a\n" + b"p" * 40, b"\xff\xd8\xff" + b"j" * 31, b"RIFF1234WEBPxx"


def test_images(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    files = {"one.png": PNG, "a b/two.JPG": JPG, "three.webp": WEBP, "fake.png": JPG, "short.webp": b"RIFF1234WEB", "big.png": PNG + b"x" * images.MOST_BYTES, "empty.png": b"", "other.png": PNG + b"!", "copy.png": PNG, "note.txt": b"x"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    sha = lambda n: hashlib.sha256(files[n]).hexdigest()
    rows = [("Acme", f"2026-01-{10 + i}", "offer", n, sha(n), "success") for i, n in enumerate(files)]
    rows += [("acme ", "2026-02-01", None, "other.png", "0" * 64, "success"), ("Acme", None, None, "../one.png", sha("one.png"), "success"), ("Acme", None, None, "/one.png", None, "success"), ("Acme", None, None, None, None, None), ("Acme", None, None, "none.png", "x", "success"), ("Bee", None, None, "one.png", sha("one.png"), "failed"), ("Cee", None, "x", "one.png", sha("one.png"), "success")]
    items = spark.createDataFrame(rows, images.ITEM)
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        checked = images.checked_images(spark, folder, items).cache()
        state = {(r["brand"], r["thumbnail_path"], r["thumbnail_sha256"]): r["state"] for r in checked.collect()}
        want = {"one.png": "sound", "a b/two.JPG": "sound", "three.webp": "sound", "fake.png": "kind", "short.webp": "kind", "big.png": "length", "empty.png": "missing", "other.png": "sound", "copy.png": "sound", "note.txt": "unsafe_path"}
        assert {n: state["Acme", n, sha(n)] for n in files} == want
        assert state["acme ", "other.png", "0" * 64] == "hash" and state["Acme", "none.png", "x"] == "missing" and state["Acme", None, None] == state["Acme", "/one.png", None] == state["Acme", "../one.png", sha("one.png")] == "unsafe_path"
        assert all((r["content"] is None) == (r["state"] != "sound") for r in checked.collect())
    brands = spark.createDataFrame([("Acme",), ("Bee",)], "brand string")
    shown = sorted((r["brand"], r["place"], r["data_uri"]) for r in images.shown_images(checked, brands).collect())
    uri = lambda kind, data: f"data:image/{kind};base64," + base64.b64encode(data).decode()
    assert shown == [("Acme", 1, uri("png", PNG)), ("Acme", 2, uri("png", PNG + b"!")), ("Acme", 3, uri("webp", WEBP)), ("Acme", 4, uri("jpeg", JPG))]
    assert all(r["bytes"] == len(uri(r["kind"].partition("/")[2], bytes(r["content"]))) for r in checked.where("state = 'sound'").collect())
    first = len(shown[0][2])
    assert [r["place"] for r in images.shown_images(checked, brands, first).collect()] == [1]


def test_provenance(spark):
    brands = spark.createDataFrame([("Acme",), ("Bee",)], "brand string")
    counts = ", ".join(f"{c} long" for c in images.COUNTS)
    told = lambda rows, whole: sorted((r["rule"], r["found"]) for r in images.provenance(spark.createDataFrame([whole], f"pipeline_version string, master_sha256 string, {counts}"), spark.createDataFrame(rows, f"brand string, {counts}"), brands, "v1", "m").collect())
    assert told([("acme", 3, 2, 1, 0, 0), ("Bee", 1, 0, 0, 1, 0)], ("v1", "m", 4, 2, 1, 1, 0)) == []
    assert told([("Acme", 3, 2, 0, 0, 0)], ("v2", None, 4, 2, 1, 1, 1)) == [("brand_equation", "Acme"), ("brand_missing", "Bee"), ("master", None), ("sum", "failed"), ("sum", "pending"), ("sum", "requested"), ("sum", "skipped"), ("total_equation", "4"), ("version", "v2")]

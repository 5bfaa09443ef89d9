"""Images of a gallery's manifest: files below one folder whose length, kind and hash are checked on the JVM before any of them is shown.

Spark reads only files of an allowed length; kind is told by the name and the first bytes together, and the content's hash
must be the one that the manifest names. What fails a check is given with its reason, never shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import GALLERY_BYTES
from ..operators.gallery import newest_items
from ..operators.ledger import within_budget

ITEM = "brand string, date string, category string, thumbnail_path string, thumbnail_sha256 string, status string"
# Bytes of an image, kinds by the end of a name, and the first bytes of each kind (of WebP also those from the ninth on).
MOST_BYTES = 1_500_000
KINDS = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp"}
MAGIC = {"image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF", "image/webp": "52494646"}
WEBP = "57454250"
COUNTS = ("requested", "rendered", "skipped", "failed", "pending")


def kind_of(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v)])
    return kinds[F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))]


def begins(content: Column, kind: Column) -> Column:
    """Whether the first bytes are those of the kind."""
    head = F.hex(F.substring(content, 1, 12))
    plain = [(kind == k) & F.startswith(head, F.lit(m)) for k, m in MAGIC.items() if k != "image/webp"]
    webp = (kind == "image/webp") & F.startswith(head, F.lit(MAGIC["image/webp"])) & (F.substr(head, F.lit(17), F.lit(8)) == WEBP)
    return plain[0] | plain[1] | webp


def contained(path: Column) -> Column:
    """Whether a path stays below its folder and has the name of an image."""
    return (F.trim(path) != "") & ~path.rlike(r"^(?:/|[A-Za-z]:|[a-z]+://)|(?:^|[/\\])\.\.(?:[/\\]|$)") & kind_of(path).isNotNull()


def checked_images(spark: SparkSession, folder: str, items: DataFrame) -> DataFrame:
    """items with state (sound, or why not: unsafe_path, missing, length, kind, hash), kind, bytes of the data address and content of sound ones.

    A file beyond MOST_BYTES is not read: it is known by its length alone; an empty one counts as missing. Null fields of an item fail its checks.
    """
    base = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    place = F.substring_index("path", f"{base.removeprefix('file://').removeprefix('file:')}/", -1)
    fits = F.col("length").between(1, MOST_BYTES)  # goes into the scan
    read = files.where(fits).select(place.alias("_path"), F.col("length"), F.col("content"))
    seen = files.select(place.alias("_known"), F.col("length").alias("_length"))
    given = items.withColumn("_safe", F.coalesce(contained(F.col("thumbnail_path")), F.lit(False)))
    asked = F.when(F.col("_safe"), F.col("thumbnail_path"))
    both = given.join(seen, asked == F.col("_known"), "left").join(read, asked == F.col("_path"), "left")
    kind = kind_of(F.col("thumbnail_path"))
    state = (
        F.when(~F.col("_safe"), "unsafe_path").when(F.col("_known").isNull(), "missing").when(F.col("content").isNull(), "length")
        .when(~begins(F.col("content"), kind), "kind").when(~F.col("thumbnail_sha256").eqNullSafe(F.sha2("content", 256)), "hash").otherwise("sound")
    )
    out = both.withColumns({"state": state, "kind": kind})
    size = F.length(F.concat(F.lit("data:"), "kind", F.lit(";base64,"))) + 4 * F.ceil(F.col("length") / 3)
    return out.select(*items.columns, "state", "kind", F.when(F.col("state") == "sound", size.cast("long")).alias("bytes"), F.when(F.col("state") == "sound", F.col("content")).alias("content"))


def shown_images(checked: DataFrame, brands: DataFrame, most: int = GALLERY_BYTES) -> DataFrame:
    """brand, place, date, category, kind, data_uri of the newest sound images of successful items of the known brands, within the budget of all."""
    known = brands.select("brand", F.lower(F.trim("brand")).alias("_key")).distinct()
    sound = checked.where((F.col("state") == "sound") & (F.col("status") == "success")).withColumn("_key", F.lower(F.trim("brand"))).drop("brand").join(known, "_key")
    chosen = newest_items(sound.select("brand", F.col("thumbnail_sha256").alias("sha256"), F.coalesce("date", F.lit("")).alias("date"), F.col("thumbnail_path").alias("path"), "bytes"))
    kept = within_budget(chosen.withColumn("place", F.col("place").cast("long")), most).select("brand", "place", "path")
    uri = F.concat(F.lit("data:"), "kind", F.lit(";base64,"), F.base64("content"))
    return kept.join(sound.withColumnRenamed("thumbnail_path", "path").dropDuplicates(["brand", "path"]), ["brand", "path"]).select("brand", "place", "date", "category", "kind", F.regexp_replace(uri, r"\s", "").alias("data_uri"))


def provenance(manifest: DataFrame, coverage: DataFrame, brands: DataFrame, version: str, master_sha256: str) -> DataFrame:
    """Breaches of a manifest's provenance, none for a sound one: rule and what was found.

    manifest: one row with pipeline_version, master_sha256 and the COUNTS of all; coverage: brand and COUNTS. Every brand has a row,
    every requested item is rendered, skipped or failed and none pending, in each brand and in all, and the brands' sums are those of all.
    """
    whole = manifest.select("pipeline_version", "master_sha256", *COUNTS)
    rules = [
        ("version", ~F.col("pipeline_version").eqNullSafe(F.lit(version)), F.col("pipeline_version")), ("master", ~F.col("master_sha256").eqNullSafe(F.lit(master_sha256)), F.col("master_sha256")),
        ("total_equation", ~F.coalesce((F.col("requested") == F.col("rendered") + F.col("skipped") + F.col("failed")) & (F.col("pending") == 0), F.lit(False)), F.col("requested").cast("string")),
    ]
    found = [whole.where(bad).select(F.lit(name).alias("rule"), what.alias("found")) for name, bad, what in rules]
    balanced = F.coalesce((F.col("requested") == F.col("rendered") + F.col("skipped") + F.col("failed")) & (F.col("pending") == 0), F.lit(False))
    found.append(coverage.where(~balanced).select(F.lit("brand_equation").alias("rule"), F.col("brand").alias("found")))
    lacking = brands.select("brand").distinct().join(coverage.select(F.col("brand").alias("_brand")), F.lower(F.trim("brand")) == F.lower(F.trim("_brand")), "left_anti")
    found.append(lacking.select(F.lit("brand_missing").alias("rule"), F.col("brand").alias("found")))
    sums = coverage.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{c}") for c in COUNTS])
    off = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in COUNTS]))
    found.append(whole.join(sums).select(F.lit("sum").alias("rule"), F.explode(off).alias("found")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out

"""Document fingerprints: SimHash from weighted term hashes, and block tables that find the close ones. SQL functions only.

A text's terms are its lower-case words, repeats included. Each term's 64-bit hash votes on the 64 bits with the term's
weight, its length up to MOST_WEIGHT: short words are mostly the common ones. A bit is set if its votes are more than
half. Equal texts have equal fingerprints, texts of mostly the same terms have close ones.

For links the 64 bits are cut into four blocks. Fingerprints at distance 2 or less agree in two blocks at least, so six
tables, each with another pair of blocks in front, find all of them (see hamming.linked_pairs).

Edge cases: a null text counts as an empty one, whose only term is the empty one of weight 0, which gives fingerprint
zero; the successor of the last document is the first, of a single one itself; rows with equal doc_id have the same
successor, of the next greater doc_id the row whose text has the least SHA-256; a null doc_id comes first, and its rows,
however many, stay where they are; repeated rows give a row each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_key, materialize
from .hamming import components, distance

SPACE = r"[\x20\x09-\x0D]+"
MOST_WEIGHT = 16
#: Two counters of 32 bits share a long.
PAIR = 0x100000001
#: Rows of an id with more than this part of all are dealt over several tasks.
HOT = 1000


def block_tables() -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """Bit ranges of head and tail, for each pair of the four blocks."""
    blocks = [(16 * i, 16) for i in range(4)]
    return [([blocks[i], blocks[j]], [b for k, b in enumerate(blocks) if k not in (i, j)]) for i in range(4) for j in range(i + 1, 4)]


def successors(ids: DataFrame) -> DataFrame:
    """ids (id, need) with next_id: the next greater id (null is the least), after the last the first. Only ids move, by ranges."""
    ranged = materialize(ids.repartitionByRange("id").select("id", "need", F.spark_partition_id().alias("range")), "ids")
    firsts = ranged.groupBy("range").agg(F.min(F.struct("id")).alias("first"))  # a row for each partition
    after = firsts.select("range", F.lead("first").over(Window.orderBy("range")).alias("then"), F.first("first").over(Window.orderBy("range")).alias("start"))
    inside = ranged.withColumn("next", F.lead(F.struct("id")).over(Window.partitionBy("range").orderBy("id")))
    return inside.join(F.broadcast(after), "range").select("id", "need", F.coalesce("next", "then", "start")["id"].alias("next_id"))


def with_edited(docs: DataFrame) -> list[DataFrame]:
    """id, text, text_hash, edited, n_chars, next_id of the rows with an id, and, if there are any, of those without. edited: the last quarter of text is replaced by the beginning of the next text.

    Texts move once, by id and a part of it: the rows of an id that has more than 1 / HOT of all rows are dealt over several
    parts. Only the beginnings that are asked for move a second time.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("text_hash"))
    needs = materialize(rows.groupBy("id").agg(F.max(F.floor(F.length("text") / 4)).cast("int").alias("need"), F.count(F.lit(1)).alias("n")), "needs")
    wanted = materialize(successors(needs).select(F.col("next_id").alias("of"), F.col("id").alias("by"), "next_id", "need"), "wanted")
    many = needs.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(needs.where((F.col("n") > 1) & F.col("id").isNotNull() & (F.col("n") * HOT > many)).select(F.col("id").alias("hot_id"), F.ceil(F.col("n") * HOT / F.lit(max(1, many))).cast("int").alias("parts")))  # HOT rows at most
    named = rows.where("id IS NOT NULL").join(hot, F.col("id") == F.col("hot_id"), "left")
    named = named.select("id", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int")).alias("part"), "text", "text_hash")
    nameless = rows.where("id IS NULL")

    def dealt(links: DataFrame, key: str) -> DataFrame:
        """links with a row for each part of the id in key."""
        parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("of_part")
        return links.join(hot, links[key] == F.col("hot_id"), "left").select(*links.columns, parts)

    asked = dealt(wanted.where("by IS NOT NULL AND of IS NOT NULL"), "of")
    begun = named.join(asked, (named["id"] == asked["of"]) & (named["part"] == asked["of_part"]))
    heads = begun.groupBy("by", "next_id").agg(F.min_by(F.expr("left(text, need)"), F.col("text_hash")).alias("head"))

    def head_of(link) -> DataFrame:
        """by, next_id, head: one row, for a link from or to rows without an id, which are too many to be joined by it."""
        least = rows.where(rows["id"].eqNullSafe(F.lit(link["of"]))).agg(F.min_by(F.left("text", F.lit(link["need"])), "text_hash").alias("head"))
        return least.select(F.lit(link["by"]).cast("long").alias("by"), F.lit(link["of"]).cast("long").alias("next_id"), "head")

    for link in wanted.where("by IS NOT NULL AND of IS NULL").collect():  # the last id, or none
        heads = heads.union(head_of(link))
    quarter = F.floor(F.length("text") / 4).cast("int")

    def edited(both: DataFrame) -> DataFrame:
        both = both.withColumn("n_chars", F.length("text").cast("long")).withColumn("_quarter", quarter)
        return both.select("id", "text", "text_hash", F.expr("concat(left(text, cast(n_chars as int) - _quarter), left(head, _quarter))").alias("edited"), "n_chars", "next_id")

    heads = dealt(heads, "by")
    parts = [edited(named.join(heads, (named["id"] == heads["by"]) & (named["part"] == heads["of_part"])))]
    for link in wanted.where("by IS NULL").collect():  # the null id, or none
        head = head_of(link)
        parts.append(edited(nameless.join(F.broadcast(head), nameless["id"].eqNullSafe(head["by"]))))
    return parts


def votes(weight: Column, term_hash: Column) -> list[Column]:
    """32 sums of the weights of terms with bit j set (lower half) and bit j + 32 set (upper half), and the sum of all."""
    sums = [F.sum(weight * F.shiftrightunsigned(term_hash, j).bitwiseAND(F.lit(PAIR))).alias(f"v{j}") for j in range(32)]
    return [*sums, F.sum(weight).alias("total")]


def voted() -> Column:
    """The fingerprint from the columns of votes()."""
    out = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"v{j}", 32)
        for bit, n in ((j, low), (j + 32, high)):
            out = out.bitwiseOR(F.when(n * 2 > F.col("total"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return out


def text_fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, fp, copies: the fingerprint of each group of rows with equal keys, which must have equal texts; copies: its rows.

    Votes of equal texts are equal. A row's terms are counted by themselves where the row lies: its votes are fewer than its characters, so 32 bits hold them.
    """
    terms = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", *keys, F.split(F.lower(text), SPACE).alias("terms"))
    terms = terms.select("_row", *keys, F.explode("terms").alias("term"))
    weight = F.least(F.length("term"), F.lit(MOST_WEIGHT)).cast("long")
    summed = terms.select("_row", *keys, weight.alias("w"), F.xxhash64("term").alias("h")).groupBy("_row", *keys).agg(*votes(F.col("w"), F.col("h")))
    return summed.select(*keys, voted().alias("fp"), F.lit(1).cast("long").alias("copies"))


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    return 1 - distance(a, b) / F.lit(64.0)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_group.

    near_group: the least doc_id reachable over links of 2 bits or fewer between fingerprints of documents; null only
    if none but null ones are. Where ids repeat, unrelated groups may show the same near_group.
    """
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("words")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("words")))
    keys = ["id", "next_id", "n_chars", "text_hash", "edited_sha256"]


    def voted_pairs(rows: DataFrame) -> DataFrame:
        both = rows.select("id", "next_id", "n_chars", "text_hash", F.sha2("edited", 256).alias("edited_sha256"), F.inline(kinds))
        found = text_fingerprints(both, [*keys, "kind"], "words")
        return found.groupBy(*keys).agg(*[F.sum(F.when(F.col("kind") == 0, F.col("copies"))).alias("copies"), *[F.max(F.when(F.col("kind") == k, F.col("fp"))).alias(n) for k, n in enumerate(("fp", "edited_fp"))]])

    pairs = materialize(reduce(DataFrame.unionByName, map(voted_pairs, with_edited(docs))), "fingerprints")
    nexts = pairs.groupBy("id").agg(F.min(F.struct("text_hash", "fp"))["fp"].alias("next_fp")).withColumnRenamed("id", "of")
    groups = materialize(components(pairs.select("id", "fp"), block_tables()), "groups")
    near = pairs.join(nexts, pairs["next_id"].eqNullSafe(nexts["of"]))
    out = join_by_key(near, groups, "fp", "rows").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), F.col("component").alias("near_group"),
    )

"""Links between 64-bit fingerprints at Hamming distance 2 or less, and connected components, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialize


def bits(fp: Column, ranges: list[tuple[int, int]]) -> Column:
    """The bits of the (start, length) ranges, counted from the upper end and round it, packed into one long."""
    out = F.lit(0).cast("long")
    for start, length in ranges:
        start %= 64
        here = min(length, 64 - start)
        for at, n in ((start, here), (0, length - here)):
            if n:
                out = F.shiftleft(out, n).bitwiseOR(F.shiftrightunsigned(fp, 64 - at - n).bitwiseAND(F.lit((1 << n) - 1)))
    return out


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def linked_pairs(nodes: DataFrame, tables: list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]) -> DataFrame:
    """Pairs (a, b), b < a, of nodes with distinct fingerprints (node, fp) that connect all that differ in 1 or 2 bits.

    tables: bit ranges of the head and of the tail. Any two fingerprints at distance 2 must agree in the head of some
    table. Fingerprints that are alone with their head are pruned. The others of a head are not paired with each other:
    each gives its tail and the tails one bit away, and two tails differ in at most 2 bits if and only if they share
    such a point. At most one fingerprint for each bit of the tail meets at a point, all within distance 2 of each
    other, and is linked to the least of them. So rows grow with the fingerprints even where very many are close.
    """
    keys = F.array(*[F.struct(F.lit(t).alias("table"), bits(F.col("fp"), head).alias("head"), bits(F.col("fp"), tail).alias("tail")) for t, (head, tail) in enumerate(tables)])
    keyed = nodes.select("node", "fp", F.inline(keys))
    crowded = keyed.groupBy("table", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("table", "head")
    kept = keyed.join(crowded, ["table", "head"], "left_semi")
    width = F.element_at(F.array(*[F.lit(sum(n for _, n in tail)) for _, tail in tables]), F.col("table") + 1)
    flips = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.col("tail").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    points = kept.select("node", "fp", "table", "head", F.explode(F.array_append(flips, F.col("tail"))).alias("point"))
    least = F.min(F.struct("node", "fp")).over(Window.partitionBy("table", "head", "point"))
    met = points.select("node", "fp", least.alias("least")).where((F.col("least.node") < F.col("node")) & (distance(F.col("fp"), F.col("least.fp")) <= 2))
    return met.select(F.col("node").alias("a"), F.col("least.node").alias("b")).distinct()


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, component) of every node in pairs (a, b); a component is its least node.

    Alternates large-star and small-star steps until the pairs stay the same. Each step is a partial aggregate and a
    join on the node, so Spark splits a node with very many neighbours.
    """
    edges = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(near, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        drop(edges)
        drop(large)
        before, edges = now, after


def components(fingerprints: DataFrame, tables: list) -> DataFrame:
    """(fp, component, root, rows) of each fingerprint in (id, fp), over links of distance 2 or less.

    component: the least id reachable, null only if all are; root: the least fingerprint; rows: those of fp. Ids may
    repeat with other fingerprints, so two components may have the same least id: only root tells them apart, and only
    fingerprints are linked.
    """
    nodes = materialize(fingerprints.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows")), "fingerprints")
    of = connected_components(linked_pairs(nodes.select(F.col("fp").alias("node"), "fp"), tables)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    least = of.join(nodes, "fp").groupBy("root").agg(F.min("id").alias("component"))
    return nodes.join(of.join(least, "root"), "fp", "left").select("fp", F.coalesce("component", "id").alias("component"), F.coalesce("root", "fp").alias("root"), "rows")

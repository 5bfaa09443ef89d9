"""Exact top-k search by distributed histogram selection.

Queries and candidates are cut into blocks of bounded size, and each cell of a query block and a candidate block is one
group: it scores all its pairs by a matrix product. Each pass counts, per query, the scores of the present range in
equal bins; the sums over all cells show in which bin the k-th greatest score lies, which becomes the next range. When
every range is a single value, a last pass keeps what reaches it, with ties to the smaller id.

Equal rows are collapsed before they are dealt, to k copies at most, so a row repeated very often is no large cell.
A cell sends only the counts of its own k greatest scores of the range: no lower one can be the k-th of all.

Edge cases: vectors that are null or hold null or non-finite components take no part; only vectors of equal length
meet; a row is never a candidate for its own id; repeated candidate rows rank next to each other; a query id that
repeats is one query, with the least of its vectors (the shortest first); fewer candidates than k give fewer rows; an empty table gives an empty result; other columns are
ignored. Scores are exact; one beyond 63 bits raises an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

QUERIES, CANDIDATES = 4096, 4096  # of a block, about
BINS = 1024
TILE = 512  # queries scored at once
CELL = ["dim", "query_block", "block"]


def quantized(vectors: pd.Series) -> np.ndarray:
    return np.floor(256 * np.stack(vectors.to_numpy()).astype(np.float64)) if len(vectors) else np.zeros((0, 0))


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = [[int(x) for x in r] for r in c]
    return np.array([[sum(a * b for a, b in zip(r, w)) for w in whole] for r in ([int(x) for x in r] for r in q)], np.int64)


def tiles(queries: pd.DataFrame, candidates: pd.DataFrame):
    """(rows of queries, scores, own): own marks a query's own id among the candidates."""
    c, ids = quantized(candidates["embedding"]), candidates["vec_id"].to_numpy()
    for at in range(0, len(queries), TILE):
        part = queries.iloc[at : at + TILE]
        yield part, scores(quantized(part["embedding"]), c), part["query_id"].to_numpy()[:, None] == ids[None]


def histogram(k: int):
    """Counts by query and bin of a cell's k greatest scores in each query's range [low, high]."""

    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "bin": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})]
        for part, score, own in tiles(queries, candidates) if len(candidates) else ():
            low, high, width = (part[x].to_numpy()[:, None] for x in ("low", "high", "width"))
            bins = np.where(own | (score < low) | (score > high), -1, (score - low) // width)
            if bins.shape[1] > k:
                bins = np.partition(bins, bins.shape[1] - k, axis=1)[:, -k:]
            row, _ = np.nonzero(bins >= 0)
            out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "bin": bins[bins >= 0]}).value_counts().rename("n").reset_index())
        return pd.concat(out)

    return run


def reaching(k: int):
    """A cell's best k of each query among the scores that reach the k-th of all (low), ties to smaller ids."""

    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found = []
        candidates = candidates.sort_values("vec_id", kind="stable")
        ids = candidates["vec_id"].to_numpy()
        for part, score, own in tiles(queries, candidates) if len(candidates) else ():
            for q, low, row, mine in zip(part["query_id"], part["low"], score, own):
                at = np.flatnonzero((row >= low) & ~mine)
                best = at[np.argsort(-row[at], kind="stable")[:k]] if len(at) > k else at
                found += [(q, ids[i], row[i]) for i in best]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k greatest integer inner products."""
    spark = vectors.sparkSession
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("is_query")).where(sound).withColumn("dim", F.size("embedding"))
    size = lambda x: F.abs(F.floor(256 * x.cast("double")).cast("double"))
    n, n_queries, most = rows.agg(F.count(F.lit(1)), F.sum(F.col("is_query").cast("long")), F.max(F.coalesce(F.array_max(F.transform("embedding", size)), F.lit(0.0)))).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, query_blocks = math.ceil(n / CANDIDATES), math.ceil(n_queries / QUERIES)

    def block(of: int, *what: str) -> Column:
        return F.pmod(F.xxhash64(*what, F.lit(1)), F.lit(of)).cast("int")

    def spread(of: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    once = rows.groupBy("dim", "vec_id", "embedding").agg(F.count(F.lit(1)).alias("copies"))  # more than k copies of a row can't rank
    once = once.select("dim", "vec_id", "embedding", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    candidates = once.select(F.col("dim").alias("c_dim"), spread(query_blocks).alias("c_query_block"), block(blocks, "vec_id", "embedding").alias("c_block"), F.col("vec_id").alias("vec_id"), F.col("embedding").alias("embedding"))
    least = rows.where("is_query").groupBy("vec_id").agg(F.min(F.struct("dim", "embedding")).alias("v"))
    queries = materialize(least.select("vec_id", "v.dim", "v.embedding"), "queries")
    reach = F.aggregate(F.transform("embedding", size), F.lit(0.0), lambda a, x: a + x) * F.lit(float(most)) + 1
    state = queries.select(F.col("vec_id").alias("query_id"), (-reach).cast("long").alias("low"), reach.cast("long").alias("high"), F.lit(k).cast("long").alias("need"))
    state = materialize(state, "ranges")
    queries = queries.select("dim", block(query_blocks, "vec_id").alias("query_block"), F.col("vec_id").alias("query_id"), "embedding")

    def cells(run, schema: str) -> DataFrame:
        width = F.ceil((F.col("high") - F.col("low") + 1) / BINS).cast("long")
        here = queries.join(state, "query_id").select("dim", "query_block", spread(blocks).alias("block"), "query_id", "embedding", "low", "high", width.alias("width"))
        return here.groupBy(*CELL).cogroup(candidates.groupBy(*[f"c_{c}" for c in CELL])).applyInPandas(run, schema)

    while state.where("high > low").limit(1).count():
        counts = cells(histogram(k), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        upper = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        width = F.ceil((F.col("high") - F.col("low") + 1) / BINS).cast("long")
        reached = counts.withColumn("above", F.sum("n").over(upper)).join(state, "query_id").where("above >= need").groupBy("query_id").agg(F.max(F.struct("bin", "above", "n")).alias("at"))
        later = state.join(reached, "query_id", "left").withColumn("width", width)
        low = F.coalesce(F.col("low") + F.col("at.bin") * F.col("width"), F.col("low"))
        state = materialize(
            later.select("query_id", low.alias("low"), F.when(F.col("at").isNull(), F.col("low")).otherwise(F.least(low + F.col("width") - 1, "high")).alias("high"), F.coalesce(F.col("need") - (F.col("at.above") - F.col("at.n")), "need").alias("need")),
            "ranges",
        )
    best = cells(reaching(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Fusion of ranked lists: reciprocal rank, weighted reciprocal rank, linear over min-max scores.

Lists are rows of query_id, retriever, chunk_id, score, rank. Ties of a fused
score go by first appearance: the dense list in its order, then the BM25 list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
DECIMALS = 9
FAR = 1 << 30


def candidates(dense: DataFrame, bm25: DataFrame) -> DataFrame:
    """The two lists side by side: query_id, chunk_id and each list's score and rank, null where absent."""
    d = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    b = bm25.select("query_id", "chunk_id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    return d.join(b, ["query_id", "chunk_id"], "full_outer")


def minmax(score: Column, by: list[str]) -> Column:
    """A list's scores scaled to 0..1 in each query; all equal gives 1, absent stays null."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(score.isNotNull(), F.when(hi == lo, 1.0).otherwise((score - lo) / (hi - lo)))


def rrf_part(rank: Column, k: int = RRF_K) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(k) + rank), F.lit(0.0))


def rrf_score(alpha: Column | None = None, k: int = RRF_K) -> Column:
    """Reciprocal rank score of candidates; with ``alpha`` the dense list weighs it and BM25 the rest."""
    if alpha is None:
        return F.round(rrf_part(F.col("dense_rank"), k) + rrf_part(F.col("bm25_rank"), k), DECIMALS)
    return F.round(alpha * rrf_part(F.col("dense_rank"), k) + (F.lit(1.0) - alpha) * rrf_part(F.col("bm25_rank"), k), DECIMALS)


def with_scaled(cands: DataFrame) -> DataFrame:
    """Candidates with both lists' min-max scores, absent ones zero."""
    return cands.withColumn("dense_scaled", F.coalesce(minmax(F.col("dense_score"), ["query_id"]), F.lit(0.0))).withColumn("bm25_scaled", F.coalesce(minmax(F.col("bm25_score"), ["query_id"]), F.lit(0.0)))


def linear_score(alpha: Column) -> Column:
    return F.round(alpha * F.col("dense_scaled") + (F.lit(1.0) - alpha) * F.col("bm25_scaled"), DECIMALS)


def ranked(scored: DataFrame, by: list[str], k: int | None = None) -> DataFrame:
    """Rows with rank by fused score, ties by first appearance, cut to k."""
    order = Window.partitionBy(*by).orderBy(F.col("fused").desc(), F.coalesce("dense_rank", F.lit(FAR)), F.coalesce("bm25_rank", F.lit(FAR)))
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.filter(F.col("rank") <= k)

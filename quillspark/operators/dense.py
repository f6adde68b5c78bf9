"""Exact dense search by inner product, and checks of vectors.

Queries travel to the data: their matrix is broadcast while it is small enough, each
task gives its own best k of every query, and one window merges these.
More queries are searched in blocks, each a broadcast of its own.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.ranking import KEPT, Best, record_batch
from quillspark.shipping import ship_package

#: Values (doubles) of a broadcast block of queries.
BLOCK_VALUES = 8_000_000
#: Scores that a task holds at a time.
SCORES = 4_000_000
#: Decimals of a score before it ranks.
DECIMALS = 6


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(inner_product(v, v))


def bad_norms(vectors: DataFrame, vector_col: str = "embedding", tolerance: float = 1e-3) -> DataFrame:
    """Rows whose vector is not of unit length; null vectors too."""
    return vectors.filter(F.coalesce(F.abs(norm(F.col(vector_col)) - 1) >= tolerance, F.lit(True)))


def blocks(queries: list, k: int = 1) -> list[list]:
    """Queries (id, vector) in blocks whose vectors, and whose best k, are bounded."""
    size = max(1, min(BLOCK_VALUES // max(1, len(queries[0][1]) if queries else 1), KEPT // k))
    return [queries[i : i + size] for i in range(0, len(queries), size)]


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "vector") -> DataFrame:
    """query_id, chunk_id, score, rank: the best k by inner product, ties by chunk id.

    ``queries`` has query_id and vector; a query set is read on the driver block by block.
    """
    spark = ship_package(vectors.sparkSession)
    schema = "query_id long, chunk_id long, score double"
    parts = []
    asked = [(r["query_id"], r["vector"]) for r in queries.select("query_id", "vector").toLocalIterator()]
    for block in blocks(asked, k):
        shared = spark.sparkContext.broadcast((np.array([q for q, _ in block], dtype=np.int64), np.array([v for _, v in block], dtype=np.float64)))
        parts.append(vectors.select(F.col(id_col).cast("long").alias("chunk_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("vector is not null").mapInArrow(_searcher(shared, k), schema))
    if not parts:
        return spark.createDataFrame([], schema + ", rank int")
    best = parts[0]
    for p in parts[1:]:
        best = best.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _searcher(shared, k: int):
    def run(batches):
        ids, matrix = shared.value
        best = Best(len(ids), k)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            chunk, vectors = np.asarray(batch.column(0)), np.asarray(batch.column(1).flatten()).reshape(n, -1)
            step = max(1, SCORES // n)
            for at in range(0, len(ids), step):
                best.add(at, np.round(matrix[at : at + step] @ vectors.T, DECIMALS), chunk)
        group, chunk, score = best.rows()
        yield record_batch({"query_id": ids[group], "chunk_id": chunk, "score": score})

    return run


def mean_similarity(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """q, gold, others: mean inner product of each query with the other vectors of its label, and with those of other labels.

    Both have chunk_id, vector and label. Each batch gives sums by query, so nothing grows with the pairs.
    """
    spark = ship_package(vectors.sparkSession)
    schema = "q long, s1 double, n1 long, s0 double, n0 long"
    asked = [(r["chunk_id"], r["vector"], r["label"]) for r in queries.filter("vector is not null").toLocalIterator()]
    rows = vectors.filter("vector is not null").select(F.col("chunk_id").cast("long"), F.col("vector").cast("array<double>"), F.col("label").cast("string"))

    def summer(shared):
        def run(batches):
            for batch in batches:
                ids, matrix, labels = shared.value
                n = batch.num_rows
                chunk, own = np.asarray(batch.column(0)), np.array(batch.column(2).to_pylist(), dtype=object)
                x = np.asarray(batch.column(1).flatten()).reshape(n, -1)
                step = max(1, SCORES // max(n, 1))
                for at in range(0, len(ids), step):
                    s = matrix[at : at + step] @ x.T
                    known = np.array([[v is not None for v in own]]) & np.array([[v is not None] for v in labels[at : at + step]])
                    apart = (ids[at : at + step, None] != chunk[None, :]) & known
                    same = apart & (labels[at : at + step, None] == own[None, :])
                    other = apart & ~same
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + step]), pa.array((s * same).sum(axis=1)), pa.array(same.sum(axis=1)), pa.array((s * other).sum(axis=1)), pa.array(other.sum(axis=1))], names=["q", "s1", "n1", "s0", "n0"])

        return run

    parts = []
    for block in blocks(asked):
        shared = spark.sparkContext.broadcast((np.array([q for q, _, _ in block], dtype=np.int64), np.array([v for _, v, _ in block], dtype=np.float64), np.array([None if v is None else str(v) for _, _, v in block], dtype=object)))
        parts.append(rows.mapInArrow(summer(shared), schema))
    every = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    mean = lambda s, n: F.round(F.when(F.sum(n) > 0, F.sum(s) / F.sum(n)), 6)
    return every.groupBy("q").agg(mean("s1", "n1").alias("gold"), mean("s0", "n0").alias("others"))


def similarity_matrix(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, score of every pair of two small tables of id and vector."""
    a = left.select(F.col("id").alias("left_id"), F.col("vector").alias("x"))
    b = right.select(F.col("id").alias("right_id"), F.col("vector").alias("y"))
    return a.crossJoin(b).select("left_id", "right_id", F.round(inner_product(F.col("x"), F.col("y")), DECIMALS).alias("score"))

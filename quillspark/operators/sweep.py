"""Fusion weight sweeps: scores at every weight, choice on one fold, scoring on the other.

Cross-fits read their scores more than once, so these (a row for each question and weight) are persisted: the retrieval
behind them runs once.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import fusion
from quillspark.operators.evaluate import per_query

ALPHAS = [k / 10 for k in range(11)]


def alphas(spark: SparkSession) -> DataFrame:
    """The weights of the dense list, as doubles."""
    return spark.range(len(ALPHAS)).select((F.col("id") / 10.0).alias("alpha"))


METHODS = ("rrf", "linear")


def grid(spark: SparkSession, methods: tuple = METHODS) -> DataFrame:
    """Every method with every weight."""
    return spark.createDataFrame([(m,) for m in methods], "method string").crossJoin(alphas(spark))


def swept(cands: DataFrame, gold: DataFrame, k: int, methods: tuple = METHODS) -> DataFrame:
    """method, alpha, query_id, recall, complete, rr at every weight.

    The candidates are retrieved once; methods and weights are rows of one fusion.
    """
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}")
    keys = grid(cands.sparkSession, methods)
    scored = fusion.with_scaled(cands).crossJoin(F.broadcast(keys))
    scored = scored.withColumn("fused", F.when(F.col("method") == "rrf", fusion.rrf_score(F.col("alpha"))).otherwise(fusion.linear_score(F.col("alpha"))))
    return per_query(fusion.ranked(scored, ["method", "alpha", "query_id"], k), gold, k, keys)


def with_fold(scores: DataFrame) -> DataFrame:
    """Alternate questions in id order: fold 0 has the first, third and so on."""
    ids = scores.select("query_id").distinct()
    folds = ids.withColumn("fold", (F.row_number().over(Window.orderBy("query_id")) - 1) % 2)
    return scores.join(folds, "query_id")


def choose(scores: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """Weight of the best mean for each value of ``by``; ties to the one nearest 0.5, then the higher."""
    mean = scores.groupBy(*by, "alpha").agg(F.round(F.avg(metric), 9).alias("mean"))
    order = Window.partitionBy(*by).orderBy(F.col("mean").desc(), F.abs(F.col("alpha") - F.lit(0.5)), F.col("alpha").desc())
    return mean.withColumn("r", F.row_number().over(order)).filter("r = 1").select(*by, "alpha", "mean")


def crossfit(scores: DataFrame, metric: str = "rr") -> tuple[DataFrame, DataFrame]:
    """The weight that each fold chooses, and every question scored by the weight of the other fold."""
    folded = with_fold(scores.persist())
    chosen = choose(folded, metric, ["fold"])
    other = chosen.select((1 - F.col("fold")).alias("fold"), "alpha")
    return chosen, folded.join(other, ["fold", "alpha"]).select("query_id", "fold", "alpha", "recall", "complete", "rr")


def repeated_crossfit(scores: DataFrame, metric: str = "rr", repeats: int = 200, seed: int = 20261007) -> DataFrame:
    """Cross-fitted mean less the dense mean for many random halves: repeat, alpha_a, alpha_b, held_out, delta.

    The halves are those of a Fisher-Yates shuffle driven by Python's own generator,
    so they are dealt on the driver: a list of question ids by repeat.
    """
    spark, scores = scores.sparkSession, scores.persist()
    ids = [r["query_id"] for r in scores.select("query_id").distinct().orderBy("query_id").collect()]
    rows = []
    for r in range(repeats):
        order = permuted(ids, seed + r)
        half = len(order) // 2
        rows += [(r, q, int(i >= half)) for i, q in enumerate(order)]
    folds = spark.createDataFrame(rows, "repeat int, query_id long, fold int")
    dealt = folds.join(scores, "query_id")
    chosen = choose(dealt, metric, ["repeat", "fold"])
    other = chosen.select("repeat", (1 - F.col("fold")).alias("fold"), "alpha")
    held = dealt.join(other, ["repeat", "fold", "alpha"]).groupBy("repeat").agg(F.avg(metric).alias("held_out"))
    dense = scores.filter("alpha = 1.0").agg(F.avg(metric).alias("dense"))
    sides = chosen.groupBy("repeat").agg(F.max(F.when(F.col("fold") == 0, F.col("alpha"))).alias("alpha_a"), F.max(F.when(F.col("fold") == 1, F.col("alpha"))).alias("alpha_b"))
    return sides.join(held, "repeat").crossJoin(F.broadcast(dense)).select("repeat", "alpha_a", "alpha_b", F.round("held_out", 6).alias("held_out"), F.round(F.col("held_out") - F.col("dense"), 6).alias("delta"))


def permuted(items: list, seed: int) -> list:
    """A shuffle from the generator's uniform draws alone, which Python keeps the same across versions."""
    draw, out = random.Random(seed).random, list(items)
    for last in reversed(range(1, len(out))):
        swap = int(draw() * (last + 1))
        out[last], out[swap] = out[swap], out[last]
    return out

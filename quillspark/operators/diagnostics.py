"""Signs to look at beside answers; they are no labels, and nothing that makes labels may use them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import contains_answer


def signs(answers: DataFrame) -> DataFrame:
    """Answers (reference, answer, cited, gold) with two columns for display: the answer holds the reference, a gold chunk is cited."""
    ids = lambda c: F.coalesce(F.col(c), F.array())
    return answers.withColumn("reference_in_answer", contains_answer(F.col("reference"), F.coalesce("answer", F.lit("")))).withColumn("cites_gold", F.arrays_overlap(ids("cited"), ids("gold")))

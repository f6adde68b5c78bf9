"""Materials of answer variants, assembled from documents, chunks, questions and their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import strip_disambiguation

_SPANS = "array<struct<start:int,end:int>>"


def with_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents (doc_id, title, text, sentence_spans) with their own chunks in order of chunk_id."""
    own = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "char_start", "char_end", F.col("text").alias("chunk")))).alias("chunks"))
    return docs.select("doc_id", "title", "text", F.coalesce(F.col("sentence_spans").cast(_SPANS), F.array().cast(_SPANS)).alias("sentence_spans")).join(own, "doc_id", "left")


def sentence(start: Column, end: Column) -> Column:
    """The text of a span of a document with its chunks, and the ids of the chunks that overlap it."""
    touching = F.filter(F.coalesce("chunks", F.array()), lambda c: (c["char_start"] < end) & (start < c["char_end"]))
    return F.struct(F.substring(F.col("text"), start + 1, end - start).alias("text"), F.transform(touching, lambda c: c["chunk_id"]).alias("chunk_ids"))


def assemble(questions: DataFrame, evidence: DataFrame, distractors: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """A material for each question; see ``operators.variants``.

    ``questions`` has key and answer; ``evidence`` key, place, doc_id, char_start, char_end; ``distractors`` key, place,
    doc_id. A question without evidence has no gold sentences; evidence and distractors of unknown documents are left out. What is
    gathered is bounded by a document's chunks and a question's own rows.
    """
    views = with_chunks(docs, chunks)
    spans = evidence.groupBy("key", "doc_id").agg(F.min("place").alias("first"), F.array_sort(F.collect_list(F.struct("place", F.col("char_start").alias("start"), F.col("char_end").alias("end")))).alias("gold_spans"))
    is_gold = lambda s: F.exists("gold_spans", lambda g: (g["start"] == s["start"]) & (g["end"] == s["end"]))
    paragraphs = spans.join(views, "doc_id").select(
        "key",
        F.struct(
            "first",
            "title",
            F.transform("gold_spans", lambda g: F.struct(g["place"].alias("place"), sentence(g["start"], g["end"]).alias("s"))).alias("gold"),
            F.transform(F.filter("sentence_spans", lambda s: ~is_gold(s)), lambda s: sentence(s["start"], s["end"])).alias("extras"),
        ).alias("p"),
    )
    found = paragraphs.groupBy("key").agg(F.array_sort(F.collect_list("p")).alias("p"))
    gold = F.array_sort(F.flatten(F.transform("p", lambda x: x["gold"])))
    found = found.select("key", F.transform(gold, lambda x: x["s"]).alias("gold"), F.flatten(F.transform("p", lambda x: x["extras"])).alias("extras"), F.transform("p", lambda x: x["title"]).alias("titles"))
    other = distractors.join(views, "doc_id").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", strip_disambiguation(F.col("title")).alias("title"), F.coalesce("chunks", F.array()).alias("chunks")))).alias("d"))
    other = other.select("key", F.transform(F.flatten(F.transform("d", lambda x: x["chunks"])), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["chunk"].alias("text"))).alias("distractors"), F.transform("d", lambda x: x["title"]).alias("candidates"))
    return questions.select("key", "answer").join(found, "key", "left").join(other, "key", "left").select("key", "answer", "gold", F.coalesce("extras", F.array()).alias("extras"), F.coalesce("titles", F.array()).alias("titles"), "distractors", "candidates")

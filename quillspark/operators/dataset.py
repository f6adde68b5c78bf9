"""Building an evaluation set from question-answering examples: re-layout, paragraphs, filters, sampling.

An example is _id, question, answer, type, level, supporting_facts (array of title,
sent_id) and context (array of title, sentences).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import contains_answer, normalize_answer
from quillspark.operators.sweep import permuted

_SPANS = "array<struct<start:int,end:int>>"
YES_NO, CONFLICT, UNRESOLVABLE, NOT_TWO, NOT_STATED = "yes_no_answer", "title_text_conflict", "supporting_fact_unresolvable", "gold_not_exactly_two_paragraphs", "answer_not_in_gold_sentences"


def relaid(rows: DataFrame) -> DataFrame:
    """Structs of arrays (titles beside sentences, titles beside sentence ids) as arrays of pairs."""
    facts = F.transform(F.arrays_zip(F.col("supporting_facts.title").alias("title"), F.col("supporting_facts.sent_id").alias("sent_id")), lambda x: F.struct(x["title"].alias("title"), x["sent_id"].alias("sent_id")))
    context = F.transform(F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences")), lambda x: F.struct(x["title"].alias("title"), x["sentences"].alias("sentences")))
    return rows.select(F.col("id").alias("_id"), "question", "answer", "type", "level", facts.alias("supporting_facts"), context.alias("context"))


def paragraph(sentences: Column) -> Column:
    """A text of sentences and each one's span without outer white space.

    A space goes between two sentences only where neither side has white space; a
    blank sentence has an empty span.
    """
    start = F.struct(F.lit("").alias("text"), F.array().cast(_SPANS).alias("spans"))

    def add(acc, s):
        gap = (acc["text"] != "") & (s != "") & ~s.rlike(r"^\s") & ~acc["text"].rlike(r"\s$")
        joined = F.when(gap, F.concat(acc["text"], F.lit(" "))).otherwise(acc["text"])
        at = F.length(joined)
        led = F.length(s) - F.length(F.regexp_replace(s, r"^\s+", ""))
        core = F.length(F.regexp_replace(F.regexp_replace(s, r"^\s+", ""), r"\s+$", ""))
        a = F.when(core > 0, at + led).otherwise(at)
        return F.struct(F.concat(joined, s).alias("text"), F.concat(acc["spans"], F.array(F.struct(a.cast("int").alias("start"), (a + core).cast("int").alias("end")))).alias("spans"))

    return F.aggregate(sentences, start, add)


def checked(examples: DataFrame) -> DataFrame:
    """Examples with ``paragraphs`` (title, text, spans) and ``reason``, the first filter that refuses them, or null."""
    built = examples.withColumn("paragraphs", F.transform("context", lambda p: F.struct(p["title"].alias("title"), paragraph(p["sentences"]).alias("p"))))
    built = built.withColumn("facts", F.transform("supporting_facts", lambda f: F.struct(f["title"].alias("title"), f["sent_id"].alias("sent_id"), F.get(F.filter("paragraphs", lambda p: p["title"] == f["title"]), F.lit(0))["p"].alias("p"))))
    titles = F.transform("context", lambda p: p["title"])
    span = lambda f: F.get(f["p"]["spans"], f["sent_id"])
    unresolved = F.exists("facts", lambda f: f["p"].isNull() | (f["sent_id"] < 0) | (f["sent_id"] >= F.size(f["p"]["spans"])) | (span(f)["start"] == span(f)["end"]))
    evidence = F.array_join(F.transform("facts", lambda f: F.substring(f["p"]["text"], span(f)["start"] + 1, span(f)["end"] - span(f)["start"])), " ")
    reason = (
        F.when(normalize_answer(F.col("answer")).isin("yes", "no"), YES_NO)
        .when(F.size(F.array_distinct(titles)) != F.size(titles), CONFLICT)
        .when(unresolved, UNRESOLVABLE)
        .when(F.size(F.array_distinct(F.transform("supporting_facts", lambda f: f["title"]))) != 2, NOT_TWO)
        .when(~contains_answer(F.col("answer"), evidence), NOT_STATED)
    )
    return built.withColumn("evidence", evidence).withColumn("reason", reason)


def subset(examples: DataFrame, n: int, seed: int) -> tuple[list[str], dict[str, int]]:
    """Ids of ``n`` sampled questions, and the counts of refused ones.

    The filters run in Spark. The draw is sequential by its nature: ids of the eligible
    are permuted, and one whose paragraph contradicts a chosen one of the same title is
    passed over. So the driver holds ids and digests of titles and texts, no texts.
    """
    passed = checked(examples)
    refused = {r["reason"]: r["n"] for r in passed.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).collect()}
    digests = passed.filter("reason is null").select("_id", F.transform("paragraphs", lambda p: F.struct(F.xxhash64(p["title"]).alias("t"), F.xxhash64(p["p"]["text"]).alias("x"))).alias("d")).orderBy("_id")
    eligible = [(r["_id"], [(p["t"], p["x"]) for p in r["d"]]) for r in digests.collect()]
    chosen, texts = [], {}
    for key, paragraphs in permuted(eligible, seed):
        if len(chosen) == n:
            break
        if any(texts.get(t, x) != x for t, x in paragraphs):
            refused[CONFLICT] = refused.get(CONFLICT, 0) + 1
            continue
        texts.update(paragraphs)
        chosen.append(key)
    if len(chosen) < n:
        raise ValueError(f"only {len(chosen)} eligible questions, {n} are wanted")
    return chosen, refused

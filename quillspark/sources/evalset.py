"""Evaluation sets in JSON lines: typed reading, validation, writing; and tables that are replaced by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SPAN = "struct<start:int,end:int>"
DOCUMENT = f"id string, title string, text string, sentence_spans array<{_SPAN}>, metadata string"
QUESTION = "id string, question string, reference_answer string, gold_evidence array<struct<document_id:string,start:int,end:int>>, metadata string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file with their line number (from 1) and whether the line could be read; blank lines are skipped.

    The file is read in splits. A split's rows have consecutive ids, so a line's number is its place in its split
    after the lines of the file's earlier splits.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    numbered = lines.join(splits.select("file", "block", (earlier - F.col("first")).alias("shift")), ["file", "block"]).withColumn("at", F.col("id") + F.col("shift"))
    parsed = numbered.filter(F.trim("line") != "").select((F.col("at") + 1).cast("int").alias("line_number"), F.from_json("line", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("row"))
    return parsed.select("line_number", "row.*").withColumn("readable", F.col("_bad").isNull()).drop("_bad")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that are one JSON array or object each, strictly: a malformed file is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """A small table of metrics as one JSON file; what it holds is bounded by the runs compared."""
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line with sorted keys; text is not escaped to ASCII."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def validate(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """Problems of an evaluation set: kind, id, problem. An empty result means that it may be used."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    spans = F.coalesce("sentence_spans", F.array().cast(f"array<{_SPAN}>"))
    ordered = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), lambda acc, s: F.struct(s["end"].alias("at"), (acc["ok"] & (s["start"] >= acc["at"]) & (s["end"] > s["start"])).alias("ok")), lambda acc: acc["ok"] & (acc["at"] <= F.length("text")))
    of_doc = documents.select(F.lit("document").alias("kind"), "id", F.explode(F.array_compact(F.array(F.when(blank("id"), F.lit("empty id")), F.when(blank("text"), F.lit("empty text")), F.when(~ordered, F.lit("sentence spans unsorted or out of range"))))).alias("problem"))
    evidence = F.coalesce("gold_evidence", F.array().cast("array<struct<document_id:string,start:int,end:int>>"))
    of_question = questions.select(F.lit("question").alias("kind"), "id", F.explode(F.array_compact(F.array(F.when(blank("id"), F.lit("empty id")), F.when(blank("question"), F.lit("empty question")), F.when(blank("reference_answer"), F.lit("empty answer")), F.when(F.size(evidence) == 0, F.lit("no evidence")), F.when(F.exists(evidence, lambda e: (e["start"] < 0) | (e["end"] <= e["start"])), F.lit("empty evidence span"))))).alias("problem"))
    repeated = lambda df, kind: df.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(kind).alias("kind"), "id", F.lit("repeated id").alias("problem"))
    pointed = questions.select("id", F.explode("gold_evidence").alias("e")).select("id", F.col("e.document_id").alias("doc"), F.col("e.end").alias("stop"))
    lengths = documents.groupBy(F.col("id").alias("doc")).agg(F.max(F.length("text")).alias("length"))
    across = pointed.join(lengths, "doc", "left").select(F.lit("question").alias("kind"), "id", F.when(F.col("length").isNull(), "unknown document").when(F.col("stop") > F.col("length"), "evidence past the end").alias("problem")).filter("problem is not null").distinct()
    return of_doc.unionByName(of_question).unionByName(repeated(documents, "document")).unionByName(repeated(questions, "question")).unionByName(across)


# --- keyed tables -----------------------------------------------------------------


def insert_or_ignore(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both, where a fresh one whose key exists is ignored; of equal fresh keys one stays."""
    return existing.unionByName(fresh.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def replace_by_key(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both, where all existing rows of a fresh key give way."""
    return existing.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def cascade_delete(tables: dict[str, DataFrame], root: str, children: dict[str, tuple[str, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows that hang from deleted ones.

    ``children`` maps a table to its parent and the parent's id column, by which it is joined;
    parents come before their children. ``gone`` has the root's id column.
    """
    out, removed = {}, {root: gone}
    key = gone.columns[0]
    out[root] = tables[root].join(gone, key, "left_anti")
    for name, (parent, column) in children.items():
        ids = removed[parent].select(column)
        out[name] = tables[name].join(ids, column, "left_anti")
        removed[name] = tables[name].join(ids, column, "left_semi")
    return out


def save(df: DataFrame, path: str, replace: bool = False, by: list[str] | None = None) -> None:
    """Write a table; an existing one is an error unless it is replaced. With ``by`` only the partitions at hand are."""
    writer = df.write.mode("overwrite" if replace else "errorifexists")
    if by:
        writer = writer.partitionBy(*by)
        if replace:
            writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)

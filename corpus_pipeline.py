"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages read the columns of documents
and give them back, the last one aside; other columns are left out, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bpe import round_trip
from quillspark.llm.common import shared_folder
from quillspark.llm.decontaminate import find_contamination
from quillspark.llm.line_dedup import ALONE, dedup_lines
from quillspark.llm.simhash import first_of_similar
from quillspark.llm.toxicity import without_toxic
from quillspark.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a near-duplicate shingle, and the share of common shingles from which texts are near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model does not predict toxic; see :func:`without_toxic` for nulls and repeated rows."""
    return without_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def dedup_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines of later repeated runs and later single lines that are not very short.

    Null texts stay null, rows without an id come first, and equal rows keep the same lines; see :func:`dedup_lines`.
    """
    return _documents(dedup_lines(docs.select(*COLUMNS), alone=ALONE))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the row of the smallest id; see :func:`first_of_similar` for nulls and repeated rows."""
    return first_of_similar(docs.select(*COLUMNS), SHINGLE, SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with windows of two benchmark items or with mostly hit words; cut the hit spans from the others.

    Each row is judged by its own text, whatever its id; null and empty texts and an empty benchmark hit nothing.
    """
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), with_text=True).filter("n_hit > 0")
    hit = found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "n_words", "n_hit", F.size("item_ids").alias("n_items"), "clean_text").dropDuplicates(["d", "k"])
    own = docs.select(*COLUMNS)
    joined = own.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("k")), "left")
    clean = joined.filter(F.col("n_hit").isNull() | ((F.col("n_items") < 2) & (2 * F.col("n_hit") < F.col("n_words"))))
    return _documents(clean.withColumn("text", F.when(F.col("n_hit").isNotNull(), F.col("clean_text")).otherwise(F.col("text"))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to: doc_id, n_tokens, ids, text.

    A null text has no ids and decodes to an empty one; rows are independent, so null and repeated ids stay as they are.
    """
    decoded = round_trip(docs)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.decode("data", "UTF-8").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

#: SQL cannot express the trained model or the components; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

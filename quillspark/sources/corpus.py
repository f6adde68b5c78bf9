"""Corpora on disk: documents, questions, chunk sets and embeddings below one folder, each under its own keys."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import chunking
from quillspark.shipping import ship_package
from quillspark.sources import evalset

#: How far from one the length of a vector may be.
NORM_TOLERANCE = 1e-3


class Embedder(Protocol):
    """What makes vectors: unit rows of ``dim`` values; questions may get an instruction before their text."""

    dim: int
    instruction: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


def of(spark: SparkSession, path: str, **keys) -> DataFrame | None:
    """The rows under these keys, which are partitions, or None where there are none."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    for name, value in keys.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    return None if rows.isEmpty() else rows


def get_or_create(spark: SparkSession, path: str, make: Callable[[], DataFrame], **keys) -> tuple[DataFrame, bool]:
    """The rows under these keys, made and written if there are none, and whether they were made."""
    found = of(spark, path, **keys)
    if found is not None:
        return found, False
    made = make()
    for name, value in keys.items():
        made = made.withColumn(name, F.lit(value))
    evalset.save(made, path, replace=True, by=list(keys))
    return of(spark, path, **keys), True


def load_corpus(spark: SparkSession, root: str, corpus: str, documents: DataFrame, questions: DataFrame) -> None:
    """Store a valid evaluation set under a corpus's name; one that is there is an error, and so is an invalid set."""
    problems = evalset.validate(documents, questions).limit(5).collect()
    if problems:
        raise ValueError(f"not loaded: {[tuple(p) for p in problems]}")
    if of(spark, f"{root}/documents", corpus=corpus) is not None:
        raise ValueError(f"there is a corpus {corpus!r} already")
    for name, rows in (("documents", documents), ("questions", questions)):
        evalset.save(rows.withColumn("corpus", F.lit(corpus)), f"{root}/{name}", replace=True, by=["corpus"])


def chunk_set(spark: SparkSession, root: str, corpus: str, config: chunking.Config) -> tuple[DataFrame, bool]:
    """The chunks of a corpus by one configuration, with ids of their own, made once."""

    def make():
        docs = of(spark, f"{root}/documents", corpus=corpus)
        if docs is None:
            raise ValueError(f"there is no corpus {corpus!r}")
        made = chunking.chunk(docs.select(F.col("id").alias("doc_id"), "text", F.col("sentence_spans").alias("spans")), config, "spans" if config.strategy == "sentence_window" else None)
        return made.select(F.xxhash64(F.lit(corpus), F.lit(config.label), "doc_id", "position").alias("chunk_id"), "doc_id", "position", "char_start", "char_end", "text")

    return get_or_create(spark, f"{root}/chunks", make, corpus=corpus, chunk_set=config.label)


def embedded(rows: DataFrame, make: Callable[[], Embedder], id_col: str, text_col: str = "text", questions: bool = False) -> DataFrame:
    """id and vector of every row; a batch of another shape or with vectors that are not of unit length is refused."""
    ship_package(rows.sparkSession)

    def run(batches):
        embedder = make()
        for batch in batches:
            texts = [(embedder.instruction if questions else "") + (t or "") for t in batch.column(1).to_pylist()]
            vectors = np.asarray(embedder.embed(texts), dtype=np.float64)
            if vectors.shape != (len(texts), embedder.dim):
                raise ValueError(f"{len(texts)} texts gave vectors of shape {vectors.shape}, not {(len(texts), embedder.dim)}")
            if (off := np.abs(np.linalg.norm(vectors, axis=1) - 1) > NORM_TOLERANCE).any():
                raise ValueError(f"{int(off.sum())} of {len(texts)} vectors are not of unit length")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), embedder.dim).cast(pa.list_(pa.float64()))], names=["id", "vector"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, vector array<double>")


def embeddings(spark: SparkSession, root: str, corpus: str, config: chunking.Config, model: str, make: Callable[[], Embedder]) -> tuple[DataFrame, bool]:
    """Vectors of a chunk set by one model, made once."""
    return get_or_create(spark, f"{root}/embeddings", lambda: embedded(chunk_set(spark, root, corpus, config)[0], make, "chunk_id"), corpus=corpus, chunk_set=config.label, model=model)


def chunks_by_id(chunks: DataFrame, ids: list[int]) -> DataFrame:
    """The chunks of a short list of ids, with their place in it; unknown ids are left out."""
    place = F.create_map(*[x for i, c in enumerate(dict.fromkeys(ids)) for x in (F.lit(c).cast("long"), F.lit(i))]) if ids else None
    found = chunks.filter(F.col("chunk_id").isin(ids)) if ids else chunks.limit(0)
    return found.withColumn("place", place[F.col("chunk_id")] if ids else F.lit(0))


def first_questions(questions: DataFrame, n: int | None, id_col: str = "id") -> DataFrame:
    """Questions in order of their ids, the first n where a report asks for so many."""
    ordered = questions.orderBy(id_col)
    return ordered if n is None else ordered.limit(n)

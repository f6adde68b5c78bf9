"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shipping import ship_package

#: Texts that one Python call holds at a time, by count and by bytes.
SLICE_ROWS = 2048
SLICE_BYTES = 4 << 20


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that a text operator reads, under fixed names; a null text stays null."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold few enough bytes of text, one row at least."""
    texts = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    start, n = 0, len(sizes)
    while start < n:
        most = (ends[start - 1] if start else 0) + limit
        stop = min(max(int(np.searchsorted(ends, most, side="right")), start + 1), start + SLICE_ROWS, n)
        yield batch.slice(start, stop - start)
        start = stop


def release_memory() -> None:
    """Give freed memory back to the system, since Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def map_text(docs: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Apply ``make()(ids, texts)`` to parts of the rows, where it returns Arrow columns by name.

    ``make`` runs once in each task; texts are Python strings or None. Columns of the schema that it
    does not return are those of ``docs``, row by row.
    """
    ship_package(docs.sparkSession)
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch):
                made = step(part.column("doc_id"), part.column("text").to_pylist())
                arrays = []
                for f in target:
                    values = made[f.name] if f.name in made else part.column(f.name)
                    arrays.append(values.cast(f.type) if isinstance(values, pa.Array) else pa.array(values, type=f.type))
                yield pa.RecordBatch.from_arrays(arrays, schema=target)
        del step
        release_memory()

    return docs.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the one that the cluster shares.

    ``spark.checkpoint.dir`` names it; where that is unset a local session, as in
    tests, takes a temporary folder of its machine, and any other is refused.
    """
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, "_quillspark_shared", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="quillspark-shared-")
            spark.sparkContext._quillspark_shared = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def row_key(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """128 bits of hash that tell rows apart by id and text, also where ids are null or repeat."""
    return F.xxhash64(id_col, text_col), F.xxhash64(F.lit(1), id_col, text_col)


#: The setting by which Spark removes an execution's shuffle files when it ends, and not whenever the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back; what was shuffled to make them is removed."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: A key of more rows than this, and than this share of all, is a hot one.
HOT_ROWS, HOT_SHARE = 2048, 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``groups``, which has one row for each of the not null keys and the number n of its rows.

    Hot keys, of which there can be a thousand at most, are broadcast with what their groups say, so no
    task gathers the rows of one.
    """
    least = max(HOT_ROWS, total // HOT_SHARE)
    others = [c for c in groups.columns if c not in keys]
    hot = F.broadcast(groups.filter(F.col("n") > least).select(*keys, F.struct(*others).alias("__qs_g")))
    tagged = rows.join(hot, keys, "left")
    found = tagged.filter("__qs_g is not null").select(*rows.columns, *[F.col(f"__qs_g.{c}").alias(c) for c in others])
    rest = tagged.filter("__qs_g is null").drop("__qs_g").join(groups.filter(F.col("n") <= least), keys)
    return found.unionByName(rest.select(*found.columns))

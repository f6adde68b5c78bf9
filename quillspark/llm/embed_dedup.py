"""Embedding near-duplicates by randomised-rotation binary codes.

Vectors of one label are compared by cosine. Equal vectors count as one, with their number. A vector is
rotated by a fixed random rotation; its code is the packed signs of the coordinates, and its correction
factor f the cosine between the rotated vector and its code. Codes and factors are made once and stored. A pair goes through

1. XOR and popcount of the packed codes: coordinates of unlike sign are limited for certain, since each adds its square
   to the squared distance, and by a confidence bound, since each sign differs with a probability of the angle over pi;
2. the estimate s / f of the inner product, where s is the product of one vector's code and the other vector: it is
   unbiased, and for a pair at the threshold t off by ``sqrt(1 - t^2) * sqrt(1 - f^2) / f`` at most, or with confidence
   by a fraction of that which shrinks with the dimension; a pair whose interval reaches the threshold
3. is computed again exactly, in double precision, and only that makes a link.

Labels of up to ``WHOLE`` vectors are compared as a whole, in blocks. The vectors of a larger one meet where all signs of
some table of random hyperplanes agree; a table has as many as make its cells small, and there are as many tables as find
a pair at the threshold but with a probability of ``MISS``. A pair counts in the first table where it meets. A cell is dealt
to pairs of blocks, so no task holds more than two blocks of it, and a block
gives counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import functools
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import join_groups, written
from quillspark.llm.components import connected_components, forest
from quillspark.shipping import ship_package
from quillspark.sources.tables import table

THRESHOLD = 0.98
#: Vectors of a block, of a label that is compared as a whole, and of a cell of a larger one about.
BLOCK, WHOLE, CELL = 2048, 8192, 1024
#: Probability that a bound of confidence or the tables lose a pair at the threshold.
MISS = 1e-9
#: Deviations of the estimate that hold with that confidence.
SURE = 6.0
SEED = 20240229
#: Pairs of a step.
STEP = 1 << 20


@functools.lru_cache(maxsize=8)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng((seed, dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors, their packed sign bits (whole words of 64) and their correction factors."""
    dim = unit.shape[1]
    rotated = unit @ rotation(dim, seed)
    bits = np.zeros((len(unit), -(-dim // 64) * 64), dtype=np.uint8)
    bits[:, :dim] = rotated >= 0
    return rotated, np.packbits(bits, axis=1), np.minimum(np.abs(rotated).sum(axis=1) / np.sqrt(dim), 1.0)


def most_unlike(rotated: np.ndarray, threshold: float) -> np.ndarray:
    """How many signs of each rotated unit vector a vector that links with it may differ in, for certain and with confidence."""
    dim = rotated.shape[1]
    # a coordinate of unlike sign is nearer to zero than to the other vector's
    certain = (np.cumsum(np.sort(rotated * rotated, axis=1), axis=1) <= 2 - 2 * threshold + 1e-9).sum(axis=1)
    return np.minimum(certain, confident_unlike(dim, threshold)).astype(np.int32)


@functools.lru_cache(maxsize=64)
def confident_unlike(dim: int, threshold: float) -> int:
    """The least number of unlike signs that a pair at the threshold exceeds with a probability of ``MISS`` at most."""
    p = float(np.arccos(min(threshold, 1.0)) / np.pi)
    if not 0 < p < 1:
        return dim
    left, term, log = 1.0, 0, 0.0
    while term < dim:
        log = lgamma(dim + 1) - lgamma(term + 1) - lgamma(dim - term + 1) + term * np.log(p) + (dim - term) * np.log1p(-p)
        left -= float(np.exp(log))
        if left < MISS:
            break
        term += 1
    return term


def estimate(bits: np.ndarray, factor: np.ndarray, rotated: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased inner products of coded vectors and rotated ones, row by row, and the half width for pairs at the threshold."""
    dim = rotated.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float64) * 2 - 1
    value = np.einsum("ij,ij->i", signs, rotated) / (np.sqrt(dim) * factor)
    share = min(1.0, SURE / np.sqrt(max(dim - 1, 1)))
    return value, np.sqrt(max(1 - threshold * threshold, 0.0)) * np.sqrt(1 - factor * factor) / factor * share


def links_between(x: dict, y: dict, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x and y (vectors v, codes, factors, most) whose cosine in double precision reaches the threshold."""
    dim = x["v"].shape[1]
    nx, ny = np.linalg.norm(x["v"], axis=1), np.linalg.norm(y["v"], axis=1)
    rotated = (y["v"] / ny[:, None]) @ rotation(dim)
    cx, cy = (c["code"].view(np.uint64) for c in (x, y))
    found = []
    rows = max(1, STEP // len(cy))
    for k in range(0, len(cx), rows):
        unlike = sum(np.bitwise_count(cx[k : k + rows, None, w] ^ cy[None, :, w]).astype(np.int32) for w in range(cx.shape[1]))
        i, j = np.nonzero(unlike <= np.minimum(x["most"][k : k + rows, None], y["most"][None, :]))
        i += k
        for at in range(0, len(i), 1 << 15):
            a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            value, width = estimate(x["code"][a], x["factor"][a], rotated[b], threshold)
            near = value + width >= threshold - 1e-9
            a, b = a[near], b[near]
            exact = np.einsum("ij,ij->i", x["v"][a], y["v"][b]) / (nx[a] * ny[b]) >= threshold
            found.append((a[exact], b[exact]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def tables_for(n: int, threshold: float) -> tuple[int, int]:
    """Hyperplanes of a table and tables for a label of ``n`` vectors; (0, 1) where it is compared as a whole."""
    if n <= WHOLE:
        return 0, 1
    k = max(1, int(np.ceil(np.log2(n / CELL))))
    agree = float((1 - np.arccos(min(threshold, 1.0)) / np.pi) ** k)
    return k, max(1, int(np.ceil(np.log(MISS) / np.log1p(-agree)))) if agree < 1 else 1


@functools.lru_cache(maxsize=64)
def hyperplanes(dim: int, k: int, tables: int) -> np.ndarray:
    return np.random.default_rng((SEED, dim, k)).standard_normal((dim, k * tables))


def table_keys(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """The cell of each vector in each table."""
    signs = (unit @ hyperplanes(unit.shape[1], k, tables) >= 0).reshape(len(unit), tables, k)
    return signs @ (np.int64(1) << np.arange(k, dtype=np.int64))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as doubles."""
    flat = np.asarray(column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()).astype(np.float64)
    m = flat.reshape(len(column), -1)
    # by a power of two, which is exact, so that no square overflows or vanishes
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, initial=0.0))[1][:, None]) if m.size else m


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links of all vectors: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine
    reaches the threshold. Null and zero vectors, ones with null or non-finite components and rows
    without an id link with nothing: no links, a component of their own, kept. Vectors are scaled by powers of two, so
    norms neither overflow nor vanish. Repeated rows are
    vectors of their own with one name. An empty table gives no rows; other columns are ignored.
    """
    spark = ship_package(vectors.sparkSession)
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    keyed = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("h1", F.when(F.col("fine"), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("fine"), F.xxhash64(F.lit(1), "label", "v")))
    members = written(keyed.select("vec_id", "fine", "h1", "h2"), "members")
    distinct = written(keyed.filter("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("dim", F.size("v")), "vectors")
    sizes = distinct.groupBy("label", "dim").agg(F.count("*").alias("n"))
    sized = join_groups(distinct, sizes, ["label", "dim"], distinct.count())

    def place(batches):
        for batch in batches:
            dims, n = np.asarray(batch.column("dim")), np.asarray(batch.column("n"))
            for dim, count in np.unique(np.stack([dims, n], axis=1), axis=0).tolist():
                part = batch.take(pa.array(np.flatnonzero((dims == dim) & (n == count))))
                unit = _unit(_matrix(part.column("v")))
                rotated, bits, factor = codes(unit)
                k, tables = tables_for(count, threshold)
                keys = table_keys(unit, k, tables) if k else np.zeros((len(unit), 1), dtype=np.int64)
                most = most_unlike(rotated, threshold)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([part.column("label"), part.column("dim"), pa.array(n[(dims == dim) & (n == count)]), pa.array(np.full(len(unit), t, dtype=np.int32)), pa.array(keys[:, t].copy()), part.column("rep"), part.column("w"), part.column("v"), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(factor), pa.array(most)], names=["label", "dim", "n", "table", "cell", "rep", "w", "v", "code", "factor", "most"])

    placed = written(sized.select("label", "dim", "n", "rep", "w", "v").mapInArrow(place, "label string, dim int, n long, table int, cell long, rep long, w long, v array<double>, code binary, factor double, most int"), "cells")
    where = ["label", "dim", "table", "cell"]
    counts = placed.groupBy(*where).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = join_groups(placed.withColumnRenamed("n", "of_label"), counts, where, placed.count())
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = sent.select(F.xxhash64(*where, low, high).alias("g"), *where, F.col("of_label").alias("n"), (F.col("own") == low).alias("x"), (F.col("own") == high).alias("y"), "rep", "w", "v", "code", "factor", "most").repartition(parts, "g").sortWithinPartitions("g", *where, "rep")

    def compare(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 4 * BLOCK:
                whole = pa.Table.from_batches(held)
                g = np.asarray(whole.column("g"))
                cut = int(np.flatnonzero(g == g[-1])[0])
                if cut:
                    yield from groups(whole.slice(0, cut))
                    held, size = whole.slice(cut).to_batches(), len(g) - cut
        if held:
            yield from groups(pa.Table.from_batches(held))

    def groups(part: pa.Table):
        part = part.combine_chunks()
        g, label = np.asarray(part.column("g")), part.column("label").to_pylist()
        dim, table_of, cell = (np.asarray(part.column(c)) for c in ("dim", "table", "cell"))
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (dim[1:] != dim[:-1]) | (table_of[1:] != table_of[:-1]) | (cell[1:] != cell[:-1]) | np.array([p != q for p, q in zip(label, label[1:], strict=False)], dtype=bool)
        starts = np.flatnonzero(new).tolist()
        a, b, n = [], [], []
        for start, stop in zip(starts, [*starts[1:], len(g)], strict=True):
            if stop - start < 2:
                continue
            piece = part.slice(start, stop - start)
            rep, w, on_x, on_y = (np.asarray(piece.column(c)) for c in ("rep", "w", "x", "y"))
            x, y = np.flatnonzero(on_x), np.flatnonzero(on_y)
            if not len(x) or not len(y):
                continue
            whole = {"v": _matrix(piece.column("v")), "code": np.frombuffer(b"".join(piece.column("code").to_pylist()), np.uint8).reshape(len(rep), -1), "factor": np.asarray(piece.column("factor")), "most": np.asarray(piece.column("most"))}
            i, j = links_between({c: m[x] for c, m in whole.items()}, {c: m[y] for c, m in whole.items()}, threshold)
            i, j = x[i], y[j]
            once = (i < j) if on_x[on_y].any() else (i != j)
            i, j = i[once], j[once]
            t = int(table_of[start])
            if t and len(i):  # pairs that met in an earlier table have counted there
                keys = table_keys(_unit(whole["v"]), *tables_for(int(np.asarray(piece.column("n"))[0]), threshold))[:, :t]
                first = np.concatenate([(keys[i[at : at + STEP]] != keys[j[at : at + STEP]]).all(axis=1) for at in range(0, len(i), STEP)])
                i, j = i[first], j[first]
            if not len(i):
                continue
            links = np.bincount(i, weights=w[j], minlength=len(rep)) + np.bincount(j, weights=w[i], minlength=len(rep))
            some = np.flatnonzero(links)
            p, q = forest(rep[i], rep[j])
            a += [rep[some], p]
            b += [rep[some], q]
            n += [links[some].astype(np.int64), np.zeros(len(p), dtype=np.int64)]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(n))], names=["a", "b", "n"])

    found = written(grouped.mapInArrow(compare, "a long, b long, n long"), "links")
    linked = found.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    components = connected_components(found.filter("a <> b").select("a", "b"), "embedding")
    result = distinct.select("h1", "h2", "rep", "w").join(linked, "rep", "left").join(components, F.col("rep") == F.col("node"), "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    joined = members.join(result, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings; see :func:`embedding_links`."""
    return embedding_links(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE fine AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.98e0),
reach AS (SELECT a AS start, b AS there FROM links UNION SELECT r.start, l.b FROM reach r JOIN links l ON l.a = r.there),
least_of AS (SELECT start, min(there) AS low FROM reach GROUP BY start),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN counted ON a = vec_id LEFT JOIN least_of ON start = vec_id
"""

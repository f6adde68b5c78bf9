"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

The set is built once: words are numbered, and each window is a row of numbers under a 64-bit hash, in arrays sorted by hash.
Windows of a training text are hashed where all their words are known, looked up in one search, and verified number by number.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import id_text, map_text, slices
from quillspark.shipping import ship_package
from quillspark.sources.tables import table

#: Words in a window.
WINDOW = 8
#: Bytes of benchmark text up to which its windows are broadcast, at 48 bytes a window 100 MB at most; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 4 << 20

#: A-Z become a-z; ASCII characters that are neither letters nor digits become spaces.
_TABLE = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Normalised words of a text: a null or blank text has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _hashes(rows: np.ndarray) -> np.ndarray:
    """64 bits of each row of word numbers."""
    h = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        h = (h ^ (rows[:, k].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


class NgramIndex:
    """Hash set of the test n-grams, with the item ids of each, and their vocabulary."""

    def __init__(self, items, window: int = WINDOW):
        self.known: dict[bytes, int] = {}
        self.items: list[str] = []
        rows: dict[int, list] = {}
        for item_id, text in items:
            words = words_of(text)
            if words:
                ids = np.array([self.known.setdefault(w, len(self.known)) for w in words], dtype=np.int32)
                found = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
                rows.setdefault(found.shape[1], []).append(np.column_stack([found, np.full(len(found), len(self.items), dtype=np.int32)]))
                self.items.append(item_id)
        self.by_length = {}
        for m, parts in sorted(rows.items()):
            every = np.unique(np.concatenate(parts), axis=0)
            hashes = _hashes(every[:, :m])
            order = np.argsort(hashes, kind="stable")
            self.by_length[m] = hashes[order], every[order]

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Marks of the words inside an occurrence of a window, and the items that occur."""
        n = len(words)
        marks, found = np.zeros(n + 1, dtype=np.int32), set()
        if not n or not self.by_length:
            return marks[:n] > 0, found
        ids = np.fromiter(map(self.known.get, words, repeat(-1, n)), dtype=np.int32, count=n)
        total = np.concatenate(([0], np.cumsum(ids >= 0, dtype=np.int64)))
        for m, (hashes, rows) in self.by_length.items():
            at = np.flatnonzero(total[m:] - total[:-m] == m) if m <= n else total[:0]
            if not len(at):
                continue
            asked = np.lib.stride_tricks.sliding_window_view(ids, m)[at]
            h = _hashes(asked)
            low = np.searchsorted(hashes, h, side="left")
            count = np.searchsorted(hashes, h, side="right") - low
            some = np.flatnonzero(count)
            for k in range(0, len(some), 1 << 12):
                part = some[k : k + (1 << 12)]
                which = np.repeat(part, count[part])
                row = np.arange(len(which)) - np.repeat(np.cumsum(count[part]) - count[part], count[part]) + low[which]
                same = (rows[row, :m] == asked[which]).all(axis=1)
                found.update(np.unique(rows[row[same], m]).tolist())
                start = at[np.unique(which[same])]
                marks[start] += 1
                marks[start + m] -= 1
        return np.cumsum(marks[:n]) > 0, {self.items[i] for i in found}


def _word_spans(text: str) -> list[tuple[int, int]]:
    """Code point spans of the normalised words of a text."""
    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


SCHEMA = "doc_id long, text_key long, n_words long, n_hit long, item_ids array<string>, clean_text string"


def text_key(text: str | None) -> int:
    """Spark's xxhash64 of a text column, by which rows of one doc_id are told apart."""
    if text is None:
        return 42
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return value - (1 << 64) if value >> 63 else value


def _stripped(text: str | None, marks: np.ndarray) -> str | None:
    """The text without its hit words and what lies between them."""
    if text is None or not marks.any():
        return text
    spans, keep, at, i = _word_spans(text), [], 0, 0
    n = len(spans)
    while i < n:
        if marks[i]:
            j = i
            while j + 1 < n and marks[j + 1]:
                j += 1
            keep.append(text[at : spans[i][0]])
            at = spans[j][1]
            i = j + 1
        else:
            i += 1
    keep.append(text[at:])
    return "".join(keep)


def _small_benchmark(benchmark: DataFrame) -> bool:
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("b")).first()["b"]
    return size <= BROADCAST_BYTES


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Occurrences of benchmark windows in documents.

    Returns doc_id, text_key (Spark's xxhash64 of the text), n_words, n_hit, item_ids (distinct, as strings, sorted as
    strings) and, if asked for, clean_text without the hit spans. A null text
    has no words and its clean text is null; empty tables give no hits; repeated rows
    are judged each on its own; an item with a null id counts under the name
    "null". Other columns are ignored.

    The windows are broadcast while the benchmark has up to
    ``BROADCAST_BYTES`` of text; a larger one is joined by a shuffle.
    """
    source = id_text(docs, id_col, text_col)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    if not _small_benchmark(items):
        return _joined(source, items, window, with_text)
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(NgramIndex([(r["item_id"], r["text"]) for r in items.collect()], window))

    def make():
        index = shared.value  # one for each worker, however many tasks it runs

        def step(ids, texts):
            keys, words, hit, found, clean = [], [], [], [], []
            for text in texts:
                keys.append(text_key(text))
                w = words_of(text)
                marks, occurring = index.hits(w)
                words.append(len(w))
                hit.append(int(marks.sum()))
                found.append(sorted(occurring))
                clean.append(_stripped(text, marks) if with_text else None)
            return {"doc_id": ids, "text_key": keys, "n_words": words, "n_hit": hit, "item_ids": found, "clean_text": clean}

        return step

    return map_text(source, make, SCHEMA)


def _joined(source: DataFrame, items: DataFrame, window: int, with_text: bool) -> DataFrame:
    """The same by a shuffle join on the windows' digests, for a benchmark of any size.

    A key holds a 128-bit and an independent 64-bit digest of a window's words.
    """
    ship_package(source.sparkSession)

    def grams(batches, sizes):
        for batch in (p for b in batches for p in slices(b)):
            rows, at, lengths, digests = [], [], [], []
            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                w = words_of(text)
                for m in sizes if sizes else [min(window, len(w))]:
                    for i in range(len(w) - m + 1 if m else 0):
                        gram = b" ".join(w[i : i + m])
                        rows.append(row)
                        at.append(i)
                        lengths.append(m)
                        digests.append(xxhash.xxh3_128_digest(gram) + xxhash.xxh64_digest(gram, 7))
            take = pa.array(rows, pa.int64())
            ids = [batch.column(k).take(take) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(at, pa.int32()), pa.array(lengths, pa.int32()), pa.array(digests, pa.binary())], names=[*batch.schema.names[:-1], "at", "m", "h"])

    tests = items.mapInArrow(lambda b: grams(b, None), "item_id string, at int, m int, h binary").select("item_id", "m", "h").distinct()
    sizes = [r["m"] for r in tests.select("m").distinct().orderBy("m").collect()]  # at most as many as the window has words
    keyed = source.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    seen = keyed.mapInArrow(lambda b: grams(b, sizes), "doc_id long, text_key long, at int, m int, h binary") if sizes else keyed.select("doc_id", "text_key", F.lit(0).alias("at"), F.lit(0).alias("m"), F.lit(b"").alias("h")).limit(0)
    hits = seen.distinct().join(tests.drop("m"), "h").groupBy("doc_id", "text_key").agg(F.collect_set("item_id").alias("item_ids"), F.collect_set(F.struct("at", "m")).alias("spans"))
    k, h = keyed.alias("k"), hits.alias("h")
    joined = k.join(h, F.col("k.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("k.text_key") == F.col("h.text_key")), "left").select("k.doc_id", "k.text_key", "k.text", "h.item_ids", "h.spans")

    def finish(batches):
        for batch in (p for b in batches for p in slices(b)):
            words, hit, found, clean = [], [], [], []
            for text, ids, spans in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                marks = np.zeros(len(words_of(text)), dtype=bool)
                for x in spans or []:
                    marks[x["at"] : x["at"] + x["m"]] = True
                words.append(len(marks))
                hit.append(int(marks.sum()))
                found.append(sorted(ids or []))
                clean.append(_stripped(text, marks) if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(clean, pa.string())], names=["doc_id", "text_key", "n_words", "n_hit", "item_ids", "clean_text"])

    return joined.mapInArrow(finish, SCHEMA)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document; see :func:`find_contamination`."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("item_ids") >= 2).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = rf"""
WITH dw AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, {_SQL_WORDS} AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (
  SELECT item_id, w, least(8, len(w)) AS m, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bg),
dg AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)),
hits AS (SELECT dg.doc_id, dg.i, dg.m, bg.item_id FROM dg JOIN bg ON bg.g = dg.g AND bg.m = dg.m),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(items.n, 0) >= 2 AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN items ON items.doc_id = dw.doc_id
"""

"""Exact substring deduplication by recompression.

Every document is a sequence of word hashes. A round of recompression names the pairs of
a left and a right symbol, and then the maximal runs of equal symbols; which symbols are
left or right is a bit of their name in that round. A name is a hash of
what it stands for, so all tasks name alike without a common dictionary, and
equal substrings get the same symbols in their interior. With each symbol goes
its dependence: the words that its making looked at. A symbol whose dependence lies in a window is
made alike wherever the window's words stand.

The anchor of a window is the longest symbol whose dependence the window holds
(then the least name, then the leftmost), which only the window's own words
decide. So equal windows have equal anchors, and windows with an anchor of their own are
unique. Neighbouring windows mostly share an anchor and become one record:

1. records of equal anchor and equal words repeat as a whole: all but the first go;
2. where records of equal anchor have different words around it, the first of each is
   read again, and its windows are compared one by one by 128-bit hashes of their words.

A task settles the repeats among its own records before the shuffle, so the records of a
passage that stands in most documents shrink to a few for each task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import slices, written
from quillspark.shipping import ship_package
from quillspark.sources.tables import table

#: Words in a window.
WINDOW = 20
#: Bytes of text that a task names at a time.
SLICE_BYTES = 3 << 20
#: Rounds of recompression; symbols longer than a window are of no use.
ROUNDS = 6

_U = np.uint64
_B1, _B2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_FAR = 1 << 40


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of bytes other than ASCII white space; a null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


class RangeHash:
    """Hashes of any range of a sequence, two independent ones of 64 bits."""

    def __init__(self, h: np.ndarray):
        self.sums, self.inverse = [], []
        for base in (_B1, _B2):
            power = np.empty(len(h) + 1, dtype=np.uint64)
            power[0] = 1
            np.multiply.accumulate(np.full(len(h), base, dtype=np.uint64), out=power[1:])
            back = np.empty(len(h) + 1, dtype=np.uint64)
            back[0] = 1
            np.multiply.accumulate(np.full(len(h), _U(pow(int(base), -1, 1 << 64)), dtype=np.uint64), out=back[1:])
            total = np.zeros(len(h) + 1, dtype=np.uint64)
            np.cumsum(h * power[:-1], out=total[1:])
            self.sums.append(total)
            self.inverse.append(back)

    def of(self, start: np.ndarray, stop: np.ndarray, k: int) -> np.ndarray:
        return _mix((self.sums[k][stop] - self.sums[k][start]) * self.inverse[k][start])


def symbols(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS, window: int = WINDOW):
    """Pairs and runs that the rounds name: name, start, end, dependence from, to (words, ends exclusive).

    ``first`` marks the first word of each document. What looked beyond a
    document's edge depends on words that no window holds.
    """
    name, a = h, np.arange(len(h), dtype=np.int64)
    b, dl, dr = a + 1, a.copy(), a + 1
    out = []
    for r in range(rounds):
        n = len(name)
        if n < 2:
            break
        last = np.append(first[1:], True)
        bit = (_mix(name + _U(0xD1B54A32D192ED03 * (r + 1) & (1 << 64) - 1)) >> _U(63)).astype(bool)
        opens = np.zeros(n, dtype=bool)
        opens[:-1] = ~bit[:-1] & bit[1:] & ~last[:-1]
        closes = np.zeros(n, dtype=bool)
        closes[1:] = opens[:-1]
        alone = ~(opens | closes)
        # what a lone symbol looked at: a neighbour on each side, and one more past an equal neighbour
        left = np.full(n, -_FAR, dtype=np.int64)
        right = np.full(n, _FAR, dtype=np.int64)
        left[1:] = np.where(first[1:], -_FAR, dl[:-1])
        right[:-1] = np.where(last[:-1], _FAR, dr[1:])
        same = np.zeros(n, dtype=bool)  # equal to the one before
        same[1:] = (name[1:] == name[:-1]) & ~first[1:]
        further = np.full(n, -_FAR, dtype=np.int64)
        further[1:] = left[:-1]
        left = np.where(same, np.minimum(left, further), left)
        further = np.full(n, _FAR, dtype=np.int64)
        further[:-1] = right[1:]
        right = np.where(np.append(same[1:], False), np.maximum(right, further), right)
        wide_l, wide_r = np.where(alone, np.minimum(dl, left), dl), np.where(alone, np.maximum(dr, right), dr)
        goes_on = np.zeros(n, dtype=bool)
        goes_on[1:] = same[1:] & alone[1:] & alone[:-1]
        starts = np.flatnonzero(~(closes | goes_on))
        size = np.diff(np.append(starts, n))
        ends = starts + size - 1
        pair, run = opens[starts], (size > 1) & ~opens[starts]
        new = name[starts].copy()
        new[pair] = _mix(_mix(name[starts[pair]] + _U(r + 1)) * _U(3) + name[starts[pair] + 1])
        new[run] = _mix(_mix(name[starts[run]] ^ _U(0xA5A5A5A5A5A5A5A5)) + size[run].astype(np.uint64))
        name, a, b, first = new, a[starts], b[ends], first[starts]
        dl, dr = np.minimum.reduceat(wide_l, starts), np.maximum.reduceat(wide_r, starts)
        keep = (pair | run) & (dr - dl <= window)
        out.append((name[keep], a[keep], b[keep], dl[keep], dr[keep]))
        if not (pair | run).any():
            break
    if not out:
        empty = np.empty(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _expanded(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every position of the ranges lo..hi (inclusive), and the range of each."""
    n = hi - lo + 1
    which = np.repeat(np.arange(len(lo)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), which


def anchored_records(h: np.ndarray, bounds: np.ndarray, window: int = WINDOW):
    """Records of neighbouring windows of one anchor: document, start (in the whole sequence), count, name, context hash.

    ``bounds`` are the documents' ends in the sequence, from 0.
    """
    starts, ends = bounds[:-1], bounds[1:]
    total = len(h)
    long = np.flatnonzero(ends - starts >= window)
    first = np.zeros(total + 1, dtype=bool)
    first[starts] = True
    for_windows = np.zeros(total + 1, dtype=np.int32)
    np.add.at(for_windows, starts[long], 1)
    np.add.at(for_windows, ends[long] - window + 1, -1)
    is_start = np.cumsum(for_windows[:total]) > 0
    name, a, b, dl, dr = symbols(h, first[:total], window=window)
    best = np.full(total, -1, dtype=np.int64)
    length = b - a
    order = np.lexsort((-a, ~name, length))  # within a length the least name, then the leftmost, comes last
    cuts = np.searchsorted(length[order], np.arange(window + 2))
    open_ = int(is_start.sum())
    for size in range(window, 1, -1):
        nodes = order[cuts[size] : cuts[size + 1]]
        if not open_ or not len(nodes):
            continue
        lo, hi = np.maximum(dr[nodes] - window, 0), dl[nodes]
        at, which = _expanded(lo, np.maximum(hi, lo - 1))
        free = is_start[at] & (best[at] < 0)
        at, which = at[free], which[free]
        best[at] = nodes[which]
        open_ = open_ - len(np.unique(at)) if len(at) else open_
    anchor_name = np.zeros(total, dtype=np.uint64)
    anchor_at = np.full(total, -1, dtype=np.int64)
    got = np.flatnonzero(best >= 0)
    anchor_name[got], anchor_at[got] = name[best[got]], a[best[got]]
    rest = np.flatnonzero(is_start & (best < 0))
    for i in range(0, len(rest), 1 << 16):  # no symbol fits: the least word is the anchor
        at = rest[i : i + (1 << 16)]
        least = np.argmin(h[at[:, None] + np.arange(window)], axis=1)
        anchor_at[at] = at + least
        anchor_name[at] = h[at + least]
    where = np.flatnonzero(is_start)
    if not len(where):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty
    begins = np.ones(len(where), dtype=bool)
    begins[1:] = (where[1:] != where[:-1] + 1) | (anchor_at[where[1:]] != anchor_at[where[:-1]]) | (anchor_name[where[1:]] != anchor_name[where[:-1]])
    head = np.flatnonzero(begins)
    count = np.diff(np.append(head, len(where)))
    start = where[head]
    begins_doc = np.searchsorted(bounds, start, side="right") - 1
    # neighbouring documents' windows are never one record: their starts are apart by the window at least, unless the window is one word
    ranges = RangeHash(h)
    context = ranges.of(start, start + count + window - 1, 0) ^ _mix((count * 64 + (anchor_at[start] - start)).astype(np.uint64))
    return begins_doc, start, count, anchor_name[start].view(np.int64), context.view(np.int64)


def _repeated(x: np.ndarray, y: np.ndarray, ids: pa.Array, t: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which places, of rows ``row`` of a batch, have the values (x, y) of an earlier place.

    The same row twice in a batch is one place, not a repeat of itself.
    """
    again = np.zeros(len(x), dtype=bool)
    if not len(x):
        return again
    null, key, t = np.asarray(ids.is_null())[row], np.asarray(ids.fill_null(0))[row], t[row]
    order = np.lexsort((start, t, key, ~null, y, x))
    later = np.zeros(len(x), dtype=bool)
    later[1:] = (x[order[1:]] == x[order[:-1]]) & (y[order[1:]] == y[order[:-1]])
    top = order[np.maximum.accumulate(np.where(later, 0, np.arange(len(x))))]
    one = (key[order] == key[top]) & (t[order] == t[top]) & (null[order] == null[top]) & (start[order] == start[top])
    again[order] = later & ~one
    return again


RECORDS = "name long, context long, doc_id long, t long, start int, n int, again boolean"


def _records(source: DataFrame, window: int) -> DataFrame:
    ship_package(source.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                yield of(part)

    def of(part: pa.RecordBatch):
        words = [words_of(t) for t in part.column("text").to_pylist()]
        bounds = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        flat: list[bytes] = [x for w in words for x in w]
        doc, start, n, name, context = anchored_records(word_hashes(flat), bounds, window)
        ids, t = part.column("doc_id"), np.asarray(part.column("t"))
        local = (start - bounds[doc]).astype(np.int32)
        again = _repeated(name, context, ids, t, doc, local)
        # settled repeats go along under names of their own, so that no task gets many
        shown = np.where(again, _mix(context.view(np.uint64) + (doc * 64 + local).astype(np.uint64)).view(np.int64), name)
        return pa.RecordBatch.from_arrays(
            [pa.array(shown), pa.array(context), ids.take(pa.array(doc)), pa.array(t[doc]), pa.array(local), pa.array(n.astype(np.int32)), pa.array(again)],
            names=["name", "context", "doc_id", "t", "start", "n", "again"],
        )

    return source.mapInArrow(run, RECORDS)


def _window_hashes(joined: DataFrame, window: int) -> DataFrame:
    """The windows of unsettled records, from the texts: h1, h2, doc_id, t, start, again.

    A window that a task has seen before goes along as settled, under hashes of its own.
    """
    ship_package(joined.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                h1, h2, doc, starts = [], [], [], []
                for k, (text, spans) in enumerate(zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True)):
                    at = np.unique(np.concatenate([np.arange(x["start"], x["start"] + x["n"]) for x in spans]))
                    ranges = RangeHash(word_hashes(words_of(text)))
                    h1.append(ranges.of(at, at + window, 0))
                    h2.append(ranges.of(at, at + window, 1))
                    doc.append(np.full(len(at), k))
                    starts.append(at)
                if doc:
                    take, start = np.concatenate(doc), np.concatenate(starts).astype(np.int32)
                    x, y = np.concatenate(h1), np.concatenate(h2)
                    again = _repeated(x, y, part.column("doc_id"), np.asarray(part.column("t")), take, start)
                    x = np.where(again, _mix(y + (take * 64 + start).astype(np.uint64)), x)
                    rows = pa.array(take)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), part.column("doc_id").take(rows), part.column("t").take(rows), pa.array(start), pa.array(again)], names=["h1", "h2", "doc_id", "t", "start", "again"])

    return joined.mapInArrow(run, "h1 long, h2 long, doc_id long, t long, start int, again boolean")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word that a window covers whose words also start earlier.

    Returns doc_id, n_words, n_removed and kept_text, the other words joined by one
    space. Earlier means a smaller doc_id, or the same document and an earlier
    start; all windows are judged on the input. A null text has no words; a text
    shorter than the window loses none. A null doc_id comes before all others;
    rows of one doc_id are ordered by a hash of their text, and equal rows are
    one document. An empty table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).cast("string").alias("text"))
    records = _records(source, window)
    by_name = Window.partitionBy("name")
    ranked = records.withColumn("r", F.dense_rank().over(Window.partitionBy("name", "context").orderBy("doc_id", "t", "start")))
    # contexts of a name: each has its rank 1 at one place
    counted = ranked.withColumn("lo", F.min("context").over(by_name)).withColumn("hi", F.max("context").over(by_name))
    settled = counted.withColumn("again", F.col("again") | (F.col("r") > 1)).filter(F.col("again") | (F.col("lo") != F.col("hi")))
    held = written(settled.select("doc_id", "t", "start", "n", "again"), "repeats")
    same = lambda x, y: F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.t") == F.col(f"{y}.t"))
    open_ = held.filter("not again").groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    texts = source.alias("d").join(open_.alias("o"), same("d", "o")).select("d.doc_id", "d.t", "d.text", "o.spans")
    # one pass: the texts' exchange serves this join and the last one
    windows = _window_hashes(texts, window).withColumn("r", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("doc_id", "t", "start")))
    later = windows.filter("again or r > 1").select("doc_id", "t", "start", F.lit(1).alias("n"))
    gone = held.filter("again").select("doc_id", "t", "start", "n").union(later).groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    final = source.alias("d").join(gone.alias("g"), same("d", "g"), "left").select("d.doc_id", "d.text", "g.spans")

    def finish(batches):
        for batch in batches:
            for part in slices(batch):
                total, removed, kept = [], [], []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    words = words_of(text)
                    n = len(words)
                    total.append(n)
                    if not spans:
                        removed.append(0)
                        kept.append(b" ".join(words))
                        continue
                    marks = np.zeros(n + 1, dtype=np.int32)
                    np.add.at(marks, [x["start"] for x in spans], 1)
                    np.add.at(marks, [x["start"] + x["n"] + window - 1 for x in spans], -1)
                    stay = np.flatnonzero(np.cumsum(marks[:n]) == 0)
                    removed.append(n - len(stay))
                    kept.append(b" ".join([words[i] for i in stay.tolist()]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return final.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_text string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of all documents; see :func:`dedup_substrings`."""
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM dw WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM dw)),
kept AS (SELECT a.doc_id, count(g.p) AS n_removed, string_agg(a.word, ' ' ORDER BY a.p) FILTER (WHERE g.p IS NULL) AS s
  FROM words a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.p = a.p GROUP BY a.doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM dw LEFT JOIN kept ON kept.doc_id = dw.doc_id
"""

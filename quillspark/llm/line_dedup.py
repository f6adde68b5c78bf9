"""Line deduplication by winnowing over line hashes, in DataFrame operations only.

Each window of ``window`` consecutive lines selects its least line hash (the rightmost of equal ones), so any
run of that many lines that two places share selects the same line in both. A line of
``alone`` characters is a window of its own, which reaches lines that repeat between other neighbours. Only the selected
positions go on as fingerprints, each with the windows that selected it.

Fingerprints are joined with all places of the same line; where there is no other, nothing repeats. The others are
extended both ways, to each window that selected them, and the first place of every window is found. Windows that
started earlier elsewhere are matches, matches that touch make whole runs, and the lines of later runs are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import join_groups, written
from quillspark.sources.tables import table

#: Lines in a window, that is the shortest run that is deleted.
WINDOW = 2
#: Characters, less outer white space, from which a line is a window of its own.
ALONE = 8
BLANKS = " \t\r\x0b\x0c"


def _fingerprint_at(hashes: Column, start: Column, window: int) -> Column:
    """Position of the rightmost least hash among ``window`` ones from ``start`` (from 0)."""
    best = start
    for k in range(1, window):
        here = start + F.lit(k)
        best = F.when(F.get(hashes, here) <= F.get(hashes, best), here).otherwise(best)
    return best


def fingerprints(docs: DataFrame, window: int, alone: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Selected positions: doc_id, t (hash of the text), at, h1, h2 (of the line), long, windows array of (start, w1, w2).

    ``windows`` are those that selected the position, less windows of long lines only, whose every line is a window of its own.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    split = F.split("text", "\n", -1)
    is_long = lambda x: F.lit(False) if alone is None else F.length(F.btrim(x, F.lit(BLANKS))) >= max(alone, 1)
    lines = keyed.select("doc_id", F.xxhash64("text").alias("t"), F.transform(split, lambda x: F.xxhash64(x)).alias("h1"), F.transform(split, lambda x: F.xxhash64(F.lit(1), x)).alias("h2"), F.transform(split, is_long).alias("long"))
    every = lambda c, s: [F.get(F.col(c), s + F.lit(k)) for k in range(window)]

    def one(s):
        short = ~F.least(*every("long", s)) if window > 1 else ~F.get(F.col("long"), s)
        return F.struct(_fingerprint_at(F.col("h1"), s, window).alias("at"), s.cast("int").alias("start"), F.xxhash64(*every("h1", s)).alias("w1"), F.xxhash64(*every("h2", s)).alias("w2"), short.alias("short"))

    starts = F.when(F.size("h1") >= window, F.sequence(F.lit(0), F.size("h1") - F.lit(window))).otherwise(F.array().cast("array<int>"))
    wide = lines.select("doc_id", "t", "h1", "h2", "long", F.transform(starts, one).alias("win"))

    def position(p):
        own = F.filter(F.slice(F.col("win"), F.greatest(p - F.lit(window - 2), F.lit(1)), F.lit(window)), lambda x: (x["at"] == p) & x["short"])
        return F.struct(p.cast("int").alias("at"), F.get(F.col("h1"), p).alias("h1"), F.get(F.col("h2"), p).alias("h2"), F.get(F.col("long"), p).alias("long"), F.transform(own, lambda x: F.struct(x["start"].alias("start"), x["w1"].alias("w1"), x["w2"].alias("w2"))).alias("windows"))

    every_line = F.transform(F.sequence(F.lit(0), F.size("h1") - F.lit(1)), position)
    selected = F.filter(every_line, lambda x: x["long"] | (F.size(x["windows"]) > 0))
    return wide.select("doc_id", "t", F.explode(selected).alias("s")).select("doc_id", "t", "s.*")


def repeated_lines(docs: DataFrame, window: int, id_col: str, text_col: str, alone: int | None) -> DataFrame:
    """Positions of the lines that a window covers which also starts earlier: doc_id, t, lines array<int> (from 0).

    Earlier means a smaller (doc_id, start); rows of one doc_id are ordered by a hash of
    their text, and equal rows count as one row.
    """
    rows = written(fingerprints(docs, window, alone, id_col, text_col), "fingerprints")
    total = rows.count()
    place = F.struct("doc_id", "t", "at")
    lines = rows.groupBy("h1", "h2").agg(F.min(F.when(F.col("long"), place)).alias("first"), F.count("*").alias("n")).filter("n > 1")
    matched = written(join_groups(rows, lines, ["h1", "h2"], total), "matches")
    single = matched.filter(F.col("long") & ~place.eqNullSafe(F.col("first"))).select("doc_id", "t", F.col("at").alias("start"), F.lit(1).alias("width"))
    windows = matched.select("doc_id", "t", F.explode("windows").alias("w")).select("doc_id", "t", "w.start", "w.w1", "w.w2")
    place = F.struct("doc_id", "t", "start")
    firsts = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = join_groups(windows, firsts, ["w1", "w2"], total).filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "t", "start", F.lit(window).alias("width"))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_list(F.struct("start", "width")), lambda x: F.sequence(x["start"], x["start"] + x["width"] - F.lit(1)))))
    return single.union(later).groupBy("doc_id", "t").agg(covered.alias("lines"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", alone: int | None = None) -> DataFrame:
    """Every row of ``docs`` with its text less the lines of later repeated runs.

    Adds n_lines, n_removed and the changed text under ``text_col``; other columns stay.
    Lines end at line feeds and are compared as they are. A null text has no lines and stays
    null; an empty text is one empty line. A line of at least ``alone`` characters (less outer white
    space; None for no line) is also deleted where it alone started earlier, be its neighbours others or none. Without
    that, texts of fewer lines than the window stay as they are. Equal rows are each other's copy only under different doc_ids: repeated rows of one doc_id and text
    keep the same lines. A null doc_id comes before all others. An empty table gives no rows.
    """
    found = repeated_lines(docs, window, id_col, text_col, alone).select(F.col("doc_id").alias("__qs_d"), F.col("t").alias("__qs_t"), F.col("lines").alias("__qs_s"))
    keyed = docs.withColumn("__qs_k", F.col(id_col).cast("long")).withColumn("__qs_x", F.xxhash64(F.col(text_col).cast("string")))
    joined = keyed.join(found, F.col("__qs_k").eqNullSafe(F.col("__qs_d")) & (F.col("__qs_x") == F.col("__qs_t")), "left").drop("__qs_d", "__qs_t", "__qs_k", "__qs_x")
    lines = F.split(F.col(text_col).cast("string"), "\n", -1)
    # the positions of repeated lines, and those that stay
    marked = joined.withColumn("__qs_g", F.array_sort("__qs_s"))
    both = F.array(F.struct(lines.alias("l"), F.array_except(F.sequence(F.lit(0), F.size(lines) - F.lit(1)), F.col("__qs_g")).alias("k")))
    # the one struct binds the lines, so they are split once and not at each position
    rest = F.transform(both, lambda x: F.array_join(F.transform(x["k"], lambda p: F.get(x["l"], p)), "\n"))
    out = marked.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")).withColumn("n_removed", F.when(F.col("__qs_g").isNull(), 0).otherwise(F.size("__qs_g")).cast("long"))
    return out.withColumn(text_col, F.when(F.col("__qs_g").isNotNull(), F.get(rest, F.lit(0))).otherwise(F.col(text_col))).drop("__qs_s", "__qs_g")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed from every document and a digest of the rest; see :func:`dedup_lines`."""
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), alone=ALONE)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, l[i] AS line, len(l) AS n
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
), windows AS (
  SELECT a.doc_id, a.pos, a.line AS x, b.line AS y FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, pos) AS r FROM windows
), single AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS r FROM lines
  WHERE length(trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) >= 8
), gone AS (
  SELECT doc_id, pos FROM ranked WHERE r > 1 UNION SELECT doc_id, pos + 1 FROM ranked WHERE r > 1 UNION SELECT doc_id, pos FROM single WHERE r > 1
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS txt
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.txt, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

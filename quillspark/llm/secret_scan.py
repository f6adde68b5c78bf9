"""Secret scans in DataFrame operations only.

Base spans come from three patterns. The method adds spans of high entropy: candidates are the maximal runs of each
character class (hexadecimal digits, letters and digits, base64 signs). A window slides over a run with the counts of its
characters, of which each step changes those of the leaving and the entering one, and so the sum of c*log2(c), from
which the Shannon entropy follows; each class has its own limit. An allow-list suppresses runs of known harmless shapes. As
a run of one class may lie in one of another, a secret beside other signs is judged by itself too.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.tables import table

#: kind: pattern, group whose length counts, least length. Runs are whole, so a least length inside a pattern drops what a check after it would.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Characters in an entropy window.
WINDOW = 20
#: Candidates of the method, from the narrowest class: characters of a run, of a window at least, and the least entropy of a window in bits a character.
CLASSES = {"hex": (r"[0-9A-Fa-f]{20,}", 3.05), "alphanumeric": (r"[A-Za-z0-9]{20,}", 3.75), "base64": (r"[A-Za-z0-9+/_=-]{20,}", 3.75)}
RUNS = {f"runs_{name}": made for name, made in CLASSES.items()}
#: Shapes that are not secrets: without both a letter and a digit, UUIDs, placeholders, alphabets, one character over and over.
ALLOWED = r"^[^0-9]+$|^[^A-Za-z]+$|^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$|(?i)example|placeholder|dummy|sample|changeme|xxxx|abcdefgh|01234567|(?i)lorem"
#: Characters of a candidate that one pass takes, besides the window before them.
CHUNK = 256
#: A window's counts are one string: its character at the place of a sign's code above ``LOW`` is the count above ``ZERO``.
LOW, PLACES, ZERO = 42, 80, 65


def _match_spans(text: Column, matches: Column, pattern: str, order: int) -> Column:
    """Spans (start, order, end) of the matches, in code points, from the lengths of what lies between."""
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,ord:int,end:int>>").alias("spans"))
    pairs = F.arrays_zip(matches.alias("m"), F.slice(between, F.lit(1), F.size(matches)).alias("b"))

    def step(acc, x):
        a = acc["at"] + F.length(x["b"])
        z = a + F.length(x["m"])
        return F.struct(z.alias("at"), F.concat(acc["spans"], F.array(F.struct(a.alias("start"), F.lit(order).alias("ord"), z.alias("end")))).alias("spans"))

    return F.when(F.size(matches) > 0, F.aggregate(pairs, start, step, lambda acc: acc["spans"])).otherwise(start["spans"])


def _dense_part(chunk: Column, least: float) -> Column:
    """First start and last end (from 0) of the windows of a chunk with at least so many bits; nulls if none."""
    f = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    start = F.struct(F.lit(0.0).alias("s"), F.lit(chr(ZERO) * PLACES).alias("counts"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))

    def step(acc, k):
        # steps in pairs: the character before the window leaves, then the next one enters
        i, enters = F.floor(k / 2).cast("int"), k % 2 == 1
        at = F.when(enters, i).otherwise(i - F.lit(WINDOW))
        place = F.ascii(F.substring(chunk, at + F.lit(1), F.lit(1))) - F.lit(LOW)
        n = F.ascii(F.substring(acc["counts"], place, F.lit(1))) - F.lit(ZERO)
        then = n + F.when(enters, 1).otherwise(-1)
        s = acc["s"] + F.get(f, then) - F.get(f, n)
        hit = enters & (i >= WINDOW - 1) & (F.lit(log2(WINDOW)) - s / F.lit(float(WINDOW)) >= least)
        moved = F.struct(
            s.alias("s"),
            F.overlay(acc["counts"], F.char(then + F.lit(ZERO)), place, F.lit(1)).alias("counts"),
            F.when(acc["lo"].isNull() & hit, i - F.lit(WINDOW - 1)).otherwise(acc["lo"]).alias("lo"),
            F.when(hit, i + F.lit(1)).otherwise(acc["hi"]).alias("hi"),
        )
        return F.when(at < 0, acc).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(0), F.length(chunk) * F.lit(2) - F.lit(1)), start, step, lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))


def _dense_span(candidate: Column, least: float) -> Column:
    """The same of a whole candidate, chunk by chunk, so that its length costs no more than in proportion."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(candidate) - F.lit(WINDOW), F.lit(0)), F.lit(CHUNK))

    def part(p):
        return F.transform(F.array(F.substring(candidate, p + F.lit(1), F.lit(CHUNK + WINDOW - 1))), lambda c: F.transform(F.array(_dense_part(c, least)), lambda d: F.struct((d["lo"] + p).alias("lo"), (d["hi"] + p).alias("hi"))))

    found = F.flatten(F.flatten(F.transform(starts, part).cast("array<array<array<struct<lo:int,hi:int>>>>")))
    return F.struct(F.array_min(F.transform(found, lambda d: d["lo"])).alias("lo"), F.array_max(F.transform(found, lambda d: d["hi"])).alias("hi"))


def _shown(spans: Column) -> Column:
    kinds = F.array(F.lit("assign"), F.lit("access"), F.lit("hex"), F.lit("entropy"))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat(F.get(kinds, x["ord"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every text: doc_id, base and added, arrays of (start, ord, end) in code points.

    ord is 0 assign, 1 access, 2 hex, 3 entropy. A null text is an empty one and
    has none. Rows are independent: repeated rows and null ids are kept, an empty
    table gives no rows, other columns are ignored. An added span that lies within
    a base one, or within an added one that is larger or of a wider class, is left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    matched = source.select(
        "doc_id",
        "text",
        F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(0)).alias("assign"),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)).alias("access"),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)).alias("hex"),
        *[F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias(name) for name, (pattern, _) in RUNS.items()],
    )
    harmless = lambda x: x["m"].rlike(ALLOWED)
    spans = matched.select(
        "doc_id",
        F.filter(F.arrays_zip(F.col("assign").alias("m"), _match_spans(F.col("text"), F.col("assign"), ASSIGN, 0).alias("s")), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_LEAST).alias("assign"),
        _match_spans(F.col("text"), F.col("access"), ACCESS, 1).alias("access"),
        _match_spans(F.col("text"), F.col("hex"), HEX, 2).alias("hex"),
        *[F.filter(F.arrays_zip(F.col(name).alias("m"), _match_spans(F.col("text"), F.col(name), pattern, 3).alias("s")), lambda x: ~harmless(x)).alias(name) for name, (pattern, _) in RUNS.items()],
    )
    based = spans.select("doc_id", *RUNS, F.concat(F.transform("assign", lambda x: x["s"]), "access", "hex").alias("base"))

    def dense(name, least, rank):
        # the one array binds the span, so it is found once
        found = F.flatten(F.transform(name, lambda x: F.transform(F.array(_dense_span(x["m"], least)), lambda d: F.struct((x["s"]["start"] + d["lo"]).alias("start"), F.lit(3).alias("ord"), (x["s"]["start"] + d["hi"]).alias("end"), F.lit(rank).alias("rank")))))
        return F.filter(found, lambda x: x["start"].isNotNull())

    every = based.select("doc_id", "base", F.concat(*[dense(name, least, rank) for rank, (name, (_, least)) in enumerate(RUNS.items())]).alias("dense"))
    within = lambda x, y: (y["start"] <= x["start"]) & (y["end"] >= x["end"])
    beyond = lambda x, y: within(x, y) & ((y["end"] - y["start"] > x["end"] - x["start"]) | (y["rank"] > x["rank"]))
    added = F.filter("dense", lambda x: ~F.exists("base", lambda y: within(x, y)) & ~F.exists("dense", lambda y: beyond(x, y)))
    return every.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.transform(added, lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end")))).alias("added"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; see :func:`scan_secrets`."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda x: x["ord"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), _shown(F.concat("base", "added")).alias("spans"))


def _sql_spans(pattern: str, kind: int, source: str, keep: str) -> str:
    return f"""
  SELECT doc_id, m, s AS start, {kind} AS ord, s + length(m) AS stop FROM (
    SELECT doc_id, ms[i] AS m, CAST(list_sum(list_transform(bs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT doc_id, ms, regexp_split_to_array(text, '{pattern}') AS bs, unnest(range(1, len(ms) + 1)) AS i
          FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS ms FROM {source}) WHERE len(ms) > 0)
  ) WHERE {keep}"""


_Q = {k: v.replace("'", "''") for k, v in {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "allowed": ALLOWED}.items()}
_HARMFUL = f"NOT regexp_matches(m, '{_Q['allowed']}')"
_CANDIDATES = " UNION ALL ".join(f"SELECT *, {rank} AS rank, {least} AS least FROM ({_sql_spans(pattern, 3, 'docs', _HARMFUL)})" for rank, (pattern, least) in enumerate(CLASSES.values()))
OP4_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_sql_spans(_Q["assign"], 0, "docs", f"length(regexp_extract(m, '{_Q['assign']}', 2)) >= {ASSIGN_LEAST}")}
  UNION ALL {_sql_spans(_Q["access"], 1, "docs", "true")}
  UNION ALL {_sql_spans(_Q["hex"], 2, "docs", "true")}
), candidates AS ({_CANDIDATES}
), dense AS (
  SELECT doc_id, rank, start + lo AS start, start + hi AS stop FROM (
    SELECT doc_id, rank, start, min(i) FILTER (WHERE e) AS lo, max(i + {WINDOW}) FILTER (WHERE e) AS hi FROM (
      SELECT doc_id, rank, start, i, list_entropy(string_split(substr(m, i + 1, {WINDOW}), '')) >= least AS e
      FROM (SELECT doc_id, rank, least, start, m, CAST(unnest(range(0, length(m) - {WINDOW - 1})) AS BIGINT) AS i FROM candidates)
    ) GROUP BY doc_id, rank, start
  ) WHERE lo IS NOT NULL
), every AS (
  SELECT doc_id, start, ord, stop FROM base
  UNION ALL
  SELECT doc_id, start, 3, stop FROM dense d WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = d.doc_id AND b.start <= d.start AND b.stop >= d.stop)
    AND NOT EXISTS (SELECT 1 FROM dense o WHERE o.doc_id = d.doc_id AND o.start <= d.start AND o.stop >= d.stop AND (o.stop - o.start > d.stop - d.start OR o.rank > d.rank))
), shown AS (
  SELECT doc_id, start, ord, stop, (['assign', 'access', 'hex', 'entropy'])[ord + 1] || ':' || start || ':' || stop AS s FROM every
), summed AS (
  SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
         string_agg(s, ',' ORDER BY start, ord, stop) FILTER (WHERE ord < 3) AS b, string_agg(s, ',' ORDER BY start, ord, stop) AS a FROM shown GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM docs d LEFT JOIN summed s ON d.doc_id = s.doc_id
"""

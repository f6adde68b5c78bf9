"""Retrieval queries over documents (the corpus), benchmark (the questions) and embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import hashed_vectors
from quillspark.operators import bm25, chunking, dense, diagnostics, evaluate, fusion, hybrid, sweep
from quillspark.sources.tables import table

K, CANDIDATES, TOP = 5, 100, 10
BASELINE = 0.75
GRID = (0.0, 0.25, 0.5, 0.75, 1.0)


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_list(spark: SparkSession, d: str, k: int) -> DataFrame:
    return bm25.search(corpus(spark, d), questions(spark, d), k)


def hashed(df: DataFrame, key: str) -> DataFrame:
    return hashed_vectors(df, key)


def candidate_lists(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.candidates(corpus(spark, d), questions(spark, d), CANDIDATES)


def gold(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.exact_evidence(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select("query_id", F.col("doc_id").alias("chunk_id"))


# --- index -------------------------------------------------------------------


def bm25_index_terms(spark, d):
    return bm25.statistics(bm25.tokenised(corpus(spark, d)))[1].select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_index_stats(spark, d):
    return bm25.statistics(bm25.tokenised(corpus(spark, d)))[0].select("n_docs", F.round("avgdl", 6).alias("avgdl"), F.round("avg_idf", 6).alias("avg_idf"))


def bm25_doc_lengths(spark, d):
    return bm25.doc_lengths(bm25.tokenised(corpus(spark, d))).select("chunk_id", F.col("length").cast("long").alias("length"))


def bm25_postings(spark, d):
    return bm25.postings(bm25.tokenised(corpus(spark, d)))


def bm25_topk(spark, d):
    return bm25_list(spark, d, TOP)


def bm25_score_all(spark, d):
    return bm25.score_all(corpus(spark, d), questions(spark, d))


def bm25_explain(spark, d):
    chunks, asked = corpus(spark, d), questions(spark, d)
    known = bm25.known_of(chunks, bm25.asked_terms(asked))
    found = bm25.search(chunks, asked, 1, known=known).select("query_id", "chunk_id").persist()
    return bm25.explain(chunks, asked, found, known)


def b_grid(spark):
    return spark.createDataFrame([(b,) for b in GRID], "b double")


def by_b(spark, d):
    """Metrics of every question at each b of the grid, from one pass of scoring."""
    best = bm25.search(corpus(spark, d), questions(spark, d), CANDIDATES, b=GRID)
    return evaluate.per_query(best, gold(spark, d), CANDIDATES, b_grid(spark))


def bm25_b_sweep(spark, d):
    return evaluate.means(by_b(spark, d), ["b"])


def bm25_b_paired(spark, d):
    each = by_b(spark, d).persist()
    joined = each.alias("o").join(each.filter(f"b = {BASELINE}D").alias("p"), "query_id").select(F.col("o.b").alias("b"), (F.col("o.rr") - F.col("p.rr")).alias("x"))
    return joined.groupBy("b").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("diff"), F.round(F.stddev_samp("x") / F.sqrt(F.count("*")), 6).alias("se"))


# --- chunks, gold -------------------------------------------------------------


def chunk_document(spark, d):
    return chunking.chunk(table(spark, d, "documents"), chunking.Config("document"))


def chunk_fixed_words(spark, d):
    return chunking.chunk(table(spark, d, "documents"), chunking.Config("fixed_words", 128, 32))


def chunk_sentence_window(spark, d):
    return chunking.chunk(table(spark, d, "documents"), chunking.Config("sentence_window", 2, 0))


def length_distribution(spark, d):
    n = bm25.doc_lengths(bm25.tokenised(corpus(spark, d)))
    avg = F.avg("length")
    return n.agg(F.count("*").alias("n"), F.round(avg, 6).alias("avgdl"), F.round(F.percentile("length", F.lit(0.1)) / avg, 6).alias("p10"), F.round(F.percentile("length", F.lit(0.9)) / avg, 6).alias("p90"), F.round(F.stddev_pop("length") / avg, 6).alias("cv"), F.max("length").cast("long").alias("longest"))


def top5_length_ratio(spark, d):
    chunks, asked = corpus(spark, d), questions(spark, d)
    known = bm25.known_of(chunks, bm25.asked_terms(asked))
    best = chunks.join(F.broadcast(bm25.search(chunks, asked, K, known=known).select("chunk_id")), "chunk_id")
    return bm25.doc_lengths(bm25.tokenised(best)).agg(F.round(F.avg(F.col("length") / F.lit(known.avgdl)), 6).alias("ratio"))


def gold_evidence(spark, d):
    return evaluate.exact_evidence(table(spark, d, "documents"), table(spark, d, "benchmark")).select("query_id", "doc_id", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


def gold_overlap(spark, d):
    docs = table(spark, d, "documents")
    chunks = chunking.chunk(docs, chunking.Config("fixed_words", 128, 32))
    return evaluate.gold_chunks(evaluate.exact_evidence(docs, table(spark, d, "benchmark")), chunks)


def gold_counts(spark, d):
    each = gold_overlap(spark, d).groupBy("query_id").agg(F.count("*").alias("n_gold"))
    return each.groupBy("n_gold").agg(F.count("*").alias("questions"))


# --- dense, fusion ------------------------------------------------------------


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def dense_topk(spark, d):
    v = vectors(spark, d)
    return dense.search(v, v.filter(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")), TOP)


def norm_check(spark, d):
    v = table(spark, d, "embeddings")
    return v.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.abs(dense.norm(F.col("embedding")) - 1) >= 1e-3, F.lit(True))).alias("bad"))


def similarity_matrix(spark, d):
    q = hashed(questions(spark, d), "query_id").select(F.col("query_id").alias("id"), "vector")
    return dense.similarity_matrix(q, q)


def gold_similarity(spark, d):
    v = vectors(spark, d)
    return dense.mean_similarity(v, v.filter(F.col("chunk_id") % 50 == 0))


def hashing_embedder(spark, d):
    v = hashed(questions(spark, d), "query_id")
    return v.select("query_id", F.posexplode("vector").alias("axis", "x")).filter("x <> 0").select("query_id", F.col("axis").cast("long").alias("axis"), F.round("x", 9).alias("x"))


def rrf_fusion(spark, d):
    scored = candidate_lists(spark, d).withColumn("fused", fusion.rrf_score())
    return fusion.ranked(scored, ["query_id"], K).select("query_id", "chunk_id", "rank", "fused", "dense_rank", "bm25_rank")


def hybrid_search(spark, d):
    scored = candidate_lists(spark, d).withColumn("fused", fusion.rrf_score())
    return fusion.ranked(scored, ["query_id"], TOP).select("query_id", "chunk_id", "rank", "fused")


def weighted_rrf(spark, d):
    scored = candidate_lists(spark, d).withColumn("fused", fusion.rrf_score(F.lit(0.7)))
    return fusion.ranked(scored, ["query_id"], K).select("query_id", "chunk_id", "rank", "fused")


def linear_fusion(spark, d):
    scored = fusion.with_scaled(candidate_lists(spark, d)).withColumn("fused", fusion.linear_score(F.lit(0.7)))
    return fusion.ranked(scored, ["query_id"], K).select("query_id", "chunk_id", "rank", "fused")


def minmax_scores(spark, d):
    return fusion.with_scaled(candidate_lists(spark, d)).select("query_id", "chunk_id", F.round("dense_scaled", 6).alias("dense_scaled"), F.round("bm25_scaled", 6).alias("bm25_scaled"))


# --- evaluation ---------------------------------------------------------------


RUNS = ("dense", "bm25", "hybrid")


def all_runs(spark, d, runs=RUNS):
    """Metrics of every question in each run, from one retrieval of the candidates."""
    both = fusion.ranked(candidate_lists(spark, d).withColumn("fused", fusion.rrf_score()), ["query_id"])
    places = {"dense": "dense_rank", "bm25": "bm25_rank", "hybrid": "rank"}
    listed = both.select("query_id", "chunk_id", F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.col(places[r]).alias("rank")) for r in runs])).alias("p")).select("query_id", "chunk_id", "p.run", "p.rank").filter(F.col("rank") <= K)
    return evaluate.per_query(listed, gold(spark, d), K, spark.createDataFrame([(r,) for r in runs], "run string"))


def per_query_scores(spark, d):
    return evaluate.per_query(bm25_list(spark, d, K).select("query_id", "chunk_id", "rank"), gold(spark, d), K)


def retrieval_metrics(spark, d):
    return evaluate.means(per_query_scores(spark, d))


def paired_difference(spark, d):
    each = all_runs(spark, d, ("dense", "hybrid")).groupBy("query_id").agg(F.max(F.when(F.col("run") == "dense", F.col("rr"))).alias("b"), F.max(F.when(F.col("run") == "hybrid", F.col("rr"))).alias("o"))
    return evaluate.difference(each)


def eval_runs(spark, d):
    return evaluate.means(all_runs(spark, d), ["run"])


def eval_pairs(spark, d):
    """Each other run against dense search, by every metric."""
    return evaluate.against_first(all_runs(spark, d), "dense")


def answer_signs(spark, d):
    """The first passage that BM25 finds, taken as an answer, beside the first two words of its question and its gold chunks."""
    best = corpus(spark, d).withColumnRenamed("text", "answer").join(F.broadcast(bm25_list(spark, d, 1).select("query_id", "chunk_id")), "chunk_id")
    asked = questions(spark, d).select("query_id", F.substring_index("text", " ", 2).alias("reference"))
    known = gold(spark, d).groupBy("query_id").agg(F.collect_list("chunk_id").alias("gold"))
    shown = diagnostics.signs(asked.join(best, "query_id", "left").join(known, "query_id", "left").withColumn("cited", F.array_compact(F.array("chunk_id"))))
    return shown.groupBy("reference_in_answer", "cites_gold").agg(F.count("*").alias("n"))


def swept(spark, d, method):
    return sweep.swept(candidate_lists(spark, d), gold(spark, d), K, (method,)).drop("method")


def fusion_sweep_curve(spark, d):
    return evaluate.means(sweep.swept(candidate_lists(spark, d), gold(spark, d), K), ["method", "alpha"])


def crossfit_choice(spark, d):
    chosen, _ = sweep.crossfit(swept(spark, d, "rrf"))
    return chosen.select(F.col("fold").cast("long").alias("fold"), "alpha", F.round("mean", 6).alias("mean"))


def crossfit_heldout(spark, d):
    _, held = sweep.crossfit(swept(spark, d, "rrf"))
    return held.select("query_id", F.col("fold").cast("long").alias("fold"), "alpha", "recall", "complete", "rr")


def repeated_crossfit(spark, d):
    return sweep.repeated_crossfit(swept(spark, d, "linear"), repeats=200)


def crossfit_spread(spark, d):
    """Median, 5th and 95th percentile of the repeated differences, and the share above zero."""
    r = sweep.repeated_crossfit(swept(spark, d, "linear"), repeats=200)
    return r.agg(F.count("*").alias("repeats"), F.percentile("delta", F.lit(0.5)).alias("median"), F.percentile("delta", F.lit(0.05)).alias("low"), F.percentile("delta", F.lit(0.95)).alias("high"), F.avg((F.col("delta") > 0).cast("double")).alias("better"))


def crossfit_alpha_histogram(spark, d):
    r = sweep.repeated_crossfit(swept(spark, d, "linear"), repeats=200)
    return r.select(F.explode(F.array("alpha_a", "alpha_b")).alias("alpha")).groupBy("alpha").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_index_terms, bm25_index_stats, bm25_doc_lengths, bm25_postings, bm25_score_all, bm25_explain, bm25_b_sweep, bm25_b_paired,
    chunk_document, chunk_fixed_words, chunk_sentence_window, length_distribution, top5_length_ratio, gold_evidence, gold_overlap, gold_counts,
    dense_topk, norm_check, similarity_matrix, gold_similarity, hashing_embedder, rrf_fusion, hybrid_search, weighted_rrf, linear_fusion, minmax_scores,
    per_query_scores, retrieval_metrics, paired_difference, eval_runs, eval_pairs, answer_signs, fusion_sweep_curve, crossfit_choice, crossfit_heldout, repeated_crossfit, crossfit_spread, crossfit_alpha_histogram,
)}

# --- the same in SQL ----------------------------------------------------------

_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_INDEX = rf"""
toks AS MATERIALIZED (SELECT doc_id AS chunk_id, {_TOK} AS tokens FROM documents),
lens AS (SELECT chunk_id, CAST(len(tokens) AS BIGINT) AS length FROM toks),
post AS MATERIALIZED (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM toks) GROUP BY term, chunk_id),
stats0 AS (SELECT count(*) AS n_docs, avg(length) AS avgdl FROM lens),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln((n_docs - df + 0.5e0) / (df + 0.5e0)) AS idf FROM dfs, stats0),
stats AS (SELECT n_docs, avgdl, coalesce((SELECT avg(idf) FROM raw), 0) AS avg_idf FROM stats0),
terms AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25e0 * avg_idf ELSE idf END AS idf FROM raw, stats),
qtok AS (SELECT item_id AS query_id, {_TOK} AS tokens FROM benchmark),
qterms AS (SELECT query_id, tokens[i] AS term, CAST(i - 1 AS INTEGER) AS pos FROM (SELECT query_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM qtok)),
grid AS (SELECT unnest([0.0e0, 0.25e0, 0.5e0, 0.75e0, 1.0e0]) AS b),
gscores AS (SELECT b, query_id, p.chunk_id, round(sum(idf * tf * 2.5e0 / (tf + 1.5e0 * (1.0e0 - b + b * length / avgdl))), 6) AS score
  FROM qterms JOIN terms USING (term) JOIN post p USING (term) JOIN lens ON lens.chunk_id = p.chunk_id, stats, grid GROUP BY b, query_id, p.chunk_id),
scores AS (SELECT query_id, chunk_id, score FROM gscores WHERE b = 0.75e0),
bm AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scores) WHERE score > 0)
"""
_EMBED = rf"""
buckets AS (SELECT 'c' AS kind, doc_id AS id, {_TOK} AS tokens FROM documents UNION ALL SELECT 'q', item_id, {_TOK} FROM benchmark),
axes AS (SELECT kind, id, axis, count(*) AS n FROM (SELECT kind, id, CAST('0x' || right(md5(t), 2) AS INTEGER) % 64 AS axis FROM (SELECT kind, id, unnest(tokens) AS t FROM buckets)) GROUP BY kind, id, axis),
unit AS (SELECT kind, id, axis, n / sqrt(sum(n * n) OVER (PARTITION BY kind, id)) AS x FROM axes
  UNION ALL SELECT kind, id, 0, 1.0 FROM buckets WHERE len(tokens) = 0),
dscores AS (SELECT q.id AS query_id, c.id AS chunk_id, round(sum(q.x * c.x), 6) AS s FROM unit q JOIN unit c ON q.kind = 'q' AND c.kind = 'c' AND q.axis = c.axis GROUP BY q.id, c.id),
dall AS (SELECT q.id AS query_id, c.id AS chunk_id, coalesce(s, 0.0) AS score FROM (SELECT DISTINCT id FROM buckets WHERE kind = 'q') q CROSS JOIN (SELECT DISTINCT id FROM buckets WHERE kind = 'c') c
  LEFT JOIN dscores ON dscores.query_id = q.id AND dscores.chunk_id = c.id),
dn AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM dall)
"""
_GOLD = "ev AS (SELECT item_id AS query_id, doc_id, CAST(instr(d.text, b.text) - 1 AS BIGINT) AS char_start, CAST(instr(d.text, b.text) - 1 + length(b.text) AS BIGINT) AS char_end FROM documents d JOIN benchmark b ON contains(d.text, b.text)),\ngold AS (SELECT query_id, doc_id AS chunk_id FROM ev)"
_CAND = """
cand AS (SELECT coalesce(d.query_id, m.query_id) AS query_id, coalesce(d.chunk_id, m.chunk_id) AS chunk_id, d.score AS dense_score, d.rank AS dense_rank, m.score AS bm25_score, m.rank AS bm25_rank
  FROM (SELECT * FROM dn WHERE rank <= 100) d FULL JOIN (SELECT * FROM bm WHERE rank <= 100) m ON d.query_id = m.query_id AND d.chunk_id = m.chunk_id),
scaled AS (SELECT *, coalesce(CASE WHEN dense_score IS NOT NULL THEN CASE WHEN max(dense_score) OVER w = min(dense_score) OVER w THEN 1.0 ELSE (dense_score - min(dense_score) OVER w) / (max(dense_score) OVER w - min(dense_score) OVER w) END END, 0.0) AS dense_scaled,
  coalesce(CASE WHEN bm25_score IS NOT NULL THEN CASE WHEN max(bm25_score) OVER w = min(bm25_score) OVER w THEN 1.0 ELSE (bm25_score - min(bm25_score) OVER w) / (max(bm25_score) OVER w - min(bm25_score) OVER w) END END, 0.0) AS bm25_scaled
  FROM cand WINDOW w AS (PARTITION BY query_id)),
alphas AS (SELECT i / 10.0e0 AS alpha FROM (SELECT unnest(range(0, 11)) AS i)),
parts AS (SELECT *, coalesce(1.0e0 / (60 + dense_rank), 0) AS dp, coalesce(1.0e0 / (60 + bm25_rank), 0) AS bp FROM scaled),
fused AS (SELECT 'rrf' AS method, alpha, query_id, chunk_id, dense_rank, bm25_rank, round(alpha * dp + (1.0e0 - alpha) * bp, 9) AS fused FROM parts, alphas
  UNION ALL SELECT 'linear', alpha, query_id, chunk_id, dense_rank, bm25_rank, round(alpha * dense_scaled + (1.0e0 - alpha) * bm25_scaled, 9) FROM parts, alphas
  UNION ALL SELECT 'plain', 0.5e0, query_id, chunk_id, dense_rank, bm25_rank, round(dp + bp, 9) FROM parts),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY method, alpha, query_id ORDER BY fused DESC, coalesce(dense_rank, 1073741824), coalesce(bm25_rank, 1073741824)) AS INTEGER) AS rank FROM fused)
"""


def _metrics(rankings: str, k: int, by: str = "") -> str:
    """CTEs hits and each: metrics of each question by the keys ``by`` of ``rankings``."""
    keys = f"{by}, " if by else ""
    every = f"(SELECT DISTINCT {by} FROM {rankings}) k CROSS JOIN tot t" if by else "tot t"
    on = "".join(f" AND h.{c.strip()} = k.{c.strip()}" for c in by.split(",") if c)
    shown = "".join(f"k.{c.strip()}, " for c in by.split(",") if c)
    return f"""
tot AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id),
hits AS (SELECT {keys}r.query_id, count(*) AS n, min(rank) AS first FROM {rankings} r JOIN gold g ON r.query_id = g.query_id AND r.chunk_id = g.chunk_id WHERE rank <= {k} GROUP BY {keys}r.query_id),
each AS (SELECT {shown}t.query_id, round(coalesce(n, 0) / n_gold, 9) AS recall, CAST(coalesce(n, 0) = n_gold AS DOUBLE) AS complete, round(coalesce(1.0e0 / first, 0.0), 9) AS rr
  FROM {every} LEFT JOIN hits h ON h.query_id = t.query_id{on})"""


_MEANS = "count(*) AS n, round(avg(recall), 6) AS recall, round(avg(complete), 6) AS complete, round(avg(rr), 6) AS rr"
_FOLDS = "folds AS (SELECT query_id, (row_number() OVER (ORDER BY query_id) - 1) % 2 AS fold FROM tot)"
_CHOSEN = """
meanby AS (SELECT fold, alpha, round(avg(rr), 9) AS mean FROM each JOIN folds USING (query_id) WHERE method = 'rrf' GROUP BY fold, alpha),
chosen AS (SELECT fold, alpha, mean FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY mean DESC, abs(alpha - 0.5e0), alpha DESC) AS r FROM meanby) WHERE r = 1)"""
_CHUNKS = r"""
pieces AS (SELECT doc_id, text, regexp_extract_all(text, '\s*\S+') AS p FROM documents),
ends AS (SELECT doc_id, text, i, p[i] AS piece, sum(length(p[i])) OVER (PARTITION BY doc_id ORDER BY i) AS e, len(p) AS n FROM (SELECT doc_id, text, p, unnest(range(1, len(p) + 1)) AS i FROM pieces)),
words AS (SELECT doc_id, i - 1 AS w, e - length(ltrim(piece, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS s, e, n FROM ends),
nums AS (SELECT doc_id, n, unnest(range(0, CAST(1 + greatest(0, ceil((n - 128) / 96.0)) AS BIGINT))) AS position FROM (SELECT DISTINCT doc_id, n FROM words)),
chunks AS (SELECT m.doc_id, CAST(m.position AS INTEGER) AS position, CAST(a.s AS INTEGER) AS char_start, CAST(z.e AS INTEGER) AS char_end FROM nums m JOIN words a ON a.doc_id = m.doc_id AND a.w = m.position * 96
  JOIN words z ON z.doc_id = m.doc_id AND z.w = least(m.position * 96 + 128, m.n) - 1),
overlap AS (SELECT DISTINCT ev.query_id, c.doc_id, c.position FROM chunks c JOIN ev ON ev.doc_id = c.doc_id AND c.char_start < ev.char_end AND ev.char_start < c.char_end)"""
_BRUN = "runs AS (SELECT 'bm25' AS run, query_id, chunk_id, rank FROM bm UNION ALL SELECT 'dense', query_id, chunk_id, rank FROM dn UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM ranked WHERE method = 'plain')"
_ALL = f"WITH {_INDEX}, {_EMBED}, {_CAND}, {_GOLD}"
_SWEPT = f"{_ALL}, curves AS (SELECT * FROM ranked WHERE method <> 'plain'), {_metrics('curves', K, 'method, alpha')}"
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "bm25_topk": f"WITH {_INDEX} SELECT * FROM bm WHERE rank <= {TOP}",
    "bm25_index_terms": f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_index_stats": f"WITH {_INDEX} SELECT n_docs, round(avgdl, 6) AS avgdl, round(avg_idf, 6) AS avg_idf FROM stats",
    "bm25_doc_lengths": f"WITH {_INDEX} SELECT * FROM lens",
    "bm25_postings": f"WITH {_INDEX} SELECT * FROM post",
    "bm25_score_all": f"WITH {_INDEX} SELECT * FROM scores",
    "bm25_explain": f"""WITH {_INDEX} SELECT t.query_id, b.chunk_id, t.pos, t.term, coalesce(p.tf, 0) AS tf, coalesce(m.df, 0) AS df, round(coalesce(m.idf, 0.0), 6) AS idf,
  round(coalesce(m.idf, 0.0) * coalesce(p.tf, 0) * 2.5e0 / (coalesce(p.tf, 0) + 1.5e0 * (0.25e0 + 0.75e0 * length / avgdl)), 6) AS share
  FROM bm b JOIN qterms t ON t.query_id = b.query_id LEFT JOIN terms m ON m.term = t.term LEFT JOIN post p ON p.term = t.term AND p.chunk_id = b.chunk_id JOIN lens ON lens.chunk_id = b.chunk_id, stats WHERE b.rank = 1""",
    "bm25_b_sweep": f"WITH {_INDEX}, {_GOLD}, byb AS (SELECT b, query_id, chunk_id, row_number() OVER (PARTITION BY b, query_id ORDER BY score DESC, chunk_id) AS rank FROM gscores), {_metrics('byb', CANDIDATES, 'b')} SELECT b, {_MEANS} FROM each GROUP BY b",
    "bm25_b_paired": f"WITH {_INDEX}, {_GOLD}, byb AS (SELECT b, query_id, chunk_id, row_number() OVER (PARTITION BY b, query_id ORDER BY score DESC, chunk_id) AS rank FROM gscores), {_metrics('byb', CANDIDATES, 'b')} SELECT o.b, count(*) AS n, round(avg(o.rr - p.rr), 6) AS diff, round(stddev_samp(o.rr - p.rr) / sqrt(count(*)), 6) AS se FROM each o JOIN each p ON p.query_id = o.query_id AND p.b = 0.75e0 GROUP BY o.b",
    "chunk_document": f"""SELECT doc_id, CAST(0 AS INTEGER) AS position, CAST(a AS INTEGER) AS char_start, CAST(z AS INTEGER) AS char_end, substr(text, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT)) AS text FROM (
  SELECT doc_id, text, length(text) - length(ltrim(text, {_WHITE})) AS a, length(rtrim(text, {_WHITE})) AS z FROM documents) WHERE a < z""",
    "chunk_fixed_words": f"WITH {_GOLD}, {_CHUNKS} SELECT c.doc_id, c.position, c.char_start, c.char_end, substr(d.text, c.char_start + 1, c.char_end - c.char_start) AS text FROM chunks c JOIN documents d ON d.doc_id = c.doc_id",
    "length_distribution": f"WITH {_INDEX} SELECT count(*) AS n, round(avg(length), 6) AS avgdl, round(quantile_cont(length, 0.1) / avg(length), 6) AS p10, round(quantile_cont(length, 0.9) / avg(length), 6) AS p90, round(stddev_pop(length) / avg(length), 6) AS cv, max(length) AS longest FROM lens",
    "top5_length_ratio": f"WITH {_INDEX} SELECT round(avg(length / avgdl), 6) AS ratio FROM bm JOIN lens ON lens.chunk_id = bm.chunk_id, stats WHERE rank <= {K}",
    "gold_evidence": f"WITH {_GOLD} SELECT * FROM ev",
    "gold_overlap": f"WITH {_GOLD}, {_CHUNKS} SELECT * FROM overlap",
    "gold_counts": f"WITH {_GOLD}, {_CHUNKS} SELECT n_gold, count(*) AS questions FROM (SELECT query_id, count(*) AS n_gold FROM overlap GROUP BY query_id) GROUP BY n_gold",
    "dense_topk": f"""SELECT * FROM (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0)) WHERE rank <= {TOP}""",
    "norm_check": "SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) >= 1e-3, true)) AS bad FROM embeddings",
    "similarity_matrix": f"WITH {_EMBED} SELECT l.id AS left_id, r.id AS right_id, round(coalesce(sum(a.x * b.x), 0.0), 6) AS score FROM (SELECT id FROM buckets WHERE kind = 'q') l CROSS JOIN (SELECT id FROM buckets WHERE kind = 'q') r LEFT JOIN unit a ON a.kind = 'q' AND a.id = l.id LEFT JOIN unit b ON b.kind = 'q' AND b.id = r.id AND b.axis = a.axis GROUP BY l.id, r.id",
    "gold_similarity": "SELECT q.vec_id AS q, round(avg(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) FILTER (WHERE c.label = q.label), 6) AS gold, round(avg(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) FILTER (WHERE c.label <> q.label), 6) AS others FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id",
    "hashing_embedder": f"WITH {_EMBED} SELECT id AS query_id, CAST(axis AS BIGINT) AS axis, round(x, 9) AS x FROM unit WHERE kind = 'q'",
    "rrf_fusion": f"{_ALL} SELECT query_id, chunk_id, rank, fused, dense_rank, bm25_rank FROM ranked WHERE method = 'plain' AND rank <= {K}",
    "hybrid_search": f"{_ALL} SELECT query_id, chunk_id, rank, fused FROM ranked WHERE method = 'plain' AND rank <= {TOP}",
    "weighted_rrf": f"{_ALL} SELECT query_id, chunk_id, rank, fused FROM ranked WHERE method = 'rrf' AND alpha = 0.7e0 AND rank <= {K}",
    "linear_fusion": f"{_ALL} SELECT query_id, chunk_id, rank, fused FROM ranked WHERE method = 'linear' AND alpha = 0.7e0 AND rank <= {K}",
    "minmax_scores": f"{_ALL} SELECT query_id, chunk_id, round(dense_scaled, 6) AS dense_scaled, round(bm25_scaled, 6) AS bm25_scaled FROM scaled",
    "per_query_scores": f"WITH {_INDEX}, {_GOLD}, {_metrics('bm', K)} SELECT * FROM each",
    "retrieval_metrics": f"WITH {_INDEX}, {_GOLD}, {_metrics('bm', K)} SELECT {_MEANS} FROM each",
    "paired_difference": f"""{_ALL}, {_BRUN}, {_metrics('runs', K, 'run')} SELECT n, round(diff, 6) AS diff, round(se, 6) AS se, CASE WHEN se <> 0 THEN round(diff / se, 4) END AS z FROM (
  SELECT count(*) AS n, avg(o.rr - b.rr) AS diff, stddev_samp(o.rr - b.rr) / sqrt(count(*)) AS se FROM each b JOIN each o ON o.query_id = b.query_id AND o.run = 'hybrid' WHERE b.run = 'dense')""",
    "eval_runs": f"{_ALL}, {_BRUN}, {_metrics('runs', K, 'run')} SELECT run, {_MEANS} FROM each GROUP BY run",
    "eval_pairs": f"""{_ALL}, {_BRUN}, {_metrics('runs', K, 'run')}, long AS (SELECT run, query_id, 'recall' AS metric, recall AS x FROM each UNION ALL SELECT run, query_id, 'complete', complete FROM each UNION ALL SELECT run, query_id, 'rr', rr FROM each)
SELECT run, metric, n, round(diff, 6) AS diff, round(se, 6) AS se, CASE WHEN se <> 0 THEN round(diff / se, 4) END AS z FROM (
  SELECT o.run, o.metric, count(*) AS n, avg(o.x - b.x) AS diff, stddev_samp(o.x - b.x) / sqrt(count(*)) AS se FROM long o JOIN long b ON b.run = 'dense' AND o.run <> 'dense' AND b.query_id = o.query_id AND b.metric = o.metric GROUP BY o.run, o.metric)""",
    "fusion_sweep_curve": f"{_SWEPT} SELECT method, alpha, {_MEANS} FROM each GROUP BY method, alpha",
    "crossfit_choice": f"{_SWEPT}, {_FOLDS}, {_CHOSEN} SELECT fold, alpha, round(mean, 6) AS mean FROM chosen",
    "crossfit_heldout": f"{_SWEPT}, {_FOLDS}, {_CHOSEN} SELECT query_id, folds.fold, each.alpha, recall, complete, rr FROM each JOIN folds USING (query_id) JOIN chosen c ON c.fold = 1 - folds.fold AND c.alpha = each.alpha WHERE method = 'rrf'",
}

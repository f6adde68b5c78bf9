"""Scoring where chunks are read: the same results as from pairs, and no more rows than the best of each task."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import bm25, evaluate
from quillspark.operators.ranking import Best

WORDS = ["the", "cat", "dog", "bird", "fish", "ox", "eel", "ant", *(f"w{i}" for i in range(40))]


@pytest.fixture(scope="module")
def chunks(spark):
    draw = np.random.default_rng(5)
    rows = [(i, " ".join(draw.choice(WORDS, draw.integers(0, 30), p=[0.06] + [0.02] * 47))) for i in range(300)]
    return spark.createDataFrame([*rows, (300, None)], "chunk_id long, text string").repartition(3).localCheckpoint()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "The cat the DOG"), (2, "ant"), (3, "unicorn"), (4, None), (5, "the the ox eel")], "query_id long, text string")


def test_python_words_are_the_engines(spark):
    every = [(c, f"Ab{chr(c)}C {chr(c)}") for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0 or unicodedata.category(chr(c)) in ("Cn", "Nl", "No"))]
    rows = spark.createDataFrame([*every, (-1, "ΑΣ Σ ΑΣ. ΑΣ'Α"), (-2, "İstanbul ıI ǅ ẞ"), (-3, ""), (-4, None)], "c long, text string")
    words = T.word_finder(T.word_patterns(spark))
    found = rows.select("c", T.lowered(F.col("text")).alias("low"), T.tokens(F.col("text")).alias("t")).collect()
    assert [r["c"] for r in found if words(r["low"]) != list(r["t"])] == []


def test_hashed_vectors_are_those_of_the_column(spark, chunks):
    one = {r["chunk_id"]: r["vector"] for r in T.hashed_vectors(chunks, "chunk_id").collect()}
    other = {r["chunk_id"]: r["v"] for r in chunks.select("chunk_id", T.hashed_vector(T.tokens(F.col("text"))).alias("v")).collect()}
    assert one == other


def test_statistics_of_asked_terms(spark, chunks, monkeypatch):
    monkeypatch.setattr(bm25, "TASK_TERMS", 3)
    stats, terms = bm25.statistics(bm25.tokenised(chunks))
    stats, terms = stats.first(), {r["term"]: (r["df"], round(r["idf"], 9)) for r in terms.collect()}
    got = bm25.asked_statistics(chunks, ["the", "ox", "unicorn"])
    assert (got.n_docs, round(got.avgdl, 9)) == (stats["n_docs"], round(stats["avgdl"], 9))
    assert {t: (got.df[t], round(got.idf[t], 9)) for t in got.df} == {t: terms[t] for t in ("the", "ox")}


@pytest.mark.parametrize("small", [False, True])
def test_search_is_the_top_of_all_pairs(spark, chunks, queries, monkeypatch, small):
    if small:
        for module, name, value in ((bm25, "BLOCK_TERMS", 1), (bm25, "SLICE_VALUES", 7), (bm25, "KEPT", 9), (bm25, "TASK_TERMS", 1)):
            monkeypatch.setattr(module, name, value)
        monkeypatch.setattr("quillspark.operators.ranking.SLACK", 1)
    for b in (0.0, 0.75):
        want = bm25.top_k(bm25.score_all(bm25.tokenised(chunks), queries, b=b), 4).select("query_id", "chunk_id", "score", "rank")
        got = bm25.search(chunks, queries, 4, b=(0.0, 0.75)).filter(F.col("b") == b).select("query_id", "chunk_id", "score", "rank")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert got.count() == 12


def test_a_sweep_leaves_tasks_with_the_best_only(spark, chunks, queries):
    """All pairs of every b once went through a shuffle (F1, F2)."""
    rows = bm25._scored(chunks, queries, 2, bm25.K1, (0.0, 0.5, 1.0), bm25.EPSILON)
    assert rows.count() <= 3 * 2 * 3 * chunks.rdd.getNumPartitions()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_an_empty_corpus_and_no_questions(spark, chunks, queries):
    assert bm25.search(chunks.limit(0), queries, 3).count() == 0
    assert bm25.search(chunks, queries.limit(0), 3).count() == 0
    assert bm25.explain(chunks.limit(0), queries, queries.selectExpr("query_id", "1L as chunk_id")).count() == 0


def test_explanations_add_up(spark, chunks, queries):
    best = bm25.search(chunks, queries, 1)
    shares = bm25.explain(chunks, queries, best.select("query_id", "chunk_id")).groupBy("query_id").agg(F.round(F.sum("share"), 4).alias("s"), F.count("*").alias("n"))
    assert {r["query_id"]: (r["s"], r["n"]) for r in shares.collect()} == {r["query_id"]: (round(r["score"], 4), {1: 4, 2: 1, 5: 4}[r["query_id"]]) for r in best.collect()}


def test_best_of_each_group_with_ties_and_nan(monkeypatch):
    monkeypatch.setattr("quillspark.operators.ranking.SLACK", 0)
    draw = np.random.default_rng(3)
    scores, ids = draw.integers(0, 6, (2, 500)).astype(float), draw.permutation(500)
    scores[1, 77] = np.nan
    best = Best(2, 7)
    for at in range(0, 500, 60):
        best.add(0, scores[:, at : at + 60], ids[at : at + 60])
    group, chunk, _ = best.rows()
    for g in range(2):
        order = sorted(range(500), key=lambda i: (-np.inf if np.isnan(scores[g, i]) else -scores[g, i], ids[i]))[:7]
        assert [int(c) for c in chunk[group == g]] == [int(ids[i]) for i in order]


def test_evidence_is_the_same_by_automaton_and_by_tokens(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "xone two three four five sixy"), (3, "two"), (4, None), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two three four five"), (2, "two"), (3, "e two three four five six"), (4, ""), (5, None)], "item_id long, text string")
    one = sorted(map(tuple, evaluate.exact_evidence(docs, items).collect()))
    assert "Join" not in evaluate.exact_evidence(docs, items)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(evaluate, "AUTOMATON_BYTES", 0)
    assert sorted(map(tuple, evaluate.exact_evidence(docs, items).collect())) == one
    assert [r[:2] for r in one] == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)]


def test_metrics_of_each_key(spark):
    gold = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "query_id long, chunk_id long")
    runs = spark.createDataFrame([("a", 1, 10, 2), ("b", 1, 10, 1), ("b", 1, 11, 2), ("b", 2, 12, 9)], "run string, query_id long, chunk_id long, rank int")
    got = evaluate.per_query(runs, gold, 5, spark.createDataFrame([("a",), ("b",)], "run string"))
    assert sorted(map(tuple, got.collect())) == [("a", 1, 0.5, 0.0, 0.5), ("a", 2, 0.0, 0.0, 0.0), ("b", 1, 1.0, 1.0, 1.0), ("b", 2, 0.0, 0.0, 0.0)]


def test_materials_are_made_once(spark):
    """The seven kinds of variants once made the materials again, each from all documents (F20)."""
    from quillspark.plans import evaluation

    plan = evaluation.corpus_variants_seeded(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") >= 7


def test_cross_fits_retrieve_once(spark):
    """Scores that are read again once were retrieved again (F6, F7, F12, F16)."""
    from quillspark.operators import sweep

    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(q, a / 10, float(q % 3 == a % 3)) for q in range(6) for a in range(11)], "query_id long, alpha double, rr double")
    scores = rows.mapInArrow(counted, "query_id long, alpha double, rr double")
    assert sweep.repeated_crossfit(scores, repeats=3).count() == 3
    assert ran.value == 66


def test_validation_query_equals_its_sql_on_odd_documents(spark, tmp_path):
    """Null, empty and repeated documents once added problems that the SQL does not have (F3)."""
    from quillspark.plans import evaluation
    from tests.oracle import same, views

    docs = [(0, "a"), (1, None), (2, ""), (3, "  "), (4, "x"), (4, "x"), (97, "y"), (8, None)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(i, f"q{i}") for i in range(12)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "b"))
    for folder, name in (("d", "documents"), ("b", "benchmark")):
        next((tmp_path / folder).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    same(evaluation.validate_eval_set(spark, str(tmp_path)), views(str(tmp_path)), evaluation.ORACLES["validate_eval_set"])

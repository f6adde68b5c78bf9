"""Candidates from one pass over the corpus: the two lists of separate searches, and no corpus read or counted again."""

import re

import numpy as np
import pyarrow as pa
import pytest

from quillspark.functions import text as T
from quillspark.operators import bm25, dense, fusion, hybrid
from quillspark.plans import retrieval

DATA = "/root/testdata/sf0.001"
WORDS = ["the", "cat", "dog", "bird", "fish", "ox", "eel", "ant", *(f"w{i}" for i in range(40))]


@pytest.fixture(scope="module")
def chunks(spark):
    draw = np.random.default_rng(7)
    rows = [(i, " ".join(draw.choice(WORDS, draw.integers(0, 30), p=[0.06] + [0.02] * 47))) for i in range(300)]
    return spark.createDataFrame([*rows, (300, None), (301, ""), (302, "ΑΣ Σ 𐐀𐐁 cat"), (None, "cat cat")], "chunk_id long, text string").repartition(3).localCheckpoint()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "The cat the DOG"), (2, "ant"), (3, "unicorn"), (4, None), (5, "the the ox eel ας 𐐨𐐩")], "query_id long, text string")


def rows_of(df):
    return {(r["query_id"], r["chunk_id"]): tuple(None if v is None else round(v, 9) for v in r[2:]) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 7, 400])
@pytest.mark.parametrize("narrow", [False, True])
def test_candidates_are_those_of_separate_searches(spark, chunks, queries, k, narrow, monkeypatch):
    if narrow:  # many passes
        monkeypatch.setattr(bm25, "BLOCK_TERMS", 2)
        monkeypatch.setattr(bm25, "KEPT", 1)
        monkeypatch.setattr(dense, "BLOCK_VALUES", 64)
    held = chunks.filter("chunk_id is not null")
    # the row without an id counts in BM25's statistics, but is in no list
    apart = fusion.candidates(dense.search(T.hashed_vectors(held, "chunk_id"), T.hashed_vectors(queries, "query_id"), k), bm25.search(chunks, queries, k))
    found = hybrid.candidates(chunks, queries, k)
    assert found.columns == apart.columns
    assert found.dtypes == apart.dtypes
    assert rows_of(found) == rows_of(apart)
    assert found.count() == apart.count()


def test_candidates_of_nothing(spark, chunks, queries):
    assert hybrid.candidates(chunks, queries.limit(0), 3).count() == 0
    assert hybrid.candidates(chunks.limit(0), queries, 3).count() == 0
    bare = hybrid.candidates(chunks.filter("text is null and chunk_id is not null"), queries, 3).collect()
    assert {r["query_id"] for r in bare} == {1, 2, 3, 4, 5}
    assert {r["bm25_rank"] for r in bare} == {None}


FUSED = {
    "fusion_sweep_curve": 2,
    "minmax_scores": 1,
    "linear_fusion": 1,
    "weighted_rrf": 1,
    "eval_runs": 2,
    "rrf_fusion": 1,
    "hybrid_search": 1,
    "paired_difference": 2,
}


@pytest.mark.parametrize("name", FUSED)
def test_both_lists_come_from_one_read(spark, name):
    """Scans of the corpus after the statistics: one for both lists, and one for gold where there is gold."""
    plan = retrieval.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"^.*Relation \[doc_id#", plan, re.M)) == FUSED[name]


def test_runs_that_are_paired_come_from_one_read(spark):
    """What eval_pairs persists reads the corpus once for both lists and once for gold."""
    plan = retrieval.all_runs(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"^.*Relation \[doc_id#", plan, re.M)) == 2


@pytest.mark.parametrize("name", ["bm25_explain"])
def test_statistics_are_counted_once(spark, name, monkeypatch):
    counted, count = [], bm25.asked_statistics
    monkeypatch.setattr(bm25, "asked_statistics", lambda *a, **b: counted.append(a) or count(*a, **b))
    retrieval.QUERIES[name](spark, DATA).count()
    assert len(counted) == 1


def test_length_ratio_counts_no_corpus_lengths_again(spark, monkeypatch):
    """Only the chunks that were found are cut into tokens for their lengths."""
    cut, tokenised = [], bm25.tokenised
    monkeypatch.setattr(bm25, "tokenised", lambda chunks, *a: cut.append(chunks) or tokenised(chunks, *a))
    assert retrieval.top5_length_ratio(spark, DATA).first()["ratio"] > 0
    assert [c.select("chunk_id").distinct().count() < retrieval.corpus(spark, DATA).count() for c in cut] == [True]
    assert all("Join" in c._jdf.queryExecution().optimizedPlan().toString() for c in cut)


def test_small_slices_and_counts_handed_on_early_change_nothing(spark, chunks, queries, monkeypatch):
    whole = rows_of(hybrid.candidates(chunks, queries, 7))
    monkeypatch.setattr(hybrid, "SLICE_TOKENS", 20)
    monkeypatch.setattr(bm25, "TASK_TERMS", 5)
    assert rows_of(hybrid.candidates(chunks, queries, 7)) == whole
    tokenised = bm25.tokenised(chunks)
    assert rows_of(hybrid.candidates(tokenised, queries, 7)) == whole


def test_cut_rows_of_one_search_are_held(spark, chunks, queries):
    """A later search gives up what an earlier one persisted, whose result is still right."""
    first = hybrid.candidates(chunks, queries, 7)
    held = spark.sparkContext._quillspark_cut
    expected = rows_of(first)
    other = rows_of(hybrid.candidates(chunks.filter("chunk_id < 100"), queries, 7))
    assert not held.is_cached
    assert spark.sparkContext._quillspark_cut.is_cached
    assert rows_of(first) == expected != other


ONE_PASS = [
    "hybrid_search",
    "rrf_fusion",
    "eval_pairs",
    "eval_runs",
    "weighted_rrf",
    "linear_fusion",
    "minmax_scores",
    "fusion_sweep_curve",
]


@pytest.mark.parametrize("name", ONE_PASS)
def test_corpus_is_read_once(spark, name, monkeypatch):
    """Statistics and both lists come from one read of every row of the corpus."""
    read, corpus = spark.sparkContext.accumulator(0), retrieval.corpus

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(retrieval, "corpus", lambda s, d: corpus(s, d).mapInArrow(counting, "chunk_id long, text string"))
    assert retrieval.QUERIES[name](spark, DATA).collect()
    assert read.value == corpus(spark, DATA).count()


def test_each_distinct_token_of_a_slice_is_looked_up_once(chunks, monkeypatch):
    """The cut of the step, run here: repeats of a token cost no look-up of their own."""
    looked, held = [], {}

    class Counted(hybrid.Seen):
        def __getitem__(self, token):
            looked.append(token)
            return super().__getitem__(token)

    monkeypatch.setattr(hybrid, "Seen", Counted)
    monkeypatch.setattr(type(chunks), "mapInArrow", lambda self, run, schema: held.update(run=run) or self)
    hybrid._cut(chunks, ["cat"], 64)
    texts = ["cat cat dog", "", "cat"]
    rows = pa.Table.from_batches(held["run"]([pa.RecordBatch.from_pydict({"chunk_id": [1, 2, 3], "text": texts})])).to_pylist()
    assert sorted(looked) == ["cat", "dog"]
    assert [(r["doc_id"], r["length"], len(r["asked"])) for r in rows if r["doc_id"]] == [(1, 3, 2), (2, 0, 0), (3, 1, 1)]
    assert {(r["term"], r["df"]) for r in rows if r["term"]} == {("cat", 2), ("dog", 1)}


ODD = ["", "cat", " ", "é", "é1 x_y", "a\U00010400b ǅ٣٤", "日本 語_3", "x", "x", "\U0001d7ff|\u0378|\U0010ffff", "a\u0301b", "\0a\0", "ends ñ", "ñ starts", "½ ² \u200b_"]


def test_words_of_bytes_are_those_of_the_engine(spark):
    patterns = T.word_patterns(spark)
    table, words = T.word_table(patterns), T.word_finder(patterns)
    draw = np.random.default_rng(3)
    texts = [*ODD, *("".join(draw.choice(list("ab_ .-é日\U00010400\u0301"), draw.integers(0, 12))) for _ in range(300)), chr(0x24F) * 3]
    expected = [r["t"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(1).sortWithinPartitions("i").select(T.tokens(T.F.col("s")).alias("t")).collect()]
    lowered = [t.lower() for t in texts]
    for column, wanted in ((pa.array(lowered), expected), (pa.array(lowered)[5:9], expected[5:9]), (pa.array([], pa.string()), [])):
        found, sizes = T.words_of(column, table)
        assert found.to_pylist() == [t for row in wanted for t in row] == [t for x in column.to_pylist() for t in words(x)]
        assert sizes.tolist() == [len(row) for row in wanted]

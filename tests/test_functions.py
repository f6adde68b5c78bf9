"""Text functions, chunks and fusion on cases computed by hand."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import bm25, chunking, dense, evaluate, fusion, review, sweep, variants


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} string" for k in values) or "x int")
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("value", "kind"),
    [("1999", "year"), ("2099", "year"), ("2100", "number"), ("May 7, 1999", "date"), ("31 May 1999", "date"), ("32 May 1999", None), ("1,234.5", "number"), ("12 km", "number"), ("12,34", None), ("729 at the census", None), ("New York", "entity"), ("University of Oslo", "entity"), ("of Oslo", None), ("Bank of", None), ("yes", None), ("Élan", None), ("IV", "entity"), ("A B C D E F G", None)],
)
def test_value_type(spark, value, kind):
    assert one(spark, T.value_type(F.col("a")), a=value) == kind
    assert variants.value_kind(value) == kind


@pytest.mark.parametrize(("text", "normal"), [("The Cat, a hat!", "cat hat"), ("an  other\tone", "other one"), ("theatre", "theatre"), ("l'été", "lété"), ("", "")])
def test_normalise(spark, text, normal):
    assert one(spark, T.normalize_answer(F.col("a")), a=text) == normal == variants.normalised(text)


def test_containment(spark):
    assert one(spark, T.contains_answer(F.col("a"), F.col("b")), a="Art", b="modern art.") is True
    assert one(spark, T.contains_answer(F.col("a"), F.col("b")), a="art", b="party") is False
    assert one(spark, T.contains_answer(F.col("a"), F.col("b")), a="the", b="the") is False


def test_replacement_is_literal(spark):
    assert one(spark, T.replace_value(F.col("a"), F.col("b"), F.col("c")), a="It cost 5 or 55, 5.", b="5", c=r"$1\x") == r"It cost $1\x or 55, $1\x."


def test_seed_matches_python(spark):
    import hashlib

    expected = int.from_bytes(hashlib.sha256(b"7:q:1").digest()[:8], "big")
    assert int(one(spark, T.seed_of(F.lit(7), F.col("a")), a="q:1")) == expected


SENTENCES = [
    ("Rain fell all day. Nobody minded! Why would they?", ["Rain fell all day.", "Nobody minded!", "Why would they?"]),
    ("We met Prof. Lund at noon. She was late.", ["We met Prof. Lund at noon.", "She was late."]),
    ("A. B. Quill signed it. So did I.", ["A. B. Quill signed it.", "So did I."]),
    ("Trains from D.C. Union leave hourly. Take one.", ["Trains from D.C. Union leave hourly.", "Take one."]),
    ("(It rained.) Then it stopped... Really?! Yes.", ["(It rained.)", "Then it stopped...", "Really?!", "Yes."]),
    ("They closed at 9 p.m. and reopened. Odd!", ["They closed at 9 p.m. and reopened.", "Odd!"]),
    (" \n\t", []),
    ("a line without any end", ["a line without any end"]),
    ("x" * 200_000 + ". Y", ["x" * 200_000 + ".", "Y"]),
]


@pytest.mark.parametrize(("text", "expected"), SENTENCES)
def test_sentences(text, expected):
    assert [text[a:b] for a, b in chunking.split_sentences(text)] == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["Dr.", "A", "end.", "x", '"q."', " ", "\n", "U.S.", "Then", "!"])))
def test_sentences_partition(parts):
    text = " ".join(parts)
    spans = chunking.split_sentences(text)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert "".join(text[a:b] for a, b in spans).replace(" ", "").replace("\n", "") == re.sub(r"\s", "", text)


def loop_windows(n, size, overlap):
    out, i = [], 0
    while i < n:
        out.append((i, min(i + size, n)))
        if i + size >= n:
            break
        i += size - overlap
    return out


@pytest.mark.parametrize(("size", "overlap"), [(4, 0), (4, 1), (4, 2), (5, 2), (3, 2), (1, 0)])
def test_word_windows(spark, size, overlap):
    rng = random.Random(5)
    docs = [(n, " ".join("w" * rng.randint(1, 4) + rng.choice(["", " ", "\n"]) for _ in range(n))) for n in range(14)]
    docs[3] = (3, "  lead and trail  ")
    got = {}
    for r in chunking.chunk(spark.createDataFrame(docs, "doc_id long, text string"), chunking.Config("fixed_words", size, overlap)).collect():
        got.setdefault(r["doc_id"], []).append((r["position"], r["char_start"], r["char_end"], r["text"]))
    for key, text in docs:
        words = chunking.word_units(text)
        expected = [(p, words[a][0], words[b - 1][1], text[words[a][0] : words[b - 1][1]]) for p, (a, b) in enumerate(loop_windows(len(words), size, overlap))]
        assert sorted(got.get(key, [])) == expected


def test_config_refuses():
    for bad in (("other", 1, 0), ("fixed_words", 0, 0), ("fixed_words", 2, 2), ("fixed_words", 2, -1)):
        with pytest.raises(ValueError):
            chunking.Config(*bad)


def ranked_list(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, score double, rank int")


def test_fusion_by_hand(spark):
    dense_list = ranked_list(spark, [(1, 10, 0.9, 1), (1, 11, 0.5, 2), (1, 12, 0.1, 3)])
    other = ranked_list(spark, [(1, 12, 7.0, 1), (1, 13, 7.0, 2)])
    c = fusion.candidates(dense_list, other)
    got = fusion.ranked(c.withColumn("fused", fusion.rrf_score()), ["query_id"]).orderBy("rank").collect()
    assert [(r["chunk_id"], r["fused"]) for r in got] == [(12, round(1 / 63 + 1 / 61, 9)), (10, round(1 / 61, 9)), (11, round(1 / 62, 9)), (13, round(1 / 62, 9))]
    scaled = {r["chunk_id"]: (r["dense_scaled"], r["bm25_scaled"]) for r in fusion.with_scaled(c).collect()}
    assert scaled[10] == (1.0, 0.0) and scaled[12] == (0.0, 1.0) and scaled[13] == (0.0, 1.0) and abs(scaled[11][0] - 0.5) < 1e-12


def test_evidence_of_cut_tokens_and_short_items(spark):
    """Substrings that begin and end inside tokens, items of few or no tokens, against a plain search."""
    rng = random.Random(6)
    docs = [(k, " ".join(rng.choice(["cat", "concat", "sat", "mat", "the", "on", "é!", "--"]) for _ in range(rng.randint(0, 40)))) for k in range(60)] + [(99, None)]
    items = [(1, "cat sat on the mat"), (2, "at"), (3, "--"), (4, ""), (5, None), (6, "t on the m")]
    for k in range(60):
        text = docs[rng.randrange(60)][1]
        a = rng.randrange(len(text) + 1)
        items.append((10 + k, text[a : a + rng.randint(1, 40)]))
    docs.append((100, "a concat sat on the mat here"))
    got = sorted(tuple(r) for r in evaluate.exact_evidence(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == sorted((q, d, t.find(i), t.find(i) + len(i)) for q, i in items if i for d, t in docs if t and i in t)
    assert evaluate.exact_evidence(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_hashed_vector(spark):
    import hashlib

    words = ["a", "b", "a", "ccc", "été"]
    counts = [0.0] * 64
    for w in words:
        counts[hashlib.md5(w.encode()).digest()[-1] % 64] += 1
    norm = sum(c * c for c in counts) ** 0.5
    rows = spark.createDataFrame([(words,), ([],)], "t array<string>").select(T.hashed_vector(F.col("t")).alias("v")).collect()
    assert rows[0]["v"] == pytest.approx([c / norm for c in counts]) and rows[1]["v"] == [1.0] + [0.0] * 63


def test_metrics_by_hand(spark):
    ranks = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1), (2, 8, 2)], "query_id long, chunk_id long, rank int")
    gold = spark.createDataFrame([(1, 6), (1, 9), (2, 1), (3, 1)], "query_id long, chunk_id long")
    got = {r["query_id"]: (r["recall"], r["complete"], r["rr"]) for r in evaluate.per_query(ranks, gold, 5).collect()}
    assert got == {1: (0.5, 0.0, 0.5), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_choice_goes_to_even_weights(spark):
    rows = [(q, k / 10, 1.0) for q in range(4) for k in range(11)]
    chosen = sweep.choose(spark.createDataFrame(rows, "query_id long, alpha double, rr double"), "rr", [])
    assert chosen.first()["alpha"] == 0.5


def test_bm25_against_plain_python(spark):
    import math

    docs = [(1, "cat cat cat dog bird fish"), (2, "dog"), (3, "the dog"), (4, "cat bird"), (5, "!!!")]
    queries = [(1, "cat dog dog unicorn")]
    toks = bm25.tokenised(spark.createDataFrame(docs, "chunk_id long, text string"))
    got = {r["chunk_id"]: r["score"] for r in bm25.score_all(toks, spark.createDataFrame(queries, "query_id long, text string")).collect()}
    words = {i: re.findall(r"\w+", t) for i, t in docs}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    df = {w: sum(w in x for x in words.values()) for x in words.values() for w in x}
    raw = {w: math.log((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    for i, x in words.items():
        score = sum(idf.get(t, 0) * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t in ["cat", "dog", "dog", "unicorn"])
        assert abs(got.get(i, 0.0) - score) < 1e-6


def test_wilson(spark):
    rows = spark.createDataFrame([(37, 40), (36, 40), (39, 39), (88, 100), (0, 0)], "k long, n long")
    got = rows.select(review.wilson_lower(F.col("k"), F.col("n")).alias("b"), review.passes_gate(F.col("k"), F.col("n")).alias("p")).collect()
    assert [r["p"] for r in got[:5]] == [True, False, False, True, False]
    assert got[4]["b"] == 0.0
    with pytest.raises(Exception, match="5 of 4 is not a share"):
        spark.createDataFrame([(5, 4)], "k long, n long").select(review.wilson_lower(F.col("k"), F.col("n"))).collect()
    for r, (k, n) in zip(got, [(37, 40), (36, 40), (39, 39), (88, 100)], strict=False):
        # the bound solves (k/n - p)^2 = z^2 p (1 - p) / n
        assert abs((k / n - r["b"]) ** 2 - review.Z**2 * r["b"] * (1 - r["b"]) / n) < 1e-12


def test_dense_blocks_and_ties(spark):
    v = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(20)], "chunk_id long, vector array<double>").repartition(3)
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "query_id long, vector array<double>")
    full = sorted(map(tuple, dense.search(v, q, 4).collect()))
    old, dense.BLOCK_VALUES = dense.BLOCK_VALUES, 2
    try:
        assert sorted(map(tuple, dense.search(v, q, 4).collect())) == full
    finally:
        dense.BLOCK_VALUES = old
    assert [r[1] for r in full if r[0] == 2] == [0, 1, 2, 3] and [r[1] for r in full if r[0] == 1] == [2, 5, 8, 11]

"""Embedding links against all pairs, components, SQL of the operators that have it, and the pipeline."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import same, views  # noqa: E402

from quillspark.llm import components, embed_dedup, registry  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute(rows):
    ids = np.array([r[0] for r in rows])
    fine = np.array([r[2] is not None and r[1] is not None and None not in r[1] and bool(np.isfinite(r[1]).all()) and bool(np.any(np.array(r[1]) != 0)) for r in rows])
    links = np.zeros((len(rows), len(rows)), dtype=bool)
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                links[i, j] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98
    label = ids.copy()
    while True:
        new = np.array([min([label[i], *label[links[i]]]) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    return sorted(zip(ids.tolist(), links.sum(axis=1).tolist(), label.tolist(), (label == ids).tolist(), strict=True))


@pytest.mark.parametrize(("block", "whole", "cell"), [(2048, 8192, 1024), (8, 8192, 1024), (1024, 10, 16), (5, 10, 8)])
def test_embedding_links(spark, monkeypatch, block, whole, cell):
    rng = np.random.default_rng(block)
    centre = rng.standard_normal((6, 16))
    rows = []
    for k in range(120):
        v = (centre[k % 6] + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.12, 0.4])).astype(np.float32)
        rows.append((k, v.tolist(), [None, 1, 2][k % 3 if k > 100 else 1 + k % 2]))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None] * 16, 1), (204, [1.0, 0.0], 1), (205, [2.0, 0.0], 1), (206, rows[0][1], rows[0][2]), (207, [], 1), (208, [float("inf")] * 16, 1)]
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "WHOLE", whole)
    monkeypatch.setattr(embed_dedup, "CELL", cell)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = sorted(tuple(r) for r in embed_dedup.embedding_links(df).collect())
    assert got == brute(rows)
    assert embed_dedup.embedding_links(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [8, 64, 200])
def test_estimates_and_bounds(dim):
    """The estimate is unbiased over rotations, and pairs at the threshold stay within every bound."""
    rng = np.random.default_rng(dim)
    t = embed_dedup.THRESHOLD
    x, e = rng.standard_normal((400, dim)), rng.standard_normal((400, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    e -= np.einsum("ij,ij->i", e, x)[:, None] * x
    e /= np.linalg.norm(e, axis=1)[:, None]
    for cosine in (t, 0.99, 0.5):
        y = cosine * x + np.sqrt(1 - cosine**2) * e
        found = []
        for seed in range(8):
            rotated, bits, factor = embed_dedup.codes(x, seed)
            other, bits_y, _ = embed_dedup.codes(y, seed)
            value, width = embed_dedup.estimate(bits, factor, other, t)
            found.append(value)
            if cosine >= t:
                assert (value + width >= t).all()
                unlike = np.bitwise_count(bits ^ bits_y).sum(axis=1)
                assert (unlike <= np.minimum(embed_dedup.most_unlike(rotated, t), embed_dedup.most_unlike(other, t))).all()
        assert abs(np.mean(found) - cosine) < 0.01


def test_extreme_norms(spark):
    """Squares that would overflow or vanish change nothing."""
    v = np.random.default_rng(1).standard_normal(16)
    rows = [(k, (v * s + d * s).tolist(), 1) for k, (s, d) in enumerate([(1, 0), (1e200, 0), (1e200, 1e-7), (1e-200, 0), (1e-200, 1e-7), (-1e200, 0)])]
    got = sorted(tuple(r) for r in embed_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(0, 4, 0, True), (1, 4, 0, False), (2, 4, 0, False), (3, 4, 0, False), (4, 4, 0, False), (5, 0, 5, True)]


def test_tables_lose_no_pair():
    """Pairs at the threshold meet in some table, whatever the label's size."""
    rng = np.random.default_rng(3)
    x, e = rng.standard_normal((20_000, 64)), rng.standard_normal((20_000, 64))
    y = 0.98 * x / np.linalg.norm(x, axis=1)[:, None] + np.sqrt(1 - 0.98**2) * (e - (np.einsum("ij,ij->i", e, x) / np.einsum("ij,ij->i", x, x))[:, None] * x) / np.linalg.norm(e, axis=1)[:, None]
    for n in (10_000, 1_000_000, 10**9):
        k, tables = embed_dedup.tables_for(n, 0.98)
        assert k and (embed_dedup.table_keys(x, k, tables) == embed_dedup.table_keys(y, k, tables)).any(axis=1).all()


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(k, k + 1) for k in range(400, 460)] + [(500, 500)]
    label = list(range(600))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert [got.get(i, i) for i in range(600)] == label
    assert components.connected_components(df.limit(0)).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_EDGES", 4)
    monkeypatch.setattr(components, "HUB_SHARE", 20)
    test_components(spark)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    same(registry.queries()[name](spark, SF), views(SF), registry.oracle_sql()[name])


def test_pipeline(spark):
    """Each stage against what brute force makes of its own input."""
    import re

    import corpus_pipeline as P

    from quillspark.llm import bpe, simhash, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "encoding"]
    before = {r["doc_id"]: r for r in docs.collect()}
    bad = {r["doc_id"] for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["predicted"]}
    now = P.drop_toxic(spark, docs, SF).cache()
    assert {r["doc_id"] for r in now.collect()} == set(before) - bad and bad
    lined = P.dedup_repeated_lines(spark, now, SF).cache()
    assert lined.columns == docs.columns and lined.count() == now.count()
    rows = {r["doc_id"]: r for r in lined.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
    kept = P.drop_near_duplicates(spark, lined, SF).cache()
    left = {r["doc_id"] for r in kept.collect()}
    sets = {k: set(simhash.shingle_hashes(r["text"], P.SHINGLE).tolist()) for k, r in rows.items()}
    group = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if group[a] < group[b] and len(sets[a] & sets[b]) >= P.SIMILARITY * len(sets[a] | sets[b]):
                    group[b], changed = group[a], True
    assert left == {k for k in group if group[k] == k}
    for k in set(rows) - left:
        assert any(o < k for o in left), "the smallest of a group stays"
    clean = P.decontaminate(spark, kept, SF).cache()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    grams = {}
    for item, t in enumerate(bench):
        w = word.findall(lower(t))
        for i in range(max(len(w) - 7, min(len(w), 1))):
            grams.setdefault(tuple(w[i : i + 8]), set()).add(item)
    expected = {}
    for r in kept.collect():
        spans = [m.span() for m in word.finditer(lower(r["text"]))]
        w = [lower(r["text"])[a:b] for a, b in spans]
        hit, items = [False] * len(w), set()
        for i in range(len(w)):
            for m in {len(g) for g in grams}:
                if tuple(w[i : i + m]) in grams and i + m <= len(w):
                    items |= grams[tuple(w[i : i + m])]
                    hit[i : i + m] = [True] * m
        if len(items) > 1 or (items and 2 * sum(hit) >= len(w)):
            continue
        gone = [(a, b) for (a, b), h in zip(spans, hit, strict=True) if h]
        runs = []
        for k, (a, b) in enumerate(gone):
            if k and spans.index((a, b)) == spans.index(gone[k - 1]) + 1:
                runs[-1] = (runs[-1][0], b)
            else:
                runs.append((a, b))
        text = r["text"]
        for a, b in reversed(runs):
            text = text[:a] + text[b:]
        expected[r["doc_id"]] = text
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == expected
    assert any(expected.get(r["doc_id"]) != r["text"] for r in kept.collect())
    encoder = bpe.TextEncoder(bpe.RANKS)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in P.encode(spark, clean, SF).collect():
        assert r["text"] == texts[r["doc_id"]] and r["ids"] == encoder.encode([r["text"]])[0].tolist() and r["n_tokens"] == len(r["ids"])


def test_stages_with_odd_rows(spark):
    """Null and repeated ids, null, empty and long texts, equal rows, other columns, and no rows at all."""
    import corpus_pipeline as P

    rows = [(None, "first words\nof a null id", "en"), (None, None, None), (3, "", "en"), (3, "another text under the id three", "en"), (4, "same row", "de"), (4, "same row", "de"), (9, "long " * 60_000, "fr")]
    df = spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", P.F.lit("clash")).withColumn("k", P.F.lit(1))
    for name, stage in P.STAGES:
        made = stage(spark, df, SF)
        got = made.collect()
        assert len(got) == (5 if name == "near duplicates" else 7), name
        assert name == "encoding" or made.columns == P.COLUMNS
        assert {r["doc_id"] for r in got} == {None, 3, 4, 9}
        assert stage(spark, df.limit(0), SF).count() == 0


def test_pipeline_runs(spark):
    import corpus_pipeline as P

    assert P.run(spark, SF).count() > 0

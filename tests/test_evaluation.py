"""Variants, audits, generation, evaluation sets and sampling."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import dataset, generation, review, variants
from quillspark.plans import evaluation
from quillspark.sources import evalset

SF = "/root/testdata/sf0.001"


def test_materials_against_a_loop(spark):
    """Gold, extra sentences, titles, distractors and chunk ids by plain Python."""
    from quillspark.operators import material

    texts = {"a": "One two. Three four. Five.", "b": "Six. Seven eight nine."}
    spans = {"a": [(0, 8), (9, 20), (21, 26)], "b": [(0, 4), (5, 22)]}
    docs = spark.createDataFrame([(k, f"Title {k} (x)", t, [{"start": x, "end": y} for x, y in spans[k]]) for k, t in texts.items()] + [("c", "C", "Other", None)], "doc_id string, title string, text string, sentence_spans array<struct<start:int,end:int>>")
    chunks = [(1, "a", 0, 10), (2, "a", 10, 26), (3, "b", 0, 22)]
    rows = spark.createDataFrame([(i, d, x, y, texts[d][x:y]) for i, d, x, y in chunks], "chunk_id long, doc_id string, char_start int, char_end int, text string")
    questions = spark.createDataFrame([("q", "five"), ("none", "x")], "key string, answer string")
    evidence = spark.createDataFrame([("q", 1, "a", 9, 20), ("q", 0, "b", 5, 22), ("q", 2, "a", 0, 8), ("q", 3, "gone", 0, 1)], "key string, place int, doc_id string, char_start int, char_end int")
    distractors = spark.createDataFrame([("q", 0, "c"), ("q", 1, "gone"), ("none", 0, "b")], "key string, place int, doc_id string")
    got = {r["key"]: r for r in material.assemble(questions, evidence, distractors, docs, rows).collect()}
    q = got["q"]
    assert [(g["text"], g["chunk_ids"]) for g in q["gold"]] == [("Seven eight nine.", [3]), ("Three four.", [1, 2]), ("One two.", [1])]
    assert [(g["text"], g["chunk_ids"]) for g in q["extras"]] == [("Six.", [3]), ("Five.", [2])] and q["titles"] == ["Title b (x)", "Title a (x)"]
    assert q["distractors"] == [] and q["candidates"] == ["C"]
    assert got["none"]["gold"] is None and [c["chunk_id"] for c in got["none"]["distractors"]] == [3] and got["none"]["candidates"] == ["Title b"]


def test_stored_rows_keep_every_constraint(spark):
    rows = evaluation.corpus_variants_seeded(spark, SF).withColumn("id", F.monotonically_increasing_id()).cache()
    kinds = {tuple(r) for r in rows.select("variant_type", "status").distinct().collect()}
    assert len({k for k, _ in kinds}) == 6 and ("right_answer_wrong_citation", "labelled") in kinds
    assert review.violations(rows, review.variant_constraints(variants.ACCEPT, variants.REJECT), "id").count() == 0
    kept = rows.filter("variant_type = 'right_answer_wrong_citation' and status = 'labelled'").first()
    assert [g["name"] for g in json.loads(kept["guard_report"])] == ["cites_something", "disjoint_from_gold", "no_support_in_cited"]


def test_citation_guards():
    chunks = [{"chunk_id": 4, "text": "Nothing here"}, {"chunk_id": 5, "text": "About Oslo"}]
    assert variants.failed_guard(variants.citation_guards([], [1], ["x"])) == "cites_something"
    assert variants.failed_guard(variants.citation_guards(chunks, [4], ["x"])) == "disjoint_from_gold"
    assert variants.failed_guard(variants.citation_guards(chunks, [1], ["oslo"])) == "no_support_in_cited"
    assert variants.failed_guard(variants.citation_guards(chunks, [1], ["x"])) is None


def test_corpus_is_loaded_once(spark, tmp_path):
    from quillspark.operators import chunking
    from quillspark.sources import corpus

    class BagOfWords:
        """Offline embedder: counts of words by hash, of unit length."""

        dim, instruction = 16, "find: "

        def __init__(self, scale=1.0, short=0):
            self.scale, self.short = scale, short

        def embed(self, texts):
            import hashlib

            import numpy as np

            out = np.zeros((len(texts), self.dim))
            for row, text in zip(out, texts, strict=True):
                for w in [*text.lower().split(), "."]:
                    row[hashlib.md5(w.encode()).digest()[0] % self.dim] += 1
            return (out / np.linalg.norm(out, axis=1)[:, None] * self.scale)[:, self.short :]

    docs = spark.createDataFrame([("1", "t", "One two. Three.", None, None), ("2", "u", "Four five six.", [(0, 4), (5, 14)], None)], evalset.DOCUMENT)
    questions = spark.createDataFrame([("q", "?", "a", [("1", 0, 3)], None)], evalset.QUESTION)
    root, config = str(tmp_path / "c"), chunking.Config("sentence_window", 1, 0)
    assert corpus.of(spark, f"{root}/documents", corpus="x") is None
    corpus.load_corpus(spark, root, "x", docs, questions)
    corpus.load_corpus(spark, root, "y", docs.limit(1).filter("id = '1'"), questions)
    with pytest.raises(ValueError, match="already"):
        corpus.load_corpus(spark, root, "x", docs, questions)
    with pytest.raises(ValueError, match="unknown document"):
        corpus.load_corpus(spark, root, "z", docs.filter("id = '2'"), questions)
    made, new = corpus.chunk_set(spark, root, "x", config)
    assert new and sorted(r["text"] for r in made.collect()) == ["Four", "One two.", "Three.", "five six."]
    again, new = corpus.chunk_set(spark, root, "x", config)
    assert not new and sorted(map(str, again.collect())) == sorted(map(str, made.collect()))
    vectors, new = corpus.embeddings(spark, root, "x", config, "bag", BagOfWords)
    assert new and vectors.count() == 4 and not corpus.embeddings(spark, root, "x", config, "bag", BagOfWords)[1]
    for bad, why in ((lambda: BagOfWords(2.0), "unit length"), (lambda: BagOfWords(1.0, 1), "shape")):
        with pytest.raises(Exception, match=why):
            corpus.embedded(made, bad, "chunk_id").collect()
    asked = spark.createDataFrame([(1, "two")], "id long, text string")
    assert corpus.embedded(asked, BagOfWords, "id", questions=True).first()["vector"] != corpus.embedded(asked, BagOfWords, "id").first()["vector"]
    ids = [r["chunk_id"] for r in made.orderBy("text").collect()]
    assert [(r["chunk_id"], r["place"]) for r in corpus.chunks_by_id(made, [ids[2], ids[0], 5]).orderBy("place").collect()] == [(ids[2], 0), (ids[0], 1)]
    assert corpus.chunks_by_id(made, []).count() == 0 and [r["id"] for r in corpus.first_questions(docs, 1).collect()] == ["1"]


def test_variants_obey_their_labels(spark):
    m = {r["key"]: r for r in evaluation.materials(spark, SF).collect()}
    seen = {}
    for o in variants.all_variants(evaluation.materials(spark, SF), 3).collect():
        x, kind = m[o["key"]], o["variant_type"]
        seen.setdefault((kind, o["sub_kind"] if kind == "partially_correct" else None), []).append(o)
        assert o["is_correct"] == (kind in variants.ACCEPT)
        assert (o["text"] is None) == (o["discard_reason"] is not None)
        if o["text"] is None:
            continue
        stated = variants.states(x["answer"], o["text"])
        gold = [c for g in x["gold"] for c in g["chunk_ids"]]
        if kind in variants.ACCEPT or o["sub_kind"] == "wrong":
            assert stated
        if kind == "right_topic_wrong_detail" or o["sub_kind"] == "missing":
            assert not stated
        if kind == "right_answer_wrong_citation":
            assert stated and not set(o["cited"]) & set(gold) and len(o["cited"]) == len(gold)
        if kind == "verbose_correct":
            assert set(gold) <= set(o["cited"])
    assert len(seen) == 7 and all(len(v) == len(m) for v in seen.values())


def test_variants_do_not_depend_on_partitions(spark):
    m = evaluation.materials(spark, SF)
    a = sorted(map(str, variants.seeded(m.repartition(5), "wrong_detail", 3).collect()))
    assert a == sorted(map(str, variants.seeded(m.coalesce(1), "wrong_detail", 3).collect()))


@pytest.mark.parametrize(
    ("replacement", "tamper", "expected"),
    [("1999", "", "different"), ("soon", "", "same_type"), ("2005", "", "absent_from_gold"), ("2001", " x", "rest_unchanged"), ("2001", "", None)],
)
def test_guards(replacement, tamper, expected):
    source = "It began in 1999."
    result = variants.replaced(source, "1999", replacement) + tamper
    assert variants.failed_guard(variants.mutation_guards(source, result, "1999", replacement, "year", "In 2005 it ended.")) == expected
    kept = variants.mutation_guards(source, source, "1999", "2001", "year", "")
    assert variants.failed_guard(kept) == "original_removed" and not kept["rest_unchanged"]


def test_values_move_within_their_type():
    for value, kind in (("1000", "year"), ("2099", "year"), ("1", "number"), ("1,500 km", "number"), ("2.50", "number"), ("January 31, 1990", "date"), ("5 May 2001", "date")):
        for seed in range(30):
            new = variants.another(value, kind, variants.Draws(seed, value), [])
            assert new != value and variants.value_kind(new) == kind
    assert variants.another("Oslo", "entity", variants.Draws(1), ["x"]) is None


SHOWN = {"C1": 10, "C2": 20}
OUTPUTS = [
    ('{"answer": "a", "citations": ["[c 2]", "C1", "C02"], "answerable": true}', [20, 10], None),
    ('{"answer": "a", "citations": [], "answerable": false}', [], None),
    ("{", None, "not JSON"),
    ("3", None, "JSON is not an object"),
    ('{"answer": "", "citations": [], "answerable": true}', None, "'answer' missing"),
    ('{"answer": "a", "citations": [1], "answerable": true}', None, "'citations' missing"),
    ('{"answer": "a", "citations": [], "answerable": "yes"}', None, "'answerable' missing"),
    ('{"answer": "a", "citations": ["C3"], "answerable": true}', None, "cited passages"),
    ('{"answer": "a", "citations": [], "answerable": true}', None, "answerable=true but no citations"),
]


@pytest.mark.parametrize(("output", "cited", "error"), OUTPUTS)
def test_parse(output, cited, error):
    got = generation.parse_answer(output, SHOWN)
    if error is None:
        assert got["error"] is None and got["cited"] == cited
    else:
        assert got["error"].startswith(error) and got["answer"] is None


def test_generation_stores_failures_with_attribution(spark):
    calls = generation.generate(spark.createDataFrame([(1, "[C1] (t) words here"), (2, "nothing shown")], "id long, prompt string"), generation.ScriptedClient, "s")
    parsed = generation.parse_answers(calls.withColumn("shown", F.array(F.lit(5))), "id", "output", "shown")
    assert {r["id"]: r["cited"] for r in parsed.collect()} == {1: [5], 2: []}
    prompts = calls.select(F.col("prompt_sha256").alias("sha256")).distinct()
    assert review.attribution_gaps(calls, prompts, "id").count() == 0
    assert {r["problem"] for r in review.attribution_gaps(calls.withColumn("provider", F.lit(" ")), prompts.limit(0), "id").collect()} == {"missing_provider", "unknown_prompt"}


def test_prompt_placeholders(spark):
    with pytest.raises(ValueError):
        generation.render_prompt("{a} {b}", {"a": F.lit("x")})


def test_each_constraint_catches_its_case(spark):
    good = dict(variant_type="correct", label_source="construction", status="labelled", is_correct=True, discard_reason=None, text="t")
    bad = {
        "ck_variant_type": dict(variant_type="odd", is_correct=None, status="needs_human_review"),
        "ck_label_source": dict(label_source="guess"),
        "ck_status": dict(status="odd"),
        "ck_constructed_label_matches_type": dict(is_correct=False),
        "ck_review_has_no_label": dict(status="needs_human_review"),
        "ck_discard_reason": dict(discard_reason="r"),
        "ck_text_iff_kept": dict(text=None),
        "ck_labelled": dict(is_correct=None),
    }
    rows = [(0, *good.values())] + [(i, *(good | change).values()) for i, change in enumerate(bad.values(), 1)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{k} {'boolean' if k == 'is_correct' else 'string'}" for k in good))
    found = {(r["id"], r["constraint"]) for r in review.violations(df, review.variant_constraints(variants.ACCEPT, variants.REJECT), "id").collect()}
    assert found == {(i, name) for i, name in enumerate(bad, 1)}


def test_balance_is_by_type_only(spark):
    rows = spark.createDataFrame([(i, "a" if i < 90 else "b" if i < 93 else "c") for i in range(100)], "id long, type string")
    types = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c"), ("h", "d")], "grp string, type string")
    kept = review.balanced(rows, types, "id", "type", 1).groupBy("type").count().collect()
    assert {r["type"]: r["count"] for r in kept} == {"a": 3, "b": 3, "c": 7}
    with pytest.raises(Exception, match="no group has the type c"):
        review.balanced(rows, types.filter("type <> 'c'"), "id", "type", 1).collect()
    import hashlib

    digest = lambda r: (hashlib.md5(f"1:{r['type']}:{r['id']}".encode()).hexdigest(), r["id"])
    for kind, n in {"a": 3, "b": 3, "c": 7}.items():
        best = sorted((r for r in rows.collect() if r["type"] == kind), key=digest)[:n]
        assert {r["id"] for r in review.balanced(rows, types, "id", "type", 1).filter(F.col("type") == kind).collect()} == {r["id"] for r in best}
    assert review.unknown_types(rows, types.filter("type <> 'c'"), "type").collect()[0]["type"] == "c"


def test_jsonl_round_trip(spark, tmp_path):
    path = tmp_path / "corpus.jsonl"
    path.write_text('{"id": "1", "title": "t", "text": "é"}\n\n{bad\n{"id": "2", "title": "u", "text": "x", "sentence_spans": [{"start": 0, "end": 1}]}\n', encoding="utf-8")
    got = evalset.read_jsonl(spark, str(path), evalset.DOCUMENT).orderBy("line_number").collect()
    assert [(r["line_number"], r["readable"], r["id"]) for r in got] == [(1, True, "1"), (3, False, None), (4, True, "2")]
    out = str(tmp_path / "out")
    evalset.write_jsonl(spark.createDataFrame([("x", "é", None)], "b string, a string, c string"), out)
    assert [r["value"] for r in spark.read.text(out).collect()] == ['{"a":"é","b":"x","c":null}']


def test_line_numbers_across_splits(spark, tmp_path):
    """A file that is read in many splits, and two files, against plain reading."""
    (tmp_path / "in").mkdir()
    for name, n in (("a.jsonl", 3000), ("b.jsonl", 700)):
        (tmp_path / "in" / name).write_text("".join("\n" if k % 7 == 0 else json.dumps({"id": f"{name}{k + 1}", "title": "t" * (k % 50), "text": "x"}) + "\n" for k in range(n)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        got = evalset.read_jsonl(spark, str(tmp_path / "in"), evalset.DOCUMENT)
        assert got.rdd.getNumPartitions() > 1
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == sum(k % 7 != 0 for n in (3000, 700) for k in range(n))
    assert all(r["id"].endswith(f"l{r['line_number']}") for r in rows)


def test_errors_where_results_would_mislead(spark):
    from quillspark.operators import evaluate

    gold = spark.createDataFrame([(1, 5)], "query_id long, chunk_id long")
    assert evaluate.require_gold(spark.createDataFrame([(1,)], "query_id long"), gold).count() == 1
    with pytest.raises(Exception, match="no gold chunk for question 2"):
        evaluate.require_gold(spark.createDataFrame([(1,), (2,)], "query_id long"), gold).collect()
    with pytest.raises(Exception, match="needs two questions"):
        evaluate.difference(spark.createDataFrame([(0.5, 1.0)], "b double, o double")).collect()


def test_json_files_and_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1",\n "question": "q"}, {"id": "2"}]', encoding="utf-8")
    assert sorted((r["id"], r["question"]) for r in evalset.read_json(spark, str(tmp_path / "a.json"), "id string, question string").collect()) == [("1", "q"), ("2", None)]
    (tmp_path / "b.json").write_text("[{]", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        evalset.read_json(spark, str(tmp_path / "b.json"), "id string").collect()
    evalset.write_report(spark.createDataFrame([("dense", 0.5, None)], "run string, rr double, z double"), str(tmp_path / "r"))
    (part,) = (tmp_path / "r").glob("part-*.json")
    assert json.loads(part.read_text()) == {"run": "dense", "rr": 0.5, "z": None}


def test_chunk_configs():
    from quillspark.operators.chunking import Config

    assert Config.parse('{"strategy": "sentence_window", "sentences_per_chunk": 2}') == Config("sentence_window", 2, 0)
    assert Config.parse({"strategy": "fixed_words", "words_per_chunk": 8, "overlap": 2}) == Config("fixed_words", 8, 2)
    for bad in ({}, {"strategy": "document", "overlap": 1}, {"strategy": "fixed_words", "sentences_per_chunk": 1}, {"strategy": "odd"}, {"strategy": "fixed_words", "words_per_chunk": 2, "overlap": 2}):
        with pytest.raises(ValueError):
            Config.parse(bad)


def test_status_and_signs(spark):
    from quillspark.operators import diagnostics

    rows = spark.createDataFrame([(1, "labelled"), (2, "discarded")], "id long, status string")
    assert [r["id"] for r in review.with_status(rows, "labelled").collect()] == [1]
    with pytest.raises(ValueError):
        review.with_status(rows, "odd")
    shown = diagnostics.signs(spark.createDataFrame([("Oslo", "It is in Oslo.", [1], [1, 2]), ("Oslo", None, [3], None)], "reference string, answer string, cited array<long>, gold array<long>"))
    assert [(r["reference_in_answer"], r["cites_gold"]) for r in shown.collect()] == [(True, True), (False, False)]


def test_signs_make_no_labels():
    """Only the report may import the signs."""
    from pathlib import Path

    root = Path(variants.__file__).parents[1]
    users = {p.name for p in root.rglob("*.py") if "diagnostics" in p.read_text(encoding="utf-8") and p.name != "diagnostics.py"}
    assert users == {"retrieval.py"}


def test_validation_names_every_problem(spark):
    docs = spark.createDataFrame([("1", "t", "abc", [(0, 2), (1, 3)], None), ("1", "t", "abc", None, None), ("", "t", "", None, None)], evalset.DOCUMENT)
    questions = spark.createDataFrame([("q", "?", "a", [("1", 0, 9)], None), ("r", "", "", [], None), ("s", "?", "a", [("9", 2, 2)], None)], evalset.QUESTION)
    found = {(r["kind"], r["id"], r["problem"]) for r in evalset.validate(docs, questions).collect()}
    assert found == {("document", "1", "sentence spans unsorted or out of range"), ("document", "1", "repeated id"), ("document", "", "empty id"), ("document", "", "empty text"), ("question", "q", "evidence past the end"), ("question", "r", "empty question"), ("question", "r", "empty answer"), ("question", "r", "no evidence"), ("question", "s", "empty evidence span"), ("question", "s", "unknown document")}


def test_paragraph_joins_without_double_space(spark):
    rows = spark.createDataFrame([(["A b.", " C.", "D.", "  ", "E. "],)], "s array<string>")
    got = rows.select(dataset.paragraph(F.col("s")).alias("p")).first()["p"]
    assert got["text"] == "A b. C. D.  E. "
    assert [got["text"][x["start"] : x["end"]] for x in got["spans"]] == ["A b.", "C.", "D.", "", "E."]


def test_paragraphs_hold_every_turn(spark):
    """The query against a plain loop over all turns of the table."""
    white = " \t\n\x0b\f\r"
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    turns = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append(r["text"])
    assert max(map(len, turns.values())) > 4
    expected = []
    for key, texts in turns.items():
        whole = ""
        for t in texts:
            gap = whole and t and t[0] not in white and whole[-1] not in white
            whole += " " * bool(gap) + t
        expected += [(key, i, t.strip(white), len(whole)) for i, t in enumerate(texts)]
    got = [tuple(r) for r in evaluation.paragraphs(spark, SF).select("conv_id", "i", "sentence", "chars").collect()]
    assert sorted(got) == sorted(expected) and len(got) == len(rows)


def test_relayout(spark):
    row = spark.createDataFrame([("i", "q", "a", "t", "l", (["x", "y"], [0, 1]), (["x"], [["s"]]))], "id string, question string, answer string, type string, level string, supporting_facts struct<title:array<string>,sent_id:array<int>>, context struct<title:array<string>,sentences:array<array<string>>>")
    got = dataset.relaid(row).first()
    assert [tuple(f) for f in got["supporting_facts"]] == [("x", 0), ("y", 1)] and got["context"][0]["sentences"] == ["s"]


def test_subset_does_not_depend_on_order(spark):
    e = evaluation.examples(spark, SF)
    assert dataset.subset(e.orderBy(F.rand(1)), 10, 5)[0] == dataset.subset(e.coalesce(1), 10, 5)[0]
    with pytest.raises(ValueError):
        dataset.subset(e, 10**6, 5)


def test_prompt_lock(spark):
    prompts = spark.createDataFrame([("a", "s", "u"), ("b", "s", "u"), ("c", "s", "u")], "name string, system string, user string")
    lock = spark.createDataFrame([("a", generation.prompt_digest("s", "u")), ("b", "0"), ("d", "0")], "name string, sha256 string")
    assert {tuple(r) for r in review.prompt_lock_audit(prompts, lock).collect()} == {("b", "changed"), ("c", "unlocked"), ("d", "missing")}
    assert json.dumps(sorted(generation.placeholders("{x} {y}"))) == '["x", "y"]'


def test_save_refuses_and_replaces_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    path = str(tmp_path / "t")
    evalset.save(df, path, by=["k"])
    with pytest.raises(Exception, match="(?i)exist"):
        evalset.save(df, path, by=["k"])
    evalset.save(spark.createDataFrame([(2, "b")], "k int, v string"), path, replace=True, by=["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v").collect()) == [(1, "a"), (2, "b")]

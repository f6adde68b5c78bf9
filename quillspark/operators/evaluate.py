"""Gold chunks by span overlap, retrieval metrics per query and in the mean, paired differences."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import tokens
from quillspark.shipping import ship_package

#: Inner tokens by which items find the texts that may contain them.
GRAM = 4
#: Bytes of all items up to which they are searched together by one automaton.
AUTOMATON_BYTES = 1 << 20
#: Bytes of the short items that are searched at a time.
SHORT_BYTES = 8 << 20


def exact_evidence(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Where an item's whole text stands in a document: query_id, doc_id, char_start, char_end (first place).

    Items of few bytes in all are searched together by one automaton, in one pass over each text, and nothing but
    what is found leaves a task. More items meet documents by their first inner tokens (the first and the last token of an item may be
    parts of a document's tokens, those between are whole ones), so no pair is compared that does not share them; those
    without an inner token go by automatons too. Null and empty items are in no document.
    """
    texts = docs.select("doc_id", "text").filter("text is not null")
    named = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("item")).filter("item <> ''")
    if (named.agg(F.sum(F.octet_length("item"))).first()[0] or 0) <= AUTOMATON_BYTES:
        return reduce(DataFrame.unionByName, _search_short(texts, named))
    asked = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("item"), tokens(F.col("text")).alias("q")).filter("item <> ''")
    asked = asked.withColumn("inner", F.slice("q", F.lit(2), F.greatest(F.size("q") - 2, F.lit(0)))).withColumn("size", F.least(F.size("inner"), F.lit(GRAM)))
    hashed = F.when(F.col("size") == GRAM, F.xxhash64(*[F.get("inner", F.lit(i)) for i in range(GRAM)])).otherwise(F.xxhash64(F.get("inner", F.lit(0))))
    asked = asked.select("query_id", "item", "size", hashed.alias("gram"))
    sizes = {r["size"] for r in asked.select("size").distinct().collect()}  # at most GRAM + 1 of them
    found = [_meet_by_inner_tokens(texts, asked.filter("size > 0"), GRAM in sizes, bool(sizes - {0, GRAM}))] if sizes - {0} else []
    if 0 in sizes or not found:
        found += _search_short(texts, asked.filter("size = 0").select("query_id", "item"))
    return reduce(DataFrame.unionByName, found)


def _meet_by_inner_tokens(texts: DataFrame, asked: DataFrame, grams: bool, single: bool) -> DataFrame:
    words = texts.select("doc_id", tokens(F.col("text")).alias("t"))
    starts = F.when(F.size("t") >= GRAM, F.sequence(F.lit(0), F.size("t") - F.lit(GRAM))).otherwise(F.array().cast("array<int>"))
    keys = [F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("t"), i + F.lit(k)) for k in range(GRAM)]))] if grams else []
    keys += [F.transform("t", lambda x: F.xxhash64(x))] if single else []
    met = words.select("doc_id", F.explode(F.array_distinct(F.concat(*keys))).alias("gram")).join(asked.select("gram", "query_id"), "gram").select("doc_id", "query_id").distinct()
    at = F.instr("text", F.col("item"))
    joined = texts.join(met, "doc_id").join(asked.select("query_id", "item"), "query_id").withColumn("at", at).filter("at > 0")
    return joined.select("query_id", "doc_id", (F.col("at") - 1).cast("int").alias("char_start"), (F.col("at") - 1 + F.length("item")).cast("int").alias("char_end"))


def _search_short(texts: DataFrame, short: DataFrame) -> list[DataFrame]:
    """Items of too few tokens, in blocks of bounded bytes, each searched by one automaton."""
    ship_package(texts.sparkSession)
    blocks, held = [[]], 0
    for r in short.toLocalIterator():
        held += len(r["item"].encode())
        if held > SHORT_BYTES:
            blocks.append([])
            held = len(r["item"].encode())
        blocks[-1].append((r["query_id"], r["item"]))

    def search(block):
        def run(batches):
            import ahocorasick

            by_item: dict[str, list] = {}
            for query_id, item in block:
                by_item.setdefault(item, []).append(query_id)
            machine = ahocorasick.Automaton()
            for item in by_item:
                machine.add_word(item, item)
            machine.make_automaton()
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    first: dict[str, int] = {}
                    for end, item in machine.iter(text):
                        first.setdefault(item, end + 1)
                    rows += [(q, doc_id, end - len(item), end) for item, end in first.items() for q in by_item[item]]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["query_id", "doc_id", "char_start", "char_end"])

        schema = "query_id long, doc_id long, char_start int, char_end int"
        return texts.mapInArrow(run, schema) if block else texts.sparkSession.createDataFrame([], schema)

    return [search(block) for block in blocks]


def gold_chunks(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct (query_id, chunk) whose span overlaps evidence of the same document.

    ``chunks`` has doc_id, position, char_start, char_end.
    """
    e = evidence.select("query_id", "doc_id", F.col("char_start").alias("e_start"), F.col("char_end").alias("e_end"))
    hit = (F.col("char_start") < F.col("e_end")) & (F.col("e_start") < F.col("char_end"))
    return chunks.join(e, "doc_id").filter(hit).select("query_id", "doc_id", "position").distinct()


def require_gold(questions: DataFrame, gold: DataFrame) -> DataFrame:
    """``gold`` with an error where a question of ``questions`` (query_id) has none."""
    found = questions.select("query_id").distinct().join(gold, "query_id", "left")
    chunk = F.when(F.col("chunk_id").isNull(), F.raise_error(F.concat(F.lit("no gold chunk for question "), F.col("query_id").cast("string"))).cast("long")).otherwise(F.col("chunk_id"))
    return found.select("query_id", chunk.alias("chunk_id"))


def per_query(rankings: DataFrame, gold: DataFrame, k: int, keys: DataFrame | None = None) -> DataFrame:
    """recall, complete and rr of each question that has gold, 0 where nothing was found.

    ``rankings`` has query_id, chunk_id, rank; ``gold`` query_id, chunk_id. ``keys`` is a small
    table of the further keys of rankings, each row of which is scored for every question.
    """
    by = keys.columns if keys is not None else []
    placed = rankings.filter(F.col("rank") <= k).groupBy("query_id", "chunk_id").agg(F.collect_list(F.struct(*by, "rank")).alias("places"))
    # gold may be a pass over the corpus, so it is used once
    each = gold.join(placed, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("n_gold"), F.flatten(F.collect_list("places")).alias("places"))
    own = F.col("places")
    if by:
        each = each.crossJoin(F.broadcast(keys))
        own = F.filter("places", lambda p: reduce(Column.__and__, [p[c] == F.col(c) for c in by]))
    joined = each.select(*by, "query_id", "n_gold", F.transform(own, lambda p: p["rank"]).alias("ranks"))
    n = F.size("ranks")
    return joined.select(*by, "query_id", F.round(n / F.col("n_gold"), 9).alias("recall"), (n == F.col("n_gold")).cast("double").alias("complete"), F.round(F.coalesce(F.lit(1.0) / F.array_min("ranks"), F.lit(0.0)), 9).alias("rr"))


def means(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean recall, completeness and reciprocal rank, with the number of questions."""
    grouped = scores.groupBy(*by) if by else scores.groupBy()
    return grouped.agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in ("recall", "complete", "rr")])


def paired(base: DataFrame, other: DataFrame, metric: str) -> DataFrame:
    """Mean difference of a metric over the same questions; see :func:`difference`."""
    return difference(base.select("query_id", F.col(metric).alias("b")).join(other.select("query_id", F.col(metric).alias("o")), "query_id"))


def difference(pairs: DataFrame) -> DataFrame:
    """Mean of o - b, its standard error and their ratio (null without error); fewer than two pairs are an error."""
    d = F.col("o") - F.col("b")
    n = F.when(F.count("*") < 2, F.raise_error(F.lit("a paired difference needs two questions")).cast("long")).otherwise(F.count("*"))
    out = pairs.agg(n.alias("n"), F.avg(d).alias("diff"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se"))
    return out.select("n", F.round("diff", 6).alias("diff"), F.round("se", 6).alias("se"), z_score(F.col("diff"), F.col("se")).alias("z"))


def against_first(scores: DataFrame, first: str, by: str = "run") -> DataFrame:
    """Every other run against the first, over the same questions and by each metric: run, metric, n, diff, se, z."""
    metrics = ("recall", "complete", "rr")
    long = scores.persist().select(by, "query_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics])).alias("m")).select(by, "query_id", "m.*")
    base = long.filter(F.col(by) == first).select("query_id", "metric", F.col("x").alias("b"))
    d = F.col("x") - F.col("b")
    n, se = F.count("*"), F.stddev_samp(d) / F.sqrt(F.count("*"))
    out = long.filter(F.col(by) != first).join(base, ["query_id", "metric"]).groupBy(by, "metric").agg(n.alias("n"), F.avg(d).alias("diff"), se.alias("se"))
    return out.select(by, "metric", "n", F.round("diff", 6).alias("diff"), F.round("se", 6).alias("se"), z_score(F.col("diff"), F.col("se")).alias("z"))


def z_score(diff: Column, se: Column) -> Column:
    return F.when(se != 0, F.round(diff / se, 4))


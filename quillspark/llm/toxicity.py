"""Toxicity scores of text restored by a noisy-channel decoder.

1. A character language model is counted over every document: 4-grams over an
   alphabet of 28 classes, so that its table has a fixed size whatever the input.
2. What looks obfuscated, that is letters mixed with leetspeak, letters spaced out and
   letters repeated, spans a lattice of possible letters. Viterbi decoding
   finds the reading that the language model and the channel's costs like best.
3. The words of the restored text, and their beginnings, are the features of a
   logistic model that labelled documents train.
"""

from __future__ import annotations

import re
from itertools import groupby
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import id_text, map_text, slices, written
from quillspark.shipping import ship_package
from quillspark.sources.tables import table

#: Classes of characters: 0 no letter, 1 to 26 a to z, 27 any other letter.
CLASSES = 28
ORDER = 4
#: Labelled rows that train the classifier, features that it keeps, rounds and strength of its fit.
SAMPLE_ROWS = 20_000
FEATURES = 2_000
LEAST_COUNT = 3
STEPS = 300
L2 = 2e-4
#: Every fifth document by crc32 of its id is held out.
FOLDS = 5
#: Lengths of the word beginnings that are features.
PREFIXES = (4, 5, 6, 7, 8)
#: Characters that are decoded at a time; a longer token is decoded piece by piece, and one over ``KEPT`` is not kept in a cache.
PIECE, KEPT = 512, 64

#: Leetspeak: what each sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e"}
#: Costs of a sign for a letter, of a separator, of one more of three or more equal letters, of the second of two, of a digit that is one.
SUBSTITUTION, SKIP, REPEAT, DOUBLE, KEEP_DIGIT = -1.0, -0.5, -0.7, -3.0, -12.0

_LEET = re.escape("".join(LEET))
#: A token that looks obfuscated: letters and signs mixed, three equal letters in a row, or letters with one separator between.
SUSPECT = re.compile(rf"(?=\S*[^\W\d_])\S*[{_LEET}]|[^\W\d_]*?([^\W\d_])\1\1|[^\W\d_](?:[.\-_*][^\W\d_]){{3,}}", re.IGNORECASE)
#: Letters and leetspeak signs that stand alone, three or more, with blanks between; two at least must be letters.
SPACED = re.compile(rf"(?<!\S)(?:[^\W\d_]|[{_LEET}])(?:[ \t]+(?:[^\W\d_]|[{_LEET}])){{2,}}(?!\S)")
TRIPLE = re.compile(r"([^\W\d_])\1{2,}")
LONG_RUN = re.compile(r"([^\W\d_])\1{3,}", re.IGNORECASE)
#: Signs around a word that tell nothing.
AROUND = ".,;:?\"'"
#: Single letters and signs with separators between: a separator there is likely nothing.
APART = re.compile(rf"(?:[^\W\d_]|[{_LEET}])(?:(?:[ \t]+|[.\-_*])(?:[^\W\d_]|[{_LEET}]))+\W?")
TOKEN = re.compile(r"\S+")
WORD = re.compile(r"[^\W\d_]+")
_CLASS_OF = np.zeros(256, dtype=np.int32)
for _k in range(26):
    _CLASS_OF[ord("a") + _k] = _CLASS_OF[ord("A") + _k] = _k + 1
_CLASS_OF[0x80:] = 27


def class_of(char: str) -> int:
    low = char.lower()
    return ord(low) - 96 if "a" <= low <= "z" else 27 if ord(char) > 127 else 0


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of the class 4-grams of texts, each between boundaries."""
    joined = ("\n\n\n" + "\n\n\n".join(t for t in texts if t) + "\n\n\n").encode("utf-8", "surrogatepass")
    x = _CLASS_OF[np.frombuffer(joined, dtype=np.uint8)]
    # one class for each character beyond ASCII: continuation bytes go
    x = x[(np.frombuffer(joined, dtype=np.uint8) & 0xC0) != 0x80]
    code = ((x[:-3] * CLASSES + x[1:-2]) * CLASSES + x[2:-1]) * CLASSES + x[3:]
    return np.bincount(code, minlength=CLASSES**ORDER)


def count_language(docs: DataFrame) -> np.ndarray:
    """Class 4-gram counts of all texts; the driver gets a table of ``CLASSES ** ORDER`` cells at most."""
    ship_package(docs.sparkSession)

    def run(batches):
        total = np.zeros(CLASSES**ORDER, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                total += gram_counts(part.column("text").to_pylist())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["gram", "n"])

    rows = docs.mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES**ORDER, dtype=np.int64)
    out[np.asarray(rows.column("gram").combine_chunks())] = np.asarray(rows.column("n").combine_chunks())
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a class after three others, smoothed by the shorter contexts."""
    full = counts.reshape((CLASSES,) * ORDER).astype(np.float64)
    p = (full.sum(axis=(0, 1, 2)) + 1) / (full.sum() + CLASSES)
    for k in (2, 1, 0):
        n = full.sum(axis=tuple(range(k)))
        p = (n + 4 * p) / (n.sum(axis=-1, keepdims=True) + 4)
    return np.log(p).astype(np.float32)


class Restorer:
    """Reads obfuscated tokens under a language model, with a bounded cache of what it read."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.cache: dict[str, str] = {}

    def options(self, token: str):
        """For each character: what it may stand for, and the cost; '' is nothing."""
        spaced = bool(APART.fullmatch(token))
        lows = [c.lower() for c in token]
        runs = [n for n in (len(list(g)) for _, g in groupby(lows)) for _ in range(n)]
        before = ""
        for low, run in zip(lows, runs, strict=True):
            again, before = low == before, low
            if low in LEET:
                yield [(c, SUBSTITUTION) for c in LEET[low]] + [(low, KEEP_DIGIT), ("", SKIP * 6)]
            elif low.isalpha():
                yield [(low, 0.0)] + ([("", REPEAT if run > 2 else DOUBLE)] if again else [])
            else:
                yield [("", SKIP if spaced else 0.0)] if spaced else [(low, 0.0), ("", SKIP)]

    def read(self, token: str) -> str:
        """The likeliest reading of a token, or of each ``PIECE`` of a longer one; four and more equal letters are read as three."""
        got = self.cache.get(token)
        if got is not None:
            return got
        whole, token = token, LONG_RUN.sub(r"\1\1\1", token)
        out = "".join([self.decode(token[k : k + PIECE]) for k in range(0, len(token), PIECE)])
        if len(whole) <= KEPT:
            if len(self.cache) > 50_000:
                self.cache.clear()
            self.cache[whole] = out
        return out

    def decode(self, token: str) -> str:
        """Viterbi over the lattice of :meth:`options`; a state is the last three classes, and none is cut."""
        model = self.model
        states = {(0, 0, 0): (0.0, None)}
        for options in self.options(token):
            fresh: dict = {}
            for (x, y, z), (score, back) in states.items():
                row = model[x, y, z]
                for char, cost in options:
                    if char:
                        c = class_of(char)
                        key, value = (y, z, c), score + cost + float(row[c])
                        back_to = (char, back)
                    else:
                        key, value, back_to = (x, y, z), score + cost, back
                    old = fresh.get(key)
                    if old is None or value > old[0]:
                        fresh[key] = (value, back_to)
            states = fresh
        ends = [(score + float(model[k][0]), k, back) for k, (score, back) in states.items()]
        back = max(ends, key=lambda e: (e[0], e[1]))[2]
        chars = []
        while back is not None:
            chars.append(back[0])
            back = back[1]
        return "".join(reversed(chars))

    def restore_token(self, token: str) -> str:
        """A token in its likeliest reading, or as it is."""
        return self.read(token) if SUSPECT.search(token) else token

    def spaced(self, text: str) -> list[re.Match]:
        """Runs of single letters and signs that may be a spaced word."""
        return [m for m in SPACED.finditer(text) if sum(map(str.isalpha, m[0])) > 1]

    def restore(self, text: str) -> str:
        """The text with what looks obfuscated in its likeliest reading."""
        parts, at = [], 0
        for m in self.spaced(text):
            parts += [text[at : m.start()], self.read(m[0])]
            at = m.end()
        return TOKEN.sub(lambda m: self.restore_token(m[0]), "".join([*parts, text[at:]]))


class Words:
    """Lower-case words of texts and of what their suspect tokens are restored to, through a bounded cache of those."""

    def __init__(self, restorer: Restorer):
        self.restorer = restorer
        self.cache: dict[str, tuple] = {}

    def restored(self, token: str) -> tuple:
        got = self.cache.get(token)
        if got is None:
            reading = self.restorer.restore_token(token)
            got = tuple(WORD.findall(reading.lower())) if reading != token else ()
            if len(token) <= KEPT:
                if len(self.cache) > 200_000:
                    self.cache.clear()
                self.cache[token] = got
        return got

    def of(self, text: str | None) -> set:
        if not text:
            return set()
        low = text.lower()
        found = set(WORD.findall(low))
        # a plain word is suspect only for three equal letters in a row
        suspects = {t for t in set(text.split()) if not (t.isalpha() or t.strip(AROUND).isalpha())}
        stop = 0
        for m in TRIPLE.finditer(low):
            if m.start() >= stop:
                start, stop = m.start(), m.end()
                while start and not low[start - 1].isspace():
                    start -= 1
                while stop < len(low) and not low[stop].isspace():
                    stop += 1
                suspects.add(low[start:stop])
        for token in suspects:
            found.update(self.restored(token))
        for m in self.restorer.spaced(text):
            found.update(WORD.findall(self.restorer.read(m[0])))
        return found


def features_of(word: str) -> list[str]:
    """A word as a whole, and its beginnings."""
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) > k)]


def fit_logistic(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Weights and bias from the places of ones in a sparse matrix, by full-batch Adam."""
    w, b = np.zeros(n_features), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, STEPS + 1):
        z = np.bincount(rows, weights=w[cols], minlength=len(labels)) + b
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.append(np.bincount(cols, weights=gap[rows], minlength=n_features) / len(labels) + L2 * w, gap.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def held_out(id_col: str = "doc_id"):
    """Whether a document's labels are kept from training."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, restorer_model) -> tuple[dict[str, float], float]:
    """Feature weights and bias, from at most ``SAMPLE_ROWS`` labelled rows that are not held out.

    The sample has the rows of least hash, so it does not depend on the order of the input.
    """
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~held_out())
    picked = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    # one text of each doc_id, however often it is repeated; the label travels in place of the id
    sample = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"), F.min("text").alias("text")).select(F.col("toxic").alias("doc_id"), "text")

    def make():
        words = Words(Restorer(restorer_model.value))
        return lambda ids, texts: {"toxic": ids.cast(pa.int32()), "words": [sorted(words.of(t)) for t in texts]}

    words = written(map_text(sample, make, "toxic int, words array<string>"), "toxic-words")
    n = words.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("n1"), F.count("*").alias("n")).first()
    n1, n0 = n["n1"], n["n"] - n["n1"]
    if not n1 or not n0:
        return {}, -4.0
    by_word = words.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
    begins = F.concat(F.array(F.concat("word", F.lit("$"))), *[F.when(F.length("word") > k, F.array(F.substring("word", 1, k))).otherwise(F.array().cast("array<string>")) for k in PREFIXES])
    stats = by_word.select(F.explode(begins).alias("feature"), "n1", "n0").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).filter(F.col("n1") + F.col("n0") >= LEAST_COUNT)
    odds = F.log((F.col("n1") + 0.5) / F.lit(float(n1))) - F.log((F.col("n0") + 0.5) / F.lit(float(n0)))
    z = F.abs(odds) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    chosen = [r["feature"] for r in stats.orderBy(F.round(z, 6).desc(), "feature").limit(FEATURES).select("feature").collect()]
    place = {f: k for k, f in enumerate(chosen)}
    shared = spark.sparkContext.broadcast(place)

    def matrix(batches):
        for batch in batches:
            found = [sorted({shared.value[f] for w in row for f in features_of(w) if f in shared.value}) for row in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "cols"])

    got = words.mapInArrow(matrix, "toxic int, cols array<int>").toArrow()
    lengths = np.asarray(got.column("cols").combine_chunks().value_lengths())
    cols = np.asarray(got.column("cols").combine_chunks().flatten())
    weights, bias = fit_logistic(np.repeat(np.arange(len(lengths)), lengths), cols, np.asarray(got.column("toxic").combine_chunks()).astype(float), len(chosen))
    return {f: float(w) for f, w in zip(chosen, weights, strict=True) if abs(w) > 1e-6}, bias


def _scorer(docs: DataFrame, labels: DataFrame):
    """Trains on ``docs`` (doc_id, text) and gives what scores parts of rows in a task."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(language_model(count_language(docs)))
    shared = spark.sparkContext.broadcast(train(docs, labels, model))

    def make():
        weights, bias = shared.value
        words = Words(Restorer(model.value))
        starts = {f.rstrip("$")[:4] for f in weights}

        def step(ids, texts):
            scores = []
            for text in texts:
                features = {x for w in words.of(text) if w[:4] in starts for x in features_of(w) if x in weights}
                z = bias + sum(weights[x] for x in sorted(features))
                scores.append(1 / (1 + exp(-max(-30.0, min(30.0, z)))))
            return {"score": scores}

        return step

    return make


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Toxicity of every text: doc_id, held_out, score, predicted.

    Labels train only on documents whose crc32 is not held out, and only texts are
    inputs of a score. Null and empty texts get the score of a text without
    features. Rows are independent: repeated rows get equal scores and null ids are
    not held out. Of a repeated doc_id one text trains. Without usable labels of both kinds every score is that of the bias. An empty table
    gives no rows; other columns are ignored.
    """
    source = id_text(docs, id_col, text_col)
    scored = map_text(source, _scorer(source, labels), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; see :func:`score_toxicity`.

    Each row is judged by its own text in place, so ids may be null or repeat, and nothing is joined.
    """
    source = id_text(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"))
    rest = rows.schema["rest"].dataType.simpleString()
    scored = map_text(rows, _scorer(source, labels), f"text string, rest {rest}, score double")
    return scored.filter("score < 0.5").select(*[F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; see :func:`score_toxicity`."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

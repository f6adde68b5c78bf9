"""Column functions over text: tokens, normalisation, value types, seeds.

Letters, digits and the underscore are spelled out as classes wherever words are
meant, because Java's own word class is ASCII only. Spans count code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shipping import ship_package

#: Runs of word characters.
WORD = r"[\p{L}\p{N}_]+"
#: Bounds of a whole word.
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

# The month names of the two date formats, and the particles that a name may hold inside.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
PARTICLES = ("of", "the", "de", "von", "van", "la", "le", "du", "del", "da", "di", "der")

# The patterns of strictly typed values.
YEAR = r"(?:1[0-9]{3}|20[0-9]{2})"
_MONTH = "(?:" + "|".join(MONTHS) + ")"
_DAY = r"(?:[1-9]|[12][0-9]|3[01])"
DATE_MDY = rf"{_MONTH} {_DAY}, [0-9]{{4}}"
DATE_DMY = rf"{_DAY} {_MONTH} [0-9]{{4}}"
NUMBER = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?: [A-Za-z][A-Za-z%²³]*[0-9]?)?"
NAME = r"(?:[A-Z][\p{L}\p{N}_'’.&-]*|[IVXLC]+)"
ENTITY = rf"{NAME}(?:\s+(?:{NAME}|{'|'.join(PARTICLES)}))*"

#: Characters that normalisation drops.
PUNCTUATION = r"""[!-/:-@\[-`{-~]"""


def tokens(text: Column) -> Column:
    """Lower-case word tokens, in order; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def lowered(text: Column) -> Column:
    """The text whose words :func:`word_finder` finds."""
    return F.lower(F.coalesce(text, F.lit("")))


def word_patterns(spark: SparkSession) -> tuple[str, str]:
    """Python patterns of the first character from which on Python's word class is not that of ``WORD``, and of ``WORD`` itself.

    Both classes hold letters, digits and the underscore, but of different Unicode versions. So the class is read
    from the engine, once for each Spark application.
    """
    sc = spark.sparkContext
    if not hasattr(sc, "_quillspark_words"):
        every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
        found = spark.createDataFrame([("".join(every),)], "s string").select(F.regexp_extract_all("s", F.lit(WORD), F.lit(0)).alias("runs")).first()["runs"]
        held = set("".join(found))
        odd = next((c for c in every if (re.match(r"\w", c) is not None) != (c in held)), None)
        ranges = "".join(f"{re.escape(a)}-{re.escape(b)}" for run in found for a, b in _ranges(run))
        sc._quillspark_words = (f"[{re.escape(odd)}-\U0010ffff]" if odd else "(?!)", f"[{ranges}]+")
    return sc._quillspark_words


def _ranges(run: str) -> list[tuple[str, str]]:
    """First and last of consecutive characters; a run may span the surrogates, which no text holds."""
    cuts = [i for i in range(1, len(run)) if ord(run[i]) != ord(run[i - 1]) + 1]
    return [(run[a], run[z - 1]) for a, z in zip([0, *cuts], [*cuts, len(run)], strict=True)]


def word_finder(patterns: tuple[str, str]) -> Callable[[str], list[str]]:
    """A Python function that gives the tokens of a text that :func:`lowered` has lowered, the same as :func:`tokens`."""
    plain, high, exact = re.compile(r"\w+").findall, re.compile(patterns[0]).search, re.compile(patterns[1]).findall
    return lambda text: exact(text) if high(text) else plain(text)


@cache
def word_table(patterns: tuple[str, str]) -> np.ndarray:
    """Of every code point whether it is a word character, by :func:`word_patterns`."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.zeros(0x110000, dtype=bool)
    for run in re.finditer(patterns[1], every):
        table[ord(every[run.start()]) : ord(every[run.end() - 1]) + 1] = True
    return table


def words_of(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts in order, and how many each has: what :func:`word_finder` finds, cut from the UTF-8 bytes of all texts at once.

    ``table`` is that of :func:`word_table`; no text is null.
    """
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw, bounds = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]
    word = np.concatenate([table[:128], np.zeros(128, dtype=bool)])[raw]
    first = np.flatnonzero(raw >= 0xC0)  # of several bytes
    size = 2 + (raw[first] >= 0xE0) + (raw[first] >= 0xF0)
    for n in (2, 3, 4):
        places = first[size == n]
        point = raw[places].astype(np.int64) & (0xFF >> (n + 1))
        for i in range(1, n):
            point = point << 6 | raw[places + i] & 0x3F
        word[(places[table[point], None] + np.arange(n)).ravel()] = True
    # a token starts at a word byte after none, and no token goes on from one text to the next
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[bounds] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    stops = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    ends = np.concatenate([[0], np.cumsum(stops - starts)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(raw[word])), np.diff(np.searchsorted(starts, bounds))


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, rf"{BEFORE}(?:a|an|the){AFTER}", " "), r"\s+", " "))


def contains_answer(answer: Column, evidence: Column) -> Column:
    """Whether the normalised evidence has the normalised answer as whole words; an empty answer is in nothing."""
    a = normalize_answer(answer)
    return F.coalesce((a != "") & F.concat(F.lit(" "), normalize_answer(evidence), F.lit(" ")).contains(F.concat(F.lit(" "), a, F.lit(" "))), F.lit(False))


def value_type(value: Column) -> Column:
    """year, date, number, entity, or null: the type whose strict pattern takes the whole value."""
    v = F.trim(value)
    entity = v.rlike(f"^{ENTITY}$") & F.regexp_extract(v, r"(\S+)$", 1).rlike(f"^{NAME}$") & (F.size(F.split(v, r"\s+")) <= 6)
    return F.when(v.rlike(f"^{YEAR}$"), "year").when(v.rlike(f"^(?:{DATE_MDY}|{DATE_DMY})$"), "date").when(v.rlike(f"^{NUMBER}$"), "number").when(entity, "entity")


def strip_disambiguation(title: Column) -> Column:
    """A title without a trailing note in parentheses."""
    return F.trim(F.regexp_replace(title, r"\s*\([^)]*\)\s*$", ""))


def lead(answer: Column) -> Column:
    """An answer as an opening sentence, its end mark not doubled."""
    a = F.trim(answer)
    return F.when(a.rlike(r"[.!?]$"), a).otherwise(F.concat(a, F.lit(".")))


def count_value(text: Column, value: Column) -> Column:
    """Whole-word occurrences of a value, in any case."""
    pattern = F.concat(F.lit(rf"(?iu){BEFORE}\Q"), F.trim(value), F.lit(rf"\E{AFTER}"))
    return F.regexp_count(text, pattern)


def replace_value(text: Column, value: Column, replacement: Column) -> Column:
    """Every whole-word occurrence of a value replaced; the replacement is taken literally."""
    pattern = F.concat(F.lit(rf"(?iu){BEFORE}\Q"), F.trim(value), F.lit(rf"\E{AFTER}"))
    literal = F.regexp_replace(replacement, r"([\\$])", r"\\$1")
    return F.regexp_replace(text, pattern, literal)


def shortened(text: Column, width: int) -> Column:
    """A text of at most ``width`` characters, the last an ellipsis where it was cut."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def seed_of(*parts: Column) -> Column:
    """The first 8 bytes of the SHA-256 of the parts joined by colons, as an unsigned decimal."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Price of a call from prices per million tokens; null unless all four are known."""
    return (tokens_in * price_in + tokens_out * price_out) / F.lit(1e6)


def hashed_vector(token_list: Column, dim: int = 64) -> Column:
    """Unit vector of token counts by the last byte of each token's md5; no tokens give the first axis.

    ``dim`` must be a power of two of at most 128.
    """
    sign = lambda bucket: F.char(bucket + F.lit(48))
    bucket = lambda t: F.pmod(F.conv(F.right(F.md5(t.cast("binary")), F.lit(2)), 16, 10).cast("int"), F.lit(dim))
    # one sign a token, so a count is what a native replacement takes away; arrays of one bind the signs and the counts
    signs = F.array(F.array_join(F.transform(token_list, lambda t: sign(bucket(t))), ""))
    axes = F.sequence(F.lit(0), F.lit(dim - 1))
    counts = F.transform(signs, lambda s: F.transform(axes, lambda b: (F.length(s) - F.length(F.replace(s, sign(b), F.lit("")))).cast("double")))
    measured = F.transform(counts, lambda c: F.struct(c.alias("c"), F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y * y)).alias("n")))
    unit = F.transform(measured, lambda s: F.transform(s["c"], lambda x: x / s["n"]))
    return F.when(F.size(token_list) == 0, F.transform(axes, lambda b: (b == 0).cast("double"))).otherwise(F.get(unit, F.lit(0)))


def hashed_vectors(rows: DataFrame, key: str, dim: int = 64) -> DataFrame:
    """The key (long) of each row and ``vector``, what :func:`hashed_vector` gives for the tokens of its text, by a digest for each distinct token of a task."""
    patterns = word_patterns(ship_package(rows.sparkSession))

    def run(batches):
        words, axes = word_finder(patterns), Axes(dim)
        for batch in batches:
            counts = np.zeros((batch.num_rows, dim))
            for i, text in enumerate(batch.column(1).to_pylist()):
                counts[i] = np.bincount(np.frombuffer(bytes(map(axes.__getitem__, words(text))), np.uint8), minlength=dim)
            empty = ~counts.any(axis=1)
            counts[empty, 0] = 1.0
            unit = counts / np.sqrt((counts * counts).sum(axis=1))[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, unit.size + 1, dim, dtype=np.int32), unit.reshape(-1))], names=[key, "vector"])

    return rows.select(F.col(key).cast("long"), lowered(F.col("text"))).mapInArrow(run, f"{key} long, vector array<double>")


class Axes(dict):
    """The axis of each token, remembered up to a number of tokens."""

    LIMIT = 500_000

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[token] = axis = hashlib.md5(token.encode()).digest()[-1] % self.dim
        return axis

"""Chunks as character spans: whole documents, windows of words, windows of sentences."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.shipping import ship_package

_SPANS = "array<struct<start:int,end:int>>"
#: White space as Python's text functions have it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"

# Abbreviations after which a full stop does not end a sentence, and initials.
ABBREVIATIONS = {
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "mt", "vs", "etc", "inc", "ltd",
    "co", "corp", "no", "vol", "fig", "e.g", "i.e", "approx", "jan", "feb", "mar", "apr",
    "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
}
INITIALS = r"[A-Za-z](?:\.[A-Za-z])*"

#: A run of word characters and full stops that ends with a full stop or before another end mark, closing signs, white space.
_END = re.compile(r"""(?<![\w.])(?P<run>[\w.]*+)(?:(?<=\.)|(?P<mark>[!?]))["'”’)\]]*\s+(?=(?P<next>\S?))""")
_INNER = re.compile(r"\S(?:.*\S)?", re.DOTALL)


@dataclass(frozen=True)
class Config:
    """How to chunk: document, fixed_words or sentence_window, with a window's size and overlap in units."""

    strategy: str
    size: int = 1
    overlap: int = 0

    def __post_init__(self):
        if self.strategy not in ("document", "fixed_words", "sentence_window"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.size < 1 or not 0 <= self.overlap < self.size:
            raise ValueError("a window needs size >= 1 and 0 <= overlap < size")

    @classmethod
    def parse(cls, given: dict | str) -> Config:
        """From JSON or its dictionary; a strategy takes the keys that it has a use for and no others."""
        given = dict(json.loads(given) if isinstance(given, str) else given)
        size = {"fixed_words": "words_per_chunk", "sentence_window": "sentences_per_chunk"}.get(given.get("strategy"))
        strange = set(given) - {"strategy"} - ({size, "overlap"} if size else set())
        if strange or "strategy" not in given:
            raise ValueError(f"not a chunking: {sorted(strange) or 'no strategy'}")
        return cls(given["strategy"], given.get(size, 1) if size else 1, given.get("overlap", 0))

    @property
    def label(self) -> str:
        return self.strategy if self.strategy == "document" else f"{self.strategy}(size={self.size},overlap={self.overlap})"


def trimmed_span(text: Column) -> Column:
    """The span of a text without outer white space, or null if nothing is left."""
    left = F.length(text) - F.length(F.regexp_replace(text, f"^{SPACE}+", ""))
    right = F.length(F.regexp_replace(text, f"{SPACE}+$", ""))
    return F.when(left < right, F.struct(left.cast("int").alias("start"), right.cast("int").alias("end")))


def word_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words, natively, where no word is in three of them (overlap <= size - overlap).

    The text is cut into blocks of ``size - overlap`` words; a window is a block and the first
    ``overlap`` words of the next. So only blocks are added up, not words.
    """
    step = size - overlap
    word = f"{SPACE}*{NOT_SPACE}++"
    blocks = F.regexp_extract_all(text, F.lit(f"(?:{word}){{1,{step}}}"), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,z:int,o:int,n:int>>").alias("b"))

    def add(acc, x):
        lead = F.length(x) - F.length(F.regexp_replace(x, f"^{SPACE}+", ""))
        over = F.length(F.regexp_extract(x, f"^(?:{word}){{1,{overlap}}}", 0)) if overlap else F.lit(0)
        last = F.size(F.regexp_extract_all(x, F.lit(f"{NOT_SPACE}++"), F.lit(0)))
        return F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["b"], F.array(F.struct((acc["at"] + lead).alias("a"), (acc["at"] + F.length(x)).alias("z"), (acc["at"] + over).alias("o"), last.alias("n")))).alias("b"))

    measured = F.aggregate(blocks, zero, add, lambda acc: acc["b"])

    def spans(b):
        m = F.size(b)
        covered = (m > 1) & (F.get(b, m - 1)["n"] <= overlap)
        kept = F.slice(b, F.lit(1), F.when(covered, m - 1).otherwise(m))
        return F.transform(kept, lambda x, i: F.struct(x["a"].alias("start"), (F.coalesce(F.get(b, i + 1)["o"], x["z"]) if overlap else x["z"]).alias("end")))

    return F.get(F.transform(F.array(measured), spans), F.lit(0)).cast(_SPANS)


def windows(units: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` units, each ``size - overlap`` after the last, up to the first that covers the last unit."""
    step = size - overlap
    n = F.size(units)
    count = F.lit(1) + F.greatest(F.lit(0), F.ceil((n - F.lit(size)) / F.lit(step)).cast("int"))
    # the outer array binds the units, which are computed once
    made = F.transform(
        F.array(F.struct(units.alias("u"), count.alias("c"))),
        lambda b: F.transform(
            F.sequence(F.lit(0), b["c"] - F.lit(1)),
            lambda i: F.struct(F.get(b["u"], i * F.lit(step))["start"].alias("start"), F.get(b["u"], F.least(i * F.lit(step) + F.lit(size), F.size(b["u"])) - F.lit(1))["end"].alias("end")),
        ),
    )
    return F.when(n > 0, F.get(made, F.lit(0))).otherwise(F.array().cast(_SPANS))


def ends_sentence(end: re.Match) -> bool:
    """Whether a possible end is one: no lower-case letter follows, and its full stop is not that of an abbreviation or of initials."""
    word = end["run"].removesuffix(".")
    return not end["next"].islower() and (end["mark"] is not None or not (word.lower() in ABBREVIATIONS or re.fullmatch(INITIALS, word)))


def split_sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text, without outer white space."""
    cuts = [0, *(m.start("next") for m in _END.finditer(text) if ends_sentence(m)), len(text)]
    return [found.span() for a, b in pairwise(cuts) if (found := _INNER.search(text, a, b))]


def word_units(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\S+", text)]


def with_units(docs: DataFrame, units, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None) -> DataFrame:
    """doc_id, text, units: the document's own spans where it has any, else those of a Python function of the text, on Arrow batches."""
    ship_package(docs.sparkSession)

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [own or [{"start": a, "end": b} for a, b in units(t or "")] for t, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], names=["doc_id", "text", "units"])

    own = (F.col(spans_col) if spans_col else F.lit(None)).cast(_SPANS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), own.alias("own"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, units {_SPANS}")


def chunk(docs: DataFrame, config: Config, spans_col: str | None = None) -> DataFrame:
    """doc_id, position, char_start, char_end, text of every chunk, where text[start:end] is the chunk.

    ``spans_col`` names sentence spans of the documents' own; where they are null or empty the splitter is used.
    """
    if config.strategy == "document":
        spanned = docs.select("doc_id", "text", F.array_compact(F.array(trimmed_span(F.col("text")))).alias("spans"))
    elif config.strategy == "fixed_words":
        if 2 * config.overlap <= config.size:
            spanned = docs.select("doc_id", "text", word_windows(F.col("text"), config.size, config.overlap).alias("spans"))
        else:
            spanned = with_units(docs, word_units).select("doc_id", "text", windows(F.col("units"), config.size, config.overlap).alias("spans"))
    else:
        split = with_units(docs, split_sentences, spans_col=spans_col).withColumnRenamed("units", "sentences")
        spanned = split.select("doc_id", "text", windows(F.col("sentences"), config.size, config.overlap).alias("spans"))
    chunks = spanned.select("doc_id", "text", F.posexplode("spans").alias("position", "s"))
    return chunks.select("doc_id", "position", F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"))

"""Token counts by a two-tier lookup, without any shuffle of pre-tokens.

A text is cut into the tokenizer's pre-tokens, and has the sum of their tokens. (Around uncommon
characters whole units without white space take their place; each holds whole pre-tokens.)

* Tier 1 is a broadcast hash table of the lengths of frequent pre-tokens: those that a bounded sample of texts has most
  often, and every entry of the vocabulary that is one pre-token, for a byte-level vocabulary lists what
  its own corpus had most often. Its size is bounded by both. The sample decides only which lengths are looked
  up and which are worked out; every count is of whole texts.
* Tier 2 is a cache in each Python worker, bounded in entries and in the length
  of a pre-token; what it lacks the library encodes, many pre-tokens at a call.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import id_text, map_text
from quillspark.llm.pretokens import LETTERS, ODD, UNITS, spaced_parts
from quillspark.llm.vocab import load_tokenizer
from quillspark.sources.tables import table

TOKENIZER = "byte_bpe_50k.json"
OVER_LIMIT = 512
#: The letter by which the vocabulary shows a space.
SPACE = "\u0120"

__all__ = ["ODD", "UNITS", "count_tokens", "frequent_pretokens", "op1_token_counts"]

#: Texts sampled for the table of frequent pre-tokens, their greatest length, and the table's share of what they hold.
SAMPLE_TEXTS, SAMPLE_CHARS, FREQUENT = 1_000, 16_384, 1 << 16
#: Missing pre-tokens that are encoded as one text.
JOINED = 64
#: Bounds of a worker's cache: entries, and characters of a unit that is kept.
CACHE_ENTRIES = 1 << 20
CACHE_CHARS = 64

WORD = re.compile(f" [{LETTERS}]+")

_cache: dict[str, dict[str, int]] = {}


def frequent_pretokens(texts: list[str], name: str = TOKENIZER) -> dict[str, int]:
    """Tier 1: lengths of the most frequent pre-tokens of the sampled texts and of the vocabulary's."""
    tokenizer = load_tokenizer(name)
    shown = _byte_letters()
    parts = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        if all(c in shown for c in entry):
            try:
                text = bytes(shown[c] for c in entry).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if spaced_parts(text) == [text] and not ODD.search(text):
                parts.append(text)
    counts = Counter(p for text in texts if not ODD.search(text) for p in spaced_parts(text) if len(p) <= CACHE_CHARS)
    parts = list(dict.fromkeys(parts + [p for p, n in counts.most_common(FREQUENT) if n > 1]))
    return dict(zip(parts, _lengths(tokenizer, parts), strict=True))


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary shows each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _lengths(tokenizer, texts: list[str]) -> list[int]:
    return [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _miss_lengths(tokenizer, starts_word: np.ndarray, parts: list[str]) -> dict[str, int]:
    """Lengths of missing pre-tokens.

    Those of letters after one space are encoded many at a call: joined, they are cut as they were, and
    only the first token of each begins with the space.
    """
    words = [p for p in parts if WORD.fullmatch(p)]
    found = {}
    for at in range(0, len(words), 1 << 14):
        some = words[at : at + (1 << 14)]
        encoded = tokenizer.encode_batch_fast(["".join(some[k : k + JOINED]) for k in range(0, len(some), JOINED)], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, dtype=np.int64) for x in encoded])
        first = np.flatnonzero(starts_word[ids])
        found.update(zip(some, np.diff(np.append(first, len(ids))).tolist(), strict=True))
    rest = [p for p in parts if p not in found]
    return found | dict(zip(rest, _lengths(tokenizer, rest), strict=True))


def count_tokens(docs: DataFrame, name: str = TOKENIZER, limit: int = OVER_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as an empty one (no bytes, no tokens). Special strings
    inside a text are handled as the library does by default. Rows are
    independent: repeated rows and null ids are kept as they are, an empty table
    gives no rows, and other columns are ignored.
    """
    source = id_text(docs, id_col, text_col)
    sample = [r["text"] for r in source.select("text").filter(F.length("text") <= SAMPLE_CHARS).limit(SAMPLE_TEXTS).collect()]
    shared = docs.sparkSession.sparkContext.broadcast(frequent_pretokens(sample, name))

    def make():
        tokenizer = load_tokenizer(name)
        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        odd = re.compile("|".join([ODD.pattern, *map(re.escape, specials)]))  # the library cuts a text at special strings first
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        starts_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        starts_word[[i for t, i in vocabulary.items() if t.startswith(SPACE)]] = True
        frequent, cache = shared.value, _cache.setdefault(name, {})

        def step(ids, texts):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
            known = frequent.get
            counts, whole, missing = [], [], {}
            for k, text in enumerate(texts):
                if not text:
                    counts.append(0)
                elif odd.search(text):
                    counts.append(0)
                    whole.append(k)
                else:
                    total = 0
                    for part in spaced_parts(text):
                        c = known(part) or cache.get(part)
                        if c is None:
                            missing.setdefault(part, []).append(k)
                        else:
                            total += c
                    counts.append(total)
            if missing:
                found = _miss_lengths(tokenizer, starts_word, list(missing))
                for part, rows in missing.items():
                    c = found[part]
                    if len(part) <= CACHE_CHARS:
                        cache[part] = c
                    for k in rows:
                        counts[k] += c
            for k, c in zip(whole, _lengths(tokenizer, [texts[k] for k in whole]), strict=True):
                counts[k] = c
            return {"doc_id": ids, "n_tokens": np.array(counts, dtype=np.int64), "n_bytes": np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64)}

        return step

    counted = map_text(source, make, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document; see :func:`count_tokens`."""
    return count_tokens(table(spark, sf_dir, "documents"))

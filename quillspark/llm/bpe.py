"""Byte-level BPE by merge replay over the distinct pre-tokens of a corpus slice.

The distinct pre-tokens of a slice of the corpus that a worker does not know yet are laid out as one
sequence of byte tokens, with an inverted index from the rank of a pair to its positions in all words.
Every merge is applied in rank order to all its positions, and looks up only the pairs of the touched
neighbours anew. Slices are parts of Arrow batches, so no pre-token is shuffled and a lost task is
encoded again from its own rows.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import id_text, map_text
from quillspark.llm.pretokens import ODD, OTHER, spaced_parts
from quillspark.llm.vocab import tokenizer_path
from quillspark.shipping import ship_package
from quillspark.sources.tables import table

RANKS = "byte_bpe_multi_50k.tiktoken"
PATTERN = regex.compile(public_tokenizers.PATTERN)

#: Bounds of a worker's cache: entries, and characters of a unit that is kept.
CACHE_ENTRIES = 1 << 17
CACHE_CHARS = 48
#: Ids that are decoded at a time.
DECODE_IDS = 1 << 19

_caches: dict[str, dict[str, bytes]] = {}


class Bpe:
    """A rank file: encoding by merge replay, decoding by a table of bytes."""

    NONE = np.int64(1) << 40

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        # every pair of tokens whose bytes together are a token: at most as many as the vocabulary has bytes
        pairs = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        codes = np.array([(a << 32) | b for a, b in pairs] or [-1], dtype=np.int64)
        order = np.argsort(codes)
        self.codes, self.results = codes[order], np.array(list(pairs.values()) or [0], dtype=np.int64)[order]
        left, right = self.codes >> 32, self.codes & 0xFFFFFFFF
        #: Tokens that take part in a pair of a lower rank than their own.
        self.delicate = set(left[self.results < left].tolist()) | set(right[self.results < right].tolist())
        # ranks whose pairs may overlap: one of them ends with what another begins with
        ends, starts = np.stack([self.results, right], axis=1), np.stack([self.results, left], axis=1)
        self.overlapping = {r for r, _ in set(map(tuple, ends.tolist())) & set(map(tuple, starts.tolist()))}

    def ranks_at(self, code: np.ndarray) -> np.ndarray:
        """Rank of each pair, left and right in one code, or NONE."""
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.results[at], self.NONE)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The same of many pairs of few kinds."""
        code, back = np.unique((left << 32) | right, return_inverse=True)
        return self.ranks_at(code)[back]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian uint32, by replaying the merges over all words together.

        Ranks are ids, so a pair merges to the id that is its rank. The index holds the positions of each
        rank's pairs: those of the bytes in one sorted array, later ones in lists. Ranks wait in a heap. A rank's
        merges are applied to all its positions at once, and only the pairs of the touched neighbours are looked up
        anew. Where a merge may make a pair of a lower rank, the rest of that word's positions
        is put off, because in that word the lower rank comes first.
        """
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ids = np.array(self.single, dtype=np.int64)[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(ids)
        if not n:
            return [b""] * len(words)
        word = np.repeat(np.arange(len(words)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lengths)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        rank = np.full(n, self.NONE)
        inside = np.flatnonzero(after >= 0)
        rank[inside] = self.ranks_of(ids[inside], ids[inside + 1])
        order = inside[np.argsort(rank[inside], kind="stable")]
        ranks, first = np.unique(rank[order], return_index=True)
        stop = np.append(first[1:], len(order))
        initial = {r: (a, b) for r, a, b in zip(ranks.tolist(), first.tolist(), stop.tolist(), strict=True) if r < self.NONE}
        later: dict[int, list[int]] = {}
        heap = list(initial)
        heapq.heapify(heap)
        while heap:
            now = heapq.heappop(heap)
            at = np.array(later.pop(now, ()), dtype=np.int64)
            if now in initial:
                a, b = initial.pop(now)
                at = np.concatenate([order[a:b], at]) if len(at) else order[a:b]
            at = at[rank[at] == now]
            if not len(at):
                continue
            if now in self.overlapping or now in self.delicate:
                every = at = np.sort(at)
                chain = np.append(False, at[1:] == after[at[:-1]])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(chain, 0, place))) % 2 == 0]
                if now in self.delicate:
                    prev, beyond = before[at], after[after[at]]
                    low = (self.ranks_at(ids[prev] << 32 | now) < now) & (prev >= 0) | (self.ranks_at(now << 32 | ids[beyond]) < now) & (beyond >= 0) | (self.ranks_at(np.array([now << 32 | now]))[0] < now)
                    # per word up to the first merge that may make a lower rank
                    stop = np.full(len(words), n)
                    np.minimum.at(stop, word[at[low]], at[low])
                    at, rest = at[at <= stop[word[at]]], every[every > stop[word[every]]]
                    if len(rest):
                        later[now] = rest.tolist()
                        heapq.heappush(heap, now)
            right = after[at]
            beyond = after[right]
            ids[at] = now
            ids[right] = -1
            rank[right] = self.NONE
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            rank[at] = -1
            prev = before[at]
            prev = prev[prev >= 0]
            touched = np.concatenate([at, prev[rank[prev] >= 0]])
            rank[touched] = self.NONE
            touched = touched[after[touched] >= 0]
            found = self.ranks_at(ids[touched] << 32 | ids[after[touched]])
            touched, found = touched[found < self.NONE], found[found < self.NONE]
            rank[touched] = found
            for r, i in zip(found.tolist(), touched.tolist(), strict=True):
                if r in later:
                    later[r].append(i)
                else:
                    later[r] = [i]
                    if r not in initial:
                        heapq.heappush(heap, r)
        alive = ids >= 0
        data = ids[alive].astype("<u4").tobytes()
        cuts = (np.cumsum(np.bincount(word[alive], minlength=len(words))) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    @functools.cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes in one array, and each id's place and length in it; unknown ids have length -1."""
        size = max(self.bytes_of) + 1
        length = np.full(size, -1, dtype=np.int64)
        for i, b in self.bytes_of.items():
            length[i] = len(b)
        start = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
        return np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), dtype=np.uint8), start, length

    def decode(self, ids) -> bytes:
        """The bytes of a sequence of ids."""
        return self.decode_many(np.asarray(ids, dtype=np.int64), np.array([0, len(ids)]))[0]

    def decode_many(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each range of ids between neighbouring bounds."""
        data, start, length = self._table
        if len(ids) and (ids.min() < 0 or ids.max() >= len(length) or (length[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        n = length[ids]
        ends = np.concatenate(([0], np.cumsum(n)))
        out = data[np.repeat(start[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cuts = ends[bounds].tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@functools.lru_cache(maxsize=2)
def load_ranks(name: str) -> Bpe:
    with open(tokenizer_path(name), "rb") as lines:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


class TextEncoder:
    """Ids of whole texts, through a bounded cache of units."""

    def __init__(self, name: str):
        self.bpe = load_ranks(name)
        self.cache = _caches.setdefault(name, {})

    def learn(self, missing: set[str]) -> None:
        """Replay the merges over pre-tokens, and units of several, that the cache lacks."""
        cache = self.cache
        units = {u: PATTERN.findall(u) for u in missing if OTHER.search(u)}
        words = sorted({w for w in missing if w not in units}.union(*units.values()))
        fresh = dict(zip(words, self.bpe.encode_words([w.encode("utf-8") for w in words]), strict=True))
        cache.update((w, fresh[w]) for w in missing if w not in units)
        cache.update((u, b"".join([fresh[w] for w in parts])) for u, parts in units.items())

    def cut(self, text: str) -> list[str]:
        return PATTERN.findall(text) if ODD.search(text) else spaced_parts(text)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text; none for a null one."""
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        split = [self.cut(t) if t else [] for t in texts]
        missing = {w for parts in split for w in parts if w not in cache}
        self.learn(missing)
        out = [np.frombuffer(b"".join(map(cache.__getitem__, parts)), "<u4") for parts in split]
        for word in missing:
            if len(word) > CACHE_CHARS:
                del cache[word]
        return out


def encode_texts(docs: DataFrame, name: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text: doc_id, ids array<int>, n_tokens.

    A null or empty text has no ids. Rows are independent: repeated rows and
    null doc_ids are kept, an empty table gives no rows, other columns are ignored.
    """

    def make():
        encoder = TextEncoder(name)

        def step(ids, texts):
            encoded = encoder.encode(texts)
            lengths = np.array([len(x) for x in encoded], dtype=np.int64)
            flat = np.concatenate(encoded).astype(np.int32) if encoded else np.empty(0, np.int32)
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            return {"doc_id": ids, "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), "n_tokens": lengths}

        return step

    return map_text(id_text(docs, id_col, text_col), make, "doc_id long, ids array<int>, n_tokens long")


def decode_ids(encoded: DataFrame, name: str = RANKS, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode id sequences: doc_id, ids, data binary; a null sequence is an empty one."""


    ship_package(encoded.sparkSession)

    def run(batches):
        bpe = load_ranks(name)
        for batch in batches:
            lists = batch.column(1)
            ends = np.concatenate(([0], np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64).cumsum()))
            at, n = 0, batch.num_rows
            while at < n:  # parts of few enough ids
                stop = min(max(int(np.searchsorted(ends, ends[at] + DECODE_IDS, side="right")) - 1, at + 1), n)
                part = lists.slice(at, stop - at)
                data = bpe.decode_many(np.asarray(part.flatten()).astype(np.int64), ends[at : stop + 1] - ends[at])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), part, pa.array(data, pa.binary())], names=["doc_id", "ids", "data"])
                at = stop

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, data binary")


def round_trip(docs: DataFrame, name: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode its ids in the same task: doc_id, ids, data; see :func:`encode_texts`.

    One pass of Python instead of two; the bytes come from the ids alone.
    """

    def make():
        encoder = TextEncoder(name)

        def step(ids, texts):
            encoded = encoder.encode(texts)
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in encoded]))).astype(np.int64)
            flat = np.concatenate(encoded) if encoded else np.empty(0, np.uint32)
            data = []
            at, n = 0, len(encoded)
            while at < n:
                stop = min(max(int(np.searchsorted(bounds, bounds[at] + DECODE_IDS, side="right")) - 1, at + 1), n)
                data += encoder.bpe.decode_many(flat[bounds[at] : bounds[stop]].astype(np.int64), bounds[at : stop + 1] - bounds[at])
                at = stop
            return {"doc_id": ids, "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32))), "data": pa.array(data, pa.binary())}

        return step

    return map_text(id_text(docs, id_col, text_col), make, "doc_id long, ids array<int>, data binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids and give the digests of both."""
    decoded = round_trip(table(spark, sf_dir, "documents"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))

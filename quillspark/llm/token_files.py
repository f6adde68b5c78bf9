"""Token ids in fixed-width bit-packed files.

A file holds the ids of a range of documents, in ascending order of doc_id, each
id in the fewest bits that the vocabulary needs:

====================  =====================================================
packed area           blocks; id k of a block takes the bits
                      ``k * bits`` to ``(k + 1) * bits - 1``, low bit first
document table        doc_id int64 x documents (those without one come first and
                      have 0), then the first id of each document and, last, the
                      number of ids: uint64
block table           byte offset of each block in the packed area: uint64
footer, 56 bytes      6 little-endian uint64: bits an id, ids, documents, those
                      without a doc_id, ids a block, bytes of the packed area;
                      then the magic ``QSTOKEN2``
====================  =====================================================

Blocks start at whole bytes, so numpy unpacks one, or many, at a time, and any
id is read from one block. The tables come last, so a writer holds one block of ids.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import arrow_schema, id_text, release_memory, shared_folder, slices
from quillspark.llm.pretokens import ODD, OTHER, plain_parts
from quillspark.llm.vocab import load_tokenizer
from quillspark.shipping import ship_package
from quillspark.sources.tables import table

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 1 << 16
MAGIC = b"QSTOKEN2"
FOOTER = 56

CACHE_ENTRIES = 1 << 20
CACHE_CHARS = 64
#: Missing words that are encoded as one text.
JOINED = 64

_cache: dict[str, dict[str, bytes]] = {}


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, low bit first, to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack(data, n: int, bits: int) -> np.ndarray:
    """``n`` ids of a block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    out = np.zeros((n, 32), dtype=np.uint8)
    out[:, :bits] = flat
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


class TokenWriter:
    """Writes one file: the ids as they come, block by block, then the tables."""

    def __init__(self, out, bits: int, block: int = BLOCK_IDS):
        self.out, self.bits, self.block = out, bits, block
        self.rest = np.empty(0, dtype="<u4")
        self.doc_ids, self.lengths, self.offsets = [], [], [0]
        self.nulls = self.n_ids = 0

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nulls: int = 0) -> None:
        """More documents, in order, with their numbers of ids and the ids of all of them."""
        self.doc_ids.append(doc_ids.astype("<i8"))
        self.lengths.append(lengths.astype("<u8"))
        self.nulls += nulls
        self.n_ids += len(ids)
        ids = np.concatenate([self.rest, ids]) if len(self.rest) else ids
        full = len(ids) // self.block * self.block
        for at in range(0, full, self.block):
            self._put(ids[at : at + self.block])
        self.rest = ids[full:].copy()

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> tuple[np.ndarray, int]:
        """Write the rest; the documents' ids and the number of token ids."""
        if len(self.rest):
            self._put(self.rest)
        doc_ids = np.concatenate(self.doc_ids)
        self.out.write(doc_ids.tobytes())
        self.out.write(np.concatenate(([0], np.cumsum(np.concatenate(self.lengths)))).astype("<u8").tobytes())
        self.out.write(np.array(self.offsets[:-1], dtype="<u8").tobytes())
        self.out.write(struct.pack("<6Q", self.bits, self.n_ids, len(doc_ids), self.nulls, self.block, self.offsets[-1]) + MAGIC)
        return doc_ids, self.n_ids


def file_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK_IDS, nulls: int = 0):
    """The bytes of a whole file, in one part."""
    out = io.BytesIO()
    writer = TokenWriter(out, bits, block)
    writer.add(doc_ids, lengths, ids, nulls)
    writer.close()
    yield out.getvalue()


class TokenFile:
    """Reader of a token file: whole documents, or any range of ids."""

    def __init__(self, handle):
        self.handle = handle
        handle.seek(0, 2)
        size = handle.tell()
        handle.seek(max(0, size - FOOTER))
        foot = handle.read(FOOTER)
        if foot[48:] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.n_ids, n_docs, self.nulls, self.block, self.packed = struct.unpack("<6Q", foot[:48])
        n_blocks = -(-self.n_ids // self.block)
        handle.seek(self.packed)
        self.doc_ids = np.frombuffer(handle.read(8 * n_docs), "<i8")
        self.starts = np.frombuffer(handle.read(8 * (n_docs + 1)), "<u8").astype(np.int64)
        self.offsets = np.append(np.frombuffer(handle.read(8 * n_blocks), "<u8").astype(np.int64), self.packed)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop`` (exclusive), reading only their blocks."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.handle.seek(int(self.offsets[first]))
        data = memoryview(self.handle.read(int(self.offsets[last + 1] - self.offsets[first])))
        parts = []
        for b in range(first, last + 1):
            at = int(self.offsets[b] - self.offsets[first])
            size = int(self.offsets[b + 1] - self.offsets[b])
            parts.append(unpack(data[at : at + size], min(self.block, self.n_ids - b * self.block), self.bits))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]


def _encoder(name: str):
    """Ids of many texts: pre-token by pre-token through a worker's cache, in lower case as the tokenizer takes them.

    Words of uncommon characters are kept as they are and encoded one by one; missing pre-tokens are encoded many at a call,
    joined by spaces, and told apart by the vocabulary's word ends.
    """
    tokenizer = load_tokenizer(name)
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    odd = re.compile("|".join([ODD.pattern, *map(re.escape, specials)]))
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    cache = _cache.setdefault(name, {})

    def raw(texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def fill(missing: list[str]) -> None:
        alone = [p for p in missing if OTHER.search(p)]
        cache.update(zip(alone, raw(alone), strict=True))
        common = [p for p in missing if not OTHER.search(p)]
        for at in range(0, len(common), 1 << 14):
            some = common[at : at + (1 << 14)]
            encoded = tokenizer.encode_batch_fast([" ".join(some[k : k + JOINED]) for k in range(0, len(some), JOINED)], add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, dtype="<u4") for x in encoded])
            stops = ((np.flatnonzero(ends_word[ids]) + 1) * 4).tolist()
            data = ids.tobytes()
            cache.update(zip(some, [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], strict=True))

    def encode(texts: list[str | None]) -> list[bytes]:
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        parts = [None if t is None or odd.search(t) else plain_parts(t) for t in texts]
        missing = list({p for found in parts if found for p in found if p not in cache})
        fill(missing)
        out = []
        for text, found in zip(texts, parts, strict=True):
            out.append(b"".join(map(cache.__getitem__, found)) if found is not None else raw([text])[0] if text else b"")
        for p in missing:
            if len(p) > CACHE_CHARS:
                del cache[p]
        return out

    return encode


def write_token_files(docs: DataFrame, folder: str, name: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and write the token files below ``folder``, in ascending order of doc_id.

    Returns a row for each file: path, first_doc, n_docs, n_ids. A null text is
    an empty one and has only the end id. Rows with a null doc_id come first; repeated
    doc_ids stand one after the other, by text. An empty table gives no file. A task writes under a name of its own and renames it when
    complete, so a repeated task leaves whole files only; a file counts if it is in the returned rows.
    """
    spark = ship_package(docs.sparkSession)
    schema = "path string, first_doc long, last_doc long, n_docs long, n_ids long"
    target = arrow_schema(spark, schema)

    def write(batches):
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        encode, end = _encoder(name), struct.pack("<I", end_id)
        bits = bits_for(load_tokenizer(name).get_vocab_size(with_added_tokens=True))
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        unique = uuid.uuid4().hex
        with fs.open_output_stream(f"{base}/.{unique}.part") as out:
            writer = TokenWriter(out, bits)
            for batch in chain([first], batches):
                for part in slices(batch):
                    encoded = encode(part.column("text").to_pylist())
                    keys = part.column("doc_id")
                    lengths = np.fromiter((len(x) // 4 + 1 for x in encoded), np.int64, len(encoded))
                    writer.add(np.asarray(keys.fill_null(0)), lengths, np.frombuffer(b"".join([x + end for x in encoded]), "<u4"), keys.null_count)
            doc_ids, n_ids = writer.close()
        path = f"{base}/{unique}.tokens"
        fs.move(f"{base}/.{unique}.part", path)
        nulls = writer.nulls
        yield pa.RecordBatch.from_pydict({"path": [path], "first_doc": [None if nulls else int(doc_ids[0])], "last_doc": [None if nulls == len(doc_ids) else int(doc_ids[-1])], "n_docs": [len(doc_ids)], "n_ids": [n_ids]}, schema=target)
        release_memory()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = id_text(docs, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, schema)


def read_token_files(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Documents of token files, from the files alone: doc_id, start, n_tokens, ids_crc32.

    ``files`` has a row for each file with its path and ``base``, the ids of all
    files before it. A task reads its files block by block.
    """
    ship_package(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    target = arrow_schema(spark, schema)

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(path) as handle:
                    file = TokenFile(handle)
                    n, at = len(file.doc_ids), 0
                    while at < n:
                        stop = min(max(int(np.searchsorted(file.starts, file.starts[at] + 16 * BLOCK_IDS, side="right")) - 1, at + 1), n)
                        first = int(file.starts[at])
                        data = file.ids(first, int(file.starts[stop])).astype("<u4")
                        crcs = [zlib.crc32(data[a:b]) for a, b in zip((file.starts[at:stop] - first).tolist(), (file.starts[at + 1 : stop + 1] - first).tolist(), strict=True)]
                        keys = pa.array(file.doc_ids[at:stop], mask=np.arange(at, stop) < file.nulls)
                        yield pa.RecordBatch.from_pydict({"doc_id": keys, "start": file.starts[at:stop] + base, "n_tokens": np.diff(file.starts[at : stop + 1]), "ids_crc32": np.array(crcs, dtype=np.int64)}, schema=target)
                        at = stop

    return files.mapInArrow(read, schema)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token files of all documents, then describe each document from the files read back.

    What the driver holds is one row a file, that is a task.
    """
    folder = shared_folder(spark, "tokens")
    rows = write_token_files(table(spark, sf_dir, "documents"), folder).collect()
    rows.sort(key=lambda r: tuple((r[c] is not None, r[c]) for c in ("first_doc", "last_doc")))
    base, placed = 0, []
    for r in rows:
        placed.append((r["path"], base))
        base += r["n_ids"]
    files = spark.createDataFrame(placed, "path string, base long").repartition(max(1, len(placed)))
    return read_token_files(spark, files, folder)

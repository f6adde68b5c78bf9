"""SimHash near-duplicates found with BK-trees.

Texts with equal fingerprints count as one. The 64 bits are cut into blocks; two
fingerprints that differ in at most ``radius`` bits agree in at least
``blocks - radius`` blocks, so each shard, that is one choice of so many blocks and
their values, holds a superset of some links and all shards together hold all of
them. Each shard is a BK-tree whose children are keyed by their Hamming
distance to the parent; a search follows only the edges within the radius of
its own distance. Trees of a task's shards are built and searched together,
level by level, in numpy. A shard larger than ``TREE_NODES`` is dealt to several trees, and its
fingerprints are sent to each of them as queries.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import id_text, map_text, row_key, slices, written
from quillspark.llm.components import connected_components, forest, nearest_forest
from quillspark.shipping import ship_package
from quillspark.sources.tables import table

SHINGLE = 4
RADIUS = 4
BLOCKS = 6
#: Nodes of a tree; a larger shard is dealt to several.
TREE_NODES = 8192
#: Pairs of query and node that a search holds at a time.
FRONTIER = 1 << 21

#: For similarities below those of the radius: lanes of 64 bits, tables, bits of a table's key, radius in a lane.
LANES = 4
TABLES = 36
KEY_BITS = 14
LANE_RADIUS = 15
#: Sets sampled to find common shingles, in how many of them one must be, and how many are put in order at most.
SAMPLE, OFTEN, ORDERED = 20_000, 8, 200_000
#: Bits of the bitmap of texts to be verified.
BITMAP = 1 << 23
#: Sets of one prefix shingle that are paired by size; more are paired by component.
RUN = 512

_LOWER = bytes(ord(chr(b).lower()) if b < 0x80 else b for b in range(256))


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype="<u8")
    if len(words) <= size:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype="<u8")
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), dtype="<u8", count=len(starts))
    return hashes


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[i : i + (1 << 14)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of a text's shingles; zero without words."""
    return majority(shingle_hashes(text, size))


def wide_fingerprint(text: str | None, size: int) -> list[int]:
    """Four fingerprints of 64 bits, of the shingles' hashes and of three scrambles of them."""
    h = shingle_hashes(text, size)
    lanes = [majority(h)]
    for k in range(1, LANES):
        x = (h ^ np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        lanes.append(majority(x ^ (x >> np.uint64(32))))
    return lanes


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def make():
        def step(ids, texts):
            return {"doc_id": ids, "fp": np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64)}

        return step

    return map_text(id_text(docs, id_col, text_col), make, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks of the block choices: ``blocks - radius`` blocks of almost equal width."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def build_forest(tree: np.ndarray, fp: np.ndarray) -> dict[str, np.ndarray]:
    """BK-trees over fingerprints, one for each value of ``tree``, in level order.

    Rows are sorted by tree. Every level takes the first row of each open group
    as its node; the others go on by their distance to it. Children of a node
    stand together, in order of their edge's distance.
    """
    n = len(fp)
    order_rows = np.arange(n)
    group = np.unique(tree, return_inverse=True)[1].astype(np.int64) if n else np.empty(0, np.int64)
    parent_of_group = np.full(int(group.max()) + 1 if n else 0, -1, dtype=np.int64)
    edge_of_group = np.zeros(len(parent_of_group), dtype=np.int64)
    rows, parents, edges = [], [], []
    made = 0
    while len(order_rows):
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        node_rows = order_rows[first]
        ids = made + np.arange(len(first))
        rows.append(node_rows)
        parents.append(parent_of_group[group[first]])
        edges.append(edge_of_group[group[first]])
        made += len(first)
        which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(group))))
        rest = np.ones(len(order_rows), dtype=bool)
        rest[first] = False
        order_rows, which = order_rows[rest], which[rest]
        if not len(order_rows):
            break
        d = np.bitwise_count(fp[order_rows] ^ fp[node_rows[which]]).astype(np.int64)
        key = which * 65 + d
        sort = np.argsort(key, kind="stable")
        order_rows, key = order_rows[sort], key[sort]
        keys, group = np.unique(key, return_inverse=True)
        parent_of_group, edge_of_group = ids[keys // 65], keys % 65
    if not n:
        empty = np.empty(0, np.int64)
        return {"row": empty, "parent": empty, "edge": empty, "child": empty, "children": empty}
    row, parent, edge = np.concatenate(rows), np.concatenate(parents), np.concatenate(edges)
    counts = np.bincount(parent[parent >= 0], minlength=n)
    child = np.concatenate(([0], np.cumsum(counts)))[:-1] + int((parent < 0).sum())
    return {"row": row, "parent": parent, "edge": edge, "child": child, "children": counts}


def search_forest(trees: dict[str, np.ndarray], fp: np.ndarray, query: np.ndarray, root: np.ndarray, radius: int):
    """Pairs (query position, row) within the radius, in parts; ``root`` is the node at which a query starts."""
    row, edge, child, children = trees["row"], trees["edge"], trees["child"], trees["children"]
    stack = [(np.arange(len(query))[i : i + FRONTIER], root[i : i + FRONTIER]) for i in range(0, len(query), FRONTIER)]
    while stack:
        q, node = stack.pop()
        d = np.bitwise_count(query[q] ^ fp[row[node]]).astype(np.int64)
        near = d <= radius
        if near.any():
            yield q[near], row[node[near]]
        n = children[node]
        open_ = np.flatnonzero(n)
        at = 0
        ends = np.cumsum(n[open_])
        while at < len(open_):
            stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FRONTIER, side="right")), at + 1)
            part = open_[at:stop]
            m = n[part]
            which = np.repeat(part, m)
            nodes = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(child[node[part]], m)
            follow = np.abs(edge[nodes] - d[which]) <= radius
            if follow.any():
                stack.append((q[which[follow]], nodes[follow]))
            at = stop


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Spanning links among distinct fingerprints (fp, rep): a, b as reps.

    Every pair within the radius is compared in at least one shard; a task gives the
    spanning forest of its links, not all pairs.
    """
    masks = block_masks(blocks, radius)
    keyed = prints.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for k, m in enumerate(masks)])).alias("s"))
    return _shard_links(keyed.select("fp", "rep", F.array().cast("array<long>").alias("lanes"), F.xxhash64("s.mask", "s.value").alias("shard")), radius, None)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def link_similar(prints: DataFrame, most: int) -> DataFrame:
    """The same among wide fingerprints (lanes, rep) that differ in at most ``most`` of all their bits.

    A shard is one of ``TABLES`` choices of key bits of one lane, with their values; its BK-tree
    is over that lane, and what it finds is decided by all lanes. Pairs at the threshold
    share some shard with a probability of over 0.9, nearer ones almost surely.
    """
    rng = np.random.default_rng(17)
    masks = [sum(1 << int(b) for b in rng.choice(64, KEY_BITS, replace=False)) for _ in range(TABLES)]
    lane = lambda k: F.col("lanes")[k % LANES]
    keyed = prints.select("lanes", "rep", F.explode(F.array(*[F.struct(F.lit(k).alias("table"), lane(k).alias("fp"), lane(k).bitwiseAND(F.lit(_signed(m))).alias("value")) for k, m in enumerate(masks)])).alias("s"))
    return _shard_links(keyed.select("s.fp", "rep", "lanes", F.xxhash64("s.table", "s.value").alias("shard")), LANE_RADIUS, most)


def _shard_links(keyed: DataFrame, radius: int, most: int | None) -> DataFrame:
    """Spanning links of all shards; with ``most`` the nearest pairs, whose lanes differ in no more bits, that span what is so linked."""
    spark = ship_package(keyed.sparkSession)
    large = keyed.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > TREE_NODES).select("shard", F.ceil(F.col("n") / TREE_NODES).cast("int").alias("trees"))
    dealt = keyed.join(large, "shard", "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    # a shard of several trees is dealt to pairs of them: one gives the nodes, the other the queries
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("trees")).cast("int"))
    sent = dealt.select("fp", "rep", "lanes", "shard", "own", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lanes = [F.col("lanes")[k].alias(f"f{k}") for k in range(LANES if most is not None else 0)]
    placed = sent.select("fp", "rep", *lanes, F.xxhash64("shard", low, high).alias("tree"), (F.col("own") == low).alias("node"), (F.col("own") == high).alias("ask")).repartition(n, "tree").sortWithinPartitions("tree")

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 19:
                whole = pa.Table.from_batches(held)
                trees = np.asarray(whole.column("tree"))
                cut = int(np.searchsorted(trees == trees[-1], True))
                if cut:
                    yield from links(whole.slice(0, cut))
                    held, size = whole.slice(cut).to_batches(), len(trees) - cut
        if held:
            yield from links(pa.Table.from_batches(held))

    def links(part: pa.Table):
        fp, rep, tree, node, ask = (np.asarray(part.column(c)) for c in ("fp", "rep", "tree", "node", "ask"))
        fp = fp.view(np.uint64)
        wide = [np.asarray(part.column(f"f{k}")).view(np.uint64) for k in range(LANES if most is not None else 0)]
        shard, counts = np.unique(tree, return_inverse=True, return_counts=True)[1:]
        several = counts[shard] > 1
        fp, rep, shard, node, ask = fp[several], rep[several], shard[several], node[several], ask[several]
        wide = [x[several] for x in wide]
        own = np.flatnonzero(node)
        if not len(own):
            return
        trees = build_forest(shard[own], fp[own])
        roots = np.flatnonzero(trees["parent"] < 0)
        root_of = np.full(len(counts), -1, dtype=np.int64)
        root_of[shard[own][trees["row"][roots]]] = roots
        root = root_of[shard]
        ask = np.flatnonzero(ask & (root >= 0))
        found, pending = [], 0
        for q, row in search_forest(trees, fp[own], fp[ask], root[ask], radius):
            x, y = rep[ask[q]], rep[own[row]]
            keep = x != y
            apart = np.zeros(len(x), dtype=np.int64)
            if wide:
                apart = sum(np.bitwise_count(f[ask[q]] ^ f[own[row]]).astype(np.int64) for f in wide)
                keep &= apart <= most
            found.append((x[keep], y[keep], apart[keep]))
            pending += int(keep.sum())
            if pending > 1 << 21:
                found, pending = [spanning(found)], 0
        if found:
            x, y, _ = spanning(found)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    def spanning(found):
        x, y, apart = (np.concatenate(c) for c in zip(*found, strict=True))
        return nearest_forest(x, y, apart) if most is not None else (*forest(x, y), np.empty(0, np.int64))

    return placed.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups: doc_id, fp, component_id (the smallest doc_id reachable by links).

    Null and blank texts have fingerprint zero and link like any other. Repeated
    rows keep one row each. A row with a null doc_id gets its fingerprint and
    the component of that fingerprint, and never names a component unless alone. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, size, id_col, text_col), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "distinct")
    components = connected_components(link_fingerprints(distinct, radius, blocks), "simhash")
    named = distinct.join(components, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def bits_apart(similarity: float) -> int:
    """Most differing bits of wide fingerprints whose texts may have so large a share of common shingles.

    Shingle sets of Jaccard similarity j are at an angle of cosine 2j / (1 + j), and each
    bit differs with a probability of that angle over pi; one and a half of that count's standard deviations are granted.
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits = 64 * LANES
    return int(bits * p + 1.5 * np.sqrt(bits * p * (1 - p)))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of a text as signed hashes in ascending order; none without words."""
    return np.unique(shingle_hashes(text, size)).view(np.int64)


def frequent_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that many of some sampled texts have, in ascending order, and their places, rarest first.

    The prefix filter takes these last. Any order of shingles gives the same pairs, so the sample and its bounds
    change only the work.
    """
    share = max(docs.count() // SAMPLE, 1)
    some = docs.filter(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0))

    def make():
        def step(ids, texts):
            return {"doc_id": ids, "shingles": _lists([shingle_set(t, size) for t in texts])}

        return step

    sets = map_text(some, make, "doc_id long, shingles array<long>")
    rows = sets.select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(ORDERED).select("h").collect()
    found = np.array([x["h"] for x in reversed(rows)], dtype=np.int64)
    order = np.argsort(found)
    return found[order], order


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64()))


def prefix(shingles: np.ndarray, similarity: float, often: np.ndarray, place: np.ndarray) -> np.ndarray:
    """As many shingles of a set, in the order of all, as any set of that similarity must meet.

    Two sets of n and m shingles and that Jaccard similarity have one in common among the
    first n - ceil(similarity n) + 1 and m - ceil(similarity m) + 1.
    """
    n = len(shingles)
    if len(often) and n:
        where = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
        shingles = shingles[np.argsort(np.where(often[where] == shingles, place[where], -1), kind="stable")]
    return shingles[: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs a < b of sets (rep, component, n, prefix) of different components that may have the similarity.

    All pairs that have it are among them: what two sets can have in common is bounded by their sizes and by
    what follows the shingle at which they meet first.
    """
    spark = ship_package(sets.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = sets.select("rep", "component", "n", F.posexplode("prefix").alias("at", "h"))
    placed = postings.select("h", "rep", "component", "n", "at").repartition(n, "h").sortWithinPartitions("h", "n")

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 19:
                whole = pa.Table.from_batches(held)
                h = np.asarray(whole.column("h"))
                cut = int(np.searchsorted(h, h[-1]))
                if cut:
                    yield from pairs(whole.slice(0, cut))
                    held, size = whole.slice(cut).to_batches(), len(h) - cut
        if held:
            yield from pairs(pa.Table.from_batches(held))

    def pairs(part: pa.Table):
        h, rep, component, n, at = (np.asarray(part.column(c)) for c in ("h", "rep", "component", "n", "at"))
        counts = np.unique(h, return_counts=True)[1]
        found, pending = [], 0
        for i, j in chain(short_runs(counts, n), long_runs(counts, component)):
            least, most = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            need = np.ceil(similarity / (1 + similarity) * (least.astype(np.int64) + most) - 1e-9)
            keep = (least >= similarity * most - 1e-9) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= need) & (component[i] != component[j])
            if keep.any():
                x, y = rep[i[keep]], rep[j[keep]]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
                pending += int(keep.sum())
            if pending > 1 << 20:
                both = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
                found, pending = [], 0
        if found:
            both = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def short_runs(counts, n):
        """Pairs in runs of one shingle, by their distance; the larger sets come later, so what no longer fits by size never will."""
        left = np.repeat(np.where(counts <= RUN, np.cumsum(counts), 0), counts) - np.arange(int(counts.sum())) - 1
        i, apart = np.flatnonzero(left > 0), 1
        while len(i):
            yield i, i + apart
            fits = n[i] >= similarity * n[i + apart] - 1e-9
            apart += 1
            i = i[fits & (left[i] >= apart)]

    def long_runs(counts, component):
        """Pairs of different components in the other runs, which are put in order of their components."""
        for stop, count in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True):
            if count > RUN:
                rows = stop - count + np.argsort(component[stop - count : stop], kind="stable")
                new = np.flatnonzero(np.diff(component[rows])) + 1
                for first, end in zip([0, *new.tolist()], new.tolist(), strict=False):
                    others = rows[end:]
                    some = max(1, (1 << 20) // len(others))
                    for k in range(first, end, some):
                        own = rows[k : min(k + some, end)]
                        yield np.repeat(own, len(others)), np.tile(others, len(own))

    return placed.mapInArrow(run, "a long, b long")


def parities(sets: list[np.ndarray]) -> list[bytes]:
    """For each set, whether an odd number of its members has each value of the low bits; at least as many values as members."""
    out = []
    for s in sets:
        width = max(64, 1 << (len(s) - 1).bit_length())
        odd = np.bincount(s & (width - 1), minlength=width) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def differing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Bits in which parities of equal or different widths differ: no more than members that only one of two sets has."""
    a, b = np.fromiter(map(len, x), np.int64, len(x)), np.fromiter(map(len, y), np.int64, len(y))
    out = np.empty(len(x), dtype=np.int64)
    code = a << 32 | b
    for c in np.unique(code).tolist():
        at = np.flatnonzero(code == c)
        least = min(c >> 32, c & 0xFFFFFFFF)
        for k in range(0, len(at), max(1, (8 << 20) // max(c >> 32, c & 0xFFFFFFFF))):
            some = at[k : k + max(1, (8 << 20) // max(c >> 32, c & 0xFFFFFFFF))].tolist()
            p, q = (np.bitwise_xor.reduce(np.frombuffer(b"".join([z[i] for i in some]), np.uint8).reshape(len(some), -1, least), axis=1) for z in (x, y))
            out[some] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)
    return out


def likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) all that have the similarity and few others, by the sizes and parities of their sets (rep, n, parity).

    Sets of n and m members and a Jaccard similarity j differ in (1 - j) / (1 + j) of n + m members, and parities
    never in more bits.
    """
    ship_package(pairs.sparkSession)
    one = sketches.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    other = sketches.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))

    def run(batches):
        for batch in batches:
            most = (1 - similarity) / (1 + similarity) * (np.asarray(batch.column("na")).astype(np.int64) + np.asarray(batch.column("nb")))
            near = differing(batch.column("pa").to_pylist(), batch.column("pb").to_pylist()) <= most + 1e-6
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.join(one, "a").join(other, "b").mapInArrow(run, "a long, b long")


def sets_of(texts: DataFrame, distinct: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Shingle sets (rep, shingles) of the texts that pairs name, made again from the texts (r1, r2, text).

    A bitmap of fixed size tells most other texts from them before any shuffle; the join leaves no wrong ones.
    """
    spark = texts.sparkSession
    bit = lambda c: F.pmod(F.col(c), F.lit(BITMAP))
    nodes = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    named = written(distinct.select("rep", "first.r1", "first.r2").join(nodes, "rep"), "named")
    parts = named.select(bit("r1").alias("bit")).groupBy(F.expr("bit div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("bit % 32768")).alias("bits")).collect()
    bits = np.zeros((BITMAP >> 15, 4096), dtype=np.uint8)
    for x in parts:
        bits[x["part"]] = np.frombuffer(x["bits"], dtype=np.uint8)
    wanted = spark.sparkContext.broadcast(bits.ravel())
    ship_package(spark)

    def run(batches):
        have = wanted.value
        for batch in batches:
            at = np.asarray(batch.column("bit"))
            chosen = batch.filter(pa.array((have[at >> 3] >> (at & 7) & 1).astype(bool)))
            for part in slices(chosen):
                yield pa.RecordBatch.from_arrays([part.column("r1"), part.column("r2"), _lists([shingle_set(t, size) for t in part.column("text").to_pylist()])], names=["r1", "r2", "shingles"])

    made = texts.select("r1", "r2", "text", bit("r1").alias("bit")).mapInArrow(run, "r1 long, r2 long, shingles array<long>")
    return written(made.join(named, ["r1", "r2"]).select("rep", "shingles"), "named-sets")


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of hash of each set, as two signed longs."""
    return np.array([[xxhash.xxh64_intdigest(s.tobytes(), k) for k in (0, 1)] for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) those whose sets (rep, shingles) have that Jaccard similarity at least."""
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    # a quotient and not a product: four fifths are then exactly the double 0.8
    return pairs.join(one, "a").join(other, "b").filter(shared / (F.size("x") + F.size("y") - shared) >= F.lit(similarity)).select("a", "b")


def similar_groups(docs: DataFrame, size: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows by the 128-bit key of their shingle set: doc_id, r1, r2, k1, k2; and the distinct sets: k1, k2, first, group.

    Sets of a Jaccard similarity of ``similarity`` link, and linked sets have one group. ``first`` is the first row of a set:
    that of the smallest doc_id, rows without one last, then by hash.
    Wide fingerprints and BK-trees find most links and so join large groups at little cost; a prefix filter over the
    shingles finds every further pair between different groups. Both only propose: a pair is linked
    when its whole sets have the similarity.
    """
    r1, r2 = row_key()
    texts = id_text(docs, id_col, text_col).select("doc_id", "text", r1.alias("r1"), r2.alias("r2"))
    order = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts, size))

    def make():
        often, place = order.value

        def step(ids, texts):
            lanes = np.array([wide_fingerprint(t, size) for t in texts], dtype=np.uint64).reshape(-1, LANES).view(np.int64)
            sets = [shingle_set(t, size) for t in texts]
            keys = set_keys(sets)
            first = _lists([prefix(s, similarity, often, place) for s in sets])
            return {"k1": keys[:, 0].copy(), "k2": keys[:, 1].copy(), "lanes": pa.FixedSizeListArray.from_arrays(pa.array(lanes.ravel()), LANES).cast(pa.list_(pa.int64())), "n": np.array([len(s) for s in sets], dtype=np.int32), "prefix": first, "parity": pa.array(parities(sets), pa.binary())}

        return step

    def links(pairs):
        pairs = written(likely(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), distinct.select("rep", "n", "parity"), similarity), "pairs")
        return written(verified(pairs, sets_of(texts, distinct, pairs, size), similarity), "links")

    prints = written(map_text(texts, make, "doc_id long, r1 long, r2 long, k1 long, k2 long, lanes array<long>, n int, prefix array<long>, parity binary"), "wide-fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")
    sets = prints.groupBy("k1", "k2").agg(F.min(row).alias("first"), *[F.first(c).alias(c) for c in ("lanes", "n", "prefix", "parity")])
    # names that are fixed once they are written
    distinct = written(sets.withColumn("rep", F.monotonically_increasing_id()), "wide-distinct")
    near = links(link_similar(distinct.select("lanes", "rep"), bits_apart(similarity)))
    joined = connected_components(near, "joined")
    open_sets = distinct.join(joined, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("component"), "n", "prefix")
    rest = links(prefix_pairs(open_sets, similarity))
    components = connected_components(near.union(rest), "similar")
    groups = distinct.select("rep", "k1", "k2", "first").join(components, F.col("rep") == F.col("node"), "left").select("k1", "k2", "first", F.coalesce("component", "rep").alias("group"))
    return prints.select("doc_id", "r1", "r2", "k1", "k2"), groups


def similar_components(docs: DataFrame, size: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts by the Jaccard similarity of their shingle sets: doc_id, component_id (the smallest doc_id reachable); see :func:`similar_groups`.

    Null texts and texts without words have the empty set and are one group. Repeated rows keep one row each. A row with a
    null doc_id links like any other and names no component; a group of such rows alone has null. An empty table gives no rows.
    """
    rows, groups = similar_groups(docs, size, similarity, id_col, text_col)
    least = groups.groupBy("group").agg(F.min("first.doc_id").alias("component_id"))
    return rows.join(groups.join(least, "group").select("k1", "k2", "component_id"), ["k1", "k2"], "left").select("doc_id", "component_id")


def first_of_similar(docs: DataFrame, size: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each group of similar texts, with all its columns: that of the smallest doc_id.

    Rows without a doc_id come last, rows of one doc_id are told apart by their texts' hashes, and of equal rows
    one stays. Null texts and texts without words are one group. An empty table gives no rows.
    """
    _, groups = similar_groups(docs, size, similarity, id_col, text_col)
    kept = groups.groupBy("group").agg(F.min("first").alias("f")).select(F.col("f.r1").alias("__qs_1"), F.col("f.r2").alias("__qs_2"))
    r1, r2 = row_key("__qs_d", "__qs_t")
    keyed = docs.withColumn("__qs_d", F.col(id_col).cast("long")).withColumn("__qs_t", F.col(text_col).cast("string")).withColumn("__qs_1", r1).withColumn("__qs_2", r2)
    # equal rows share a key, by which the join has dealt and sorted them
    return keyed.join(kept, ["__qs_1", "__qs_2"], "left_semi").dropDuplicates(["__qs_1", "__qs_2"]).drop("__qs_1", "__qs_2", "__qs_d", "__qs_t")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents; see :func:`simhash_components`."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius by BK-trees.

A fingerprint's 64 bits are cut into ``BLOCKS`` blocks. Two fingerprints within ``radius`` bits agree in at least
``BLOCKS - radius`` of them, so each fingerprint goes to one shard for each choice of that many blocks, and every
linked pair meets in a shard. A shard gets a BK-tree (children keyed by their distance to the parent) that is queried
by the shard's fingerprints, following only edges within the radius. Broadcasting the trees of all shards would grow
with the corpus, so trees and queries meet by a shuffle instead. Shards beyond ``SHARD`` fingerprints are cut into
chunks; each pair of chunks is a task of its own, so no link is lost and no group has to fit in memory.

Exact copies share a fingerprint, and only distinct fingerprints are searched. A shard gives a spanning set of its
links rather than all pairs; components follow by alternating large-star and small-star steps on the links, cut by
reliable checkpoints.

Defined cases: a null text has no words; texts without words have fingerprint 0 and link like any other; a null
doc_id takes part but never names a component unless all its members are null; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import kept, written

SHINGLE = 4
BLOCKS = 6
#: A fingerprint with more than one in so many rows is looked up without a shuffle.
HOT = 1000
SHARD = 2048
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLANES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles' XXH64 (seed 42), repeats included; 0 without words."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, h64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h64(joined, 42)
    ends = [*accumulate(len(w) + 1 for w in words)]
    starts = [0, *ends[: len(words) - shingle]]
    return majority(np.array([h64(joined[a : b - 1], 42) for a, b in zip(starts, ends[shingle - 1 :])], np.dtype(">u8")))


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have set."""
    h = h.astype(">u8", copy=False)
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLANES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(h)).tobytes(), "big")


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct XXH64 of the text's shingles, sorted; a text of fewer words is one shingle, one without words none."""
    import xxhash

    words = text.lower().split() if text else []
    joined = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    return np.unique(np.array([xxhash.xxh64_intdigest(x, 42) for x in joined], np.uint64))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, fp long")


class BKTree:
    """Nodes in flat lists; ``children[i]`` maps a distance to the child at that distance from node i."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.children: list[dict[int, int]] = []
        values = fps.tolist()
        for i, x in enumerate(values):
            self.children.append({})
            node = 0
            while node != i:
                d = (values[node] ^ x).bit_count()
                nxt = self.children[node].setdefault(d, i)
                if nxt == i:
                    break
                node = nxt

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each node the indexes of the queries within the radius; branches out of reach aren't entered."""
        todo = [(0, np.arange(len(queries)))] if len(self.fps) else []
        while todo:
            node, at = todo.pop()
            d = np.bitwise_count(queries[at] ^ self.fps[node]).astype(np.int64)
            near = at[d <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                reach = at[np.abs(d - edge) <= radius]
                if len(reach):
                    todo.append((child, reach))


def _spanning(tree: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the radius joins: at most one for each fingerprint."""
    both = np.concatenate([tree, queries])
    root = list(range(len(both)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for node, near in BKTree(tree).within(queries, radius):
        a = find(node)
        for q in (near + len(tree)).tolist():
            b = find(q)
            if a != b:
                root[b] = a
    top = np.array([find(i) for i in range(len(both))])
    return both, both[top]


def _shard_links(radius: int):
    def links(key, tree: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(tree) + len(other) == 2 and len(tree) == 2:
            near = (int(tree[0]) ^ int(tree[1])).bit_count() <= radius
            return (tree[:1], tree[1:]) if near else (tree[:0], tree[:0])
        a, b = _spanning(tree, other if len(other) else tree, radius)
        return a[a != b], b[a != b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard (key, i, j): the fingerprints of chunk i, then those of chunk j if it is another."""
        rest = None
        for batch in _with_end(batches):
            frame = None if batch is None else batch.to_pandas()
            if rest is not None:
                frame = rest if frame is None else pd.concat([rest, frame], ignore_index=True)
            if frame is None or not len(frame):
                rest = frame
                continue
            key = frame[["key", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            bounds = [0, *cuts.tolist(), len(frame)]
            if batch is not None:  # the last shard may go on in the next batch
                rest, bounds = frame.iloc[bounds[-2] :], bounds[:-1]
            fps, chunk = frame["fp"].to_numpy(np.int64).view(np.uint64), frame["chunk"].to_numpy()
            out_a, out_b = [], []
            for a, b in zip(bounds, bounds[1:]):
                if b - a < 2:
                    continue
                first = chunk[a:b] == key[a][1]
                x, y = links(key[a], fps[a:b][first], fps[a:b][~first])
                out_a.append(x)
                out_b.append(y)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).view(np.int64), pa.int64()) for o in (out_a, out_b)], names=["a", "b"])

    return run


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_links(fps: DataFrame, radius: int = 4, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps`` (column fp) that span all pairs within the radius."""
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    part = [F.shiftrightunsigned("fp", int(a)).bitwiseAND(F.lit((1 << int(b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    keys = F.array(*[F.xxhash64(F.lit(n), *[part[k] for k in ks]) for n, ks in enumerate(combinations(range(blocks), blocks - radius))])
    dealt = fps.select("fp", F.explode(keys).alias("key"))
    shared = dealt.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / shard).cast("int")
    rows = (
        dealt.join(shared, "key")
        .withColumn("chunks", chunks)
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("fp", "key", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    )
    placed = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return placed.mapInArrow(_shard_links(radius), "a long, b long").distinct()


def connected(links: DataFrame, max_steps: int = 60) -> DataFrame:
    """node, root for every node of ``links`` (a, b): alternating star contraction until nothing changes."""
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = kept(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(edges)
    for _ in range(max_steps):
        if not seen[0]:
            break
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = kept(small)
        if (now := state(edges)) == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())


def near_duplicates(docs: DataFrame, *, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id reachable) for each row."""
    rows = kept(fingerprints(docs, id_col=id_col, text_col=text_col))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    roots = connected(near_links(nodes.select("fp"), radius))
    linked = nodes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "first_id")
    named = linked.select("fp", "root").join(linked.groupBy("root").agg(F.min("first_id").alias("joined_id")), "root").select("fp", "joined_id")
    label = kept(nodes.join(named, "fp", "left").select("fp", F.coalesce("joined_id", "first_id").alias("component_id"), "n"))
    # a fingerprint with a HOT-th of all rows or more: there are HOT of them at most, and they don't move their rows
    hot = F.col("n") >= rows.count() / HOT
    columns = ["doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id"]
    often = F.broadcast(label.filter(hot))
    return rows.join(often, "fp").select(*columns).unionByName(rows.join(often, "fp", "left_anti").join(label.filter(~hot), "fp").select(*columns))


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


# near-duplicates by the similarity of shingle sets, for the pipeline ----------------------------------------------

SET_SHINGLE = 5
SIMILARITY = 0.8
#: A set has a key for each of ``BANDS`` groups of ``BAND`` minimum hashes; sets that share a key meet in a shard. At
#: similarity 0.8 two sets share none with a chance of (1 - 0.8^4)^20 = 0.00003.
BANDS, BAND = 20, 4
#: Radius of the BK-trees: fingerprints of sets at similarity 0.8 differ in 9.7 bits on average, with a deviation of 2.9.
SET_RADIUS = 24
#: Bytes of sets in a chunk of a crowded shard.
SHARD_BYTES = 16 << 20
#: Sets with a shared key up to which their shards are broadcast, so that only these sets move.
MAX_MEMBERS = 100_000
_MIX = np.random.default_rng(20).integers(0, 1 << 63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key for each band of a set, told apart by band; none for an empty set."""
    import xxhash

    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(len(_MIX), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        x = h[at : at + 4096, None] * _MIX[None, :]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, x.min(0))
    rows = least.reshape(BANDS, BAND)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), n) for n, r in enumerate(rows)], np.uint64).view(np.int64)


def set_rows(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, node (hash of the shingle set), fp (SimHash of the set), keys (of the bands) and the set."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                sets = [shingle_set(t.as_py(), SET_SHINGLE) for t in b.column(2)]
                node = np.array([xxhash.xxh64_intdigest(h.tobytes(), 42) for h in sets], np.uint64).view(np.int64)
                fp = np.array([majority(h) if len(h) else 0 for h in sets], np.uint64).view(np.int64)
                cols = [b.column(0), b.column(1), pa.array(node), pa.array(fp), pa.array([band_keys(h) for h in sets], pa.list_(pa.int64())), pa.array([h.tobytes() for h in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "node", "fp", "keys", "shingles"])

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, text_hash long, node long, fp long, keys array<long>, shingles binary")


def set_links(rid: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], split: int, least: float, radius: int) -> list[tuple[int, int]]:
    """Links between the first ``split`` rows and the others (all rows, if there are no others) whose sets are at least
    ``least`` similar. A pair that the links so far join isn't compared, so a group of copies costs one comparison each."""
    root = list(range(len(rid)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    n = np.array([len(x) for x in sets])
    first = split if split < len(rid) else 0
    out = []
    for node, near in BKTree(fps[:split]).within(fps[first:], radius):
        near = near + first
        near = near[(np.minimum(n[near], n[node]) >= least * np.maximum(n[near], n[node])) & (near != node)]
        for q in near.tolist():
            a, b = find(node), find(q)
            if a != b:
                both = len(np.intersect1d(sets[node], sets[q], assume_unique=True))
                if both / (n[node] + n[q] - both) >= least:
                    root[b] = a
                    out.append((int(rid[node]), int(rid[q])))
    return out


def _set_shards(least: float, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard (key, i, j), as for ``_shard_links``."""
        rest = None
        for batch in _with_end(batches):
            frame = None if batch is None else batch.to_pandas()
            if rest is not None:
                frame = rest if frame is None else pd.concat([rest, frame], ignore_index=True)
            if frame is None or not len(frame):
                rest = frame
                continue
            key = frame[["key", "i", "j"]].to_numpy()
            bounds = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(frame)]
            if batch is not None:  # the last shard may go on in the next batch
                rest, bounds = frame.iloc[bounds[-2] :], bounds[:-1]
            out = []
            for a, b in zip(bounds, bounds[1:]):
                own = frame.iloc[a:b]
                own = own.iloc[np.argsort(own["chunk"].to_numpy() != key[a][1], kind="stable")]
                split = int((own["chunk"].to_numpy() == key[a][1]).sum())
                # a pair of different chunks needs rows of both; with rows of only one of them there is nothing to compare
                if b - a < 2 or not split or (split == b - a and key[a][1] != key[a][2]):
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in own["shingles"]]
                out += set_links(own["rid"].to_numpy(), own["fp"].to_numpy(np.int64).view(np.uint64), sets, split, least, radius)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], pa.int64()) for n in (0, 1)], names=["a", "b"])

    return run


def similar_links(sets: DataFrame, keys: DataFrame, least: float = SIMILARITY, radius: int = SET_RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between the ``rid`` of ``keys`` (rid, keys; one row of each distinct set of ``sets``) that span the pairs found similar.

    Sets that share a key, directly or over others, are one shard; so each set moves once, not for each of its keys.
    """
    dealt = keys.select("rid", F.explode("keys").alias("key"))
    first = dealt.groupBy("key").agg(F.min("rid").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = connected(dealt.join(first, "key").filter("rid <> first").select(F.col("rid").alias("a"), F.col("first").alias("b")))
    members = kept(met.withColumnsRenamed({"node": "rid", "root": "key"}).join(sets.select("rid", "bytes"), "rid"))
    chunks = F.greatest(F.ceil(F.count("*") / shard), F.ceil(F.sum("bytes") / SHARD_BYTES)).cast("int")
    rows = (
        members.join(members.groupBy("key").agg(chunks.alias("chunks")), "key")
        .withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("rid", "key", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    )
    small = members.limit(MAX_MEMBERS + 1).count() <= MAX_MEMBERS
    placed = sets.select("rid", "fp", "shingles").join(F.broadcast(rows) if small else rows, "rid").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return placed.mapInArrow(_set_shards(least, radius), "a long, b long").distinct()


def first_of_groups(docs: DataFrame, *, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each group of near-duplicates: that of the smallest id, null ids last.

    Near-duplicates have sets of 5-word shingles with a Jaccard similarity of ``least`` or more, and groups are what
    these pairs join. Candidates meet in shards by the bands of their minimum hashes, where BK-trees of the sets' SimHash
    give those within ``SET_RADIUS`` bits; each candidate pair that isn't joined yet is compared by the sets themselves.

    Rows are told apart by id and text hash, as ids may be null or repeat with other texts; of rows equal in both,
    which are always in one group, one stays. Only these keys are compared with the groups' first rows.
    """
    rows = written(set_rows(docs, id_col=id_col, text_col=text_col).withColumns({"rid": F.monotonically_increasing_id(), "bytes": F.octet_length("shingles").cast("long")}), "shingle_sets")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("text_hash"))
    nodes = rows.select("node", "rid", key.alias("key")).groupBy("node").agg(F.min("key").alias("key"), F.min("rid").alias("rid"))
    roots = connected(similar_links(rows, rows.select("rid", "keys").join(nodes.select("rid"), "rid", "left_semi")))
    # equal sets are one node, and a node without a link is a group of its own
    label = nodes.join(roots.withColumnRenamed("node", "rid"), "rid", "left").groupBy(F.coalesce("root", "rid").alias("root")).agg(F.min("key").alias("key"))
    first = kept(label.select(F.col("key.id").alias("__id"), F.col("key.text_hash").alias("__t")))
    text_hash = F.xxhash64(F.col(text_col))
    same = docs[id_col].eqNullSafe(F.col("__id")) & (text_hash == F.col("__t"))
    repeated = kept(rows.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__t")).count().filter("count > 1").select("__id", "__t"))
    picked = docs.join(first, same, "left_semi")
    if repeated.isEmpty():
        return picked
    again = picked[id_col].eqNullSafe(F.col("__id")) & (text_hash == F.col("__t"))
    copies = picked.join(repeated, again, "left_semi").withColumn("__t", text_hash).dropDuplicates([id_col, "__t"]).drop("__t")
    return picked.join(repeated, again, "left_anti").unionByName(copies)

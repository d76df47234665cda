"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by a hash of their id; each shard's graph is built in one task and kept as flat neighbour
arrays next to its vectors, one row per shard in a table. Queries, packed in blocks, go to every shard of their
dimension by an equi-join, and the shards' results are merged per query. Candidates are ranked by the exact cosine in
double precision of the original vectors.

Equal vectors are indexed once, with their smallest ids (one more than the neighbours asked for, all that can be
returned), so a large group of copies neither fills a shard nor cuts its graph apart.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null
ids; only vectors of the same length are compared; rows of the same id and vector count once; fewer candidates than
asked for are all returned; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chronolith.llm.common import written

SHARD_ROWS = 8192
#: Queries that go to a shard together; its graph is sent once for each such block.
QUERY_BLOCK = 2048
LINKS, EF_BUILD, EF_SEARCH = 12, 64, 96


class Graph:
    """Layers of a navigable small-world graph over unit vectors; ``near[l]`` holds each node's neighbours, -1 where none."""

    def __init__(self, x: np.ndarray, links: int = LINKS, near: list[np.ndarray] | None = None, entry: int = 0):
        self.x, self.links, self.entry = x, links, entry
        self.mark, self.turn = np.zeros(len(x), np.int64), 0
        self.near = near if near is not None else []

    @classmethod
    def build(cls, x: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 5) -> Graph:
        g = cls(x, links)
        level = np.minimum((-np.log(1 - np.random.RandomState(seed).random_sample(len(x))) / np.log(links)).astype(int), 8)
        g.near = [np.full((len(x), 2 * links if k == 0 else links), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        top = -1
        for i, own in enumerate(level.tolist()):
            at = [g.entry]
            for k in range(top, own, -1):
                at = [g.search(x[i], at, 1, k)[0][1]]
            for k in range(min(own, top), -1, -1):
                found = g.search(x[i], at, ef, k)
                at = [j for _, j in found]
                chosen = g.spread(x[i], np.array(at, np.int32), links)
                g.near[k][i, : len(chosen)] = chosen
                for j in chosen.tolist():
                    g.link(j, i, k)
            if own > top:
                top, g.entry = own, i
        return g

    def link(self, j: int, i: int, layer: int) -> None:
        row = self.near[layer][j]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = i
            return
        all_ = np.append(row, np.int32(i))
        all_ = all_[np.argsort(-(self.x[all_] @ self.x[j]), kind="stable")]
        kept = self.spread(self.x[j], all_, len(row))
        row[:] = -1
        row[: len(kept)] = kept

    def spread(self, q: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """Up to n of the ids (nearest first): those nearer to q than to one chosen before, then the nearest others."""
        if len(ids) <= n:
            return ids
        v = self.x[ids]
        own, each = (v @ q).tolist(), v @ v.T
        most = np.full(len(ids), -2.0, np.float32)
        chosen, rest = [], []
        for a in range(len(ids)):
            if most[a] < own[a]:
                chosen.append(a)
                if len(chosen) == n:
                    break
                np.maximum(most, each[a], out=most)
            else:
                rest.append(a)
        return ids[chosen + rest[: n - len(chosen)]]

    def search(self, q: np.ndarray, entries: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        """The best (similarity, node) found in a layer, best first."""
        self.turn += 1
        mark, turn, x, near = self.mark, self.turn, self.x, self.near[layer]
        mark[entries] = turn
        best = [(float(s), e) for s, e in zip(x[entries] @ q, entries)]
        todo = [(-s, e) for s, e in best]
        heapq.heapify(best)
        heapq.heapify(todo)
        while len(best) > ef:
            heapq.heappop(best)
        while todo:
            s, c = heapq.heappop(todo)
            if len(best) >= ef and -s < best[0][0]:
                break
            new = near[c]
            new = new[new >= 0]
            new = new[mark[new] != turn]
            if not len(new):
                continue
            mark[new] = turn
            sims = x[new] @ q
            for s, i in zip(sims.tolist(), new.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (s, i))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, i))
                else:
                    continue
                heapq.heappush(todo, (-s, i))
        return sorted(best, reverse=True)

    def nearest(self, q: np.ndarray, ef: int = EF_SEARCH) -> list[int]:
        at = [self.entry]
        for k in range(len(self.near) - 1, 0, -1):
            at = [self.search(q, at, 1, k)[0][1]]
        return [i for _, i in self.search(q, at, ef, 0)]


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def cosines(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines in double precision of the rows of a with q.

    Both are scaled by powers of two first, which changes no digit of the result, and keeps very large and small values in range.
    """
    a = np.ldexp(a, -np.frexp(np.abs(a).max(1, keepdims=True))[1])
    q = np.ldexp(q, -np.frexp(np.abs(q).max())[1])
    return (a @ q) / (np.sqrt((a * a).sum(1)) * np.sqrt((q * q).sum()))


def _valid(vec: str) -> Column:
    c = F.col(vec)
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & fine & F.exists(c, lambda v: v != 0)


def build_index(vectors: DataFrame, keep: int, *, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """A row per dimension and shard with its graph; ``keep``: ids of equal vectors that it holds at most."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & _valid("v"))
    same = W.partitionBy("v").orderBy("id")
    first = rows.withColumn("rn", F.row_number().over(same)).filter(F.col("rn") <= keep) if keep < 2 else rows.withColumn("rn", F.dense_rank().over(same)).filter(F.col("rn") <= keep)
    classes = written(first.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")), "vectors")
    shards = max(1, -(-classes.count() // shard_rows))
    dealt = classes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int").alias("shard"), "v", "ids")

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort([ids[0] for ids in part["ids"]], kind="stable")
        v = np.stack(part["v"].to_numpy()[order])
        ids = [part["ids"].iloc[i] for i in order]
        g = Graph.build(_unit(v))
        return pd.DataFrame(
            {"dim": [key[0]], "shard": [key[1]], "n": [len(v)], "entry": [g.entry], "vectors": [v.tobytes()], "near": [[a.tobytes() for a in g.near]],
             "members": [np.concatenate(ids).astype(np.int64).tobytes()], "sizes": [np.array([len(x) for x in ids], np.int32).tobytes()]}
        )

    schema = "dim int, shard int, n int, entry int, vectors binary, near array<binary>, members binary, sizes binary"
    return written(dealt.groupBy("dim", "shard").applyInPandas(build, schema), "graphs"), shards


def search(index: DataFrame, shards: int, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each query, itself left out."""
    rows = queries.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & _valid("v"))

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.assign(dim=part["v"].map(len))
            for dim, own in part.groupby("dim"):
                for at in range(0, len(own), QUERY_BLOCK):
                    b = own.iloc[at : at + QUERY_BLOCK]
                    yield pd.DataFrame({"dim": [dim], "ids": [b["id"].to_numpy(np.int64).tobytes()], "q": [np.stack(b["v"].to_numpy()).tobytes()]})

    blocks = rows.mapInPandas(pack, "dim int, ids binary, q binary").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                v = np.frombuffer(r.vectors, np.float64).reshape(r.n, r.dim)
                near = [np.frombuffer(a, np.int32).reshape(r.n, -1) for a in r.near]
                g = Graph(_unit(v), LINKS, near, r.entry)
                members, ends = np.frombuffer(r.members, np.int64), np.cumsum(np.frombuffer(r.sizes, np.int32))
                qs, ids = np.frombuffer(r.q, np.float64).reshape(-1, r.dim), np.frombuffer(r.ids, np.int64).tolist()
                out = []
                for q, unit, own in zip(qs, _unit(qs), ids):
                    found = np.array(g.nearest(unit))
                    score = cosines(v[found], q)
                    pairs = [(-s, m) for i, s in zip(found.tolist(), score.tolist()) for m in members[ends[i - 1] if i else 0 : ends[i]].tolist() if m != own]
                    out += [(own, m, -s) for s, m in heapq.nsmallest(k, pairs)]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = blocks.join(index, ["dim", "shard"]).mapInPandas(look, "query_id long, vec_id long, score double").distinct()
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, **columns) -> DataFrame:
    index, shards = build_index(vectors, k + 1, **columns)
    return search(index, shards, queries, k, **columns)

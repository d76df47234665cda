"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they count for). On that small table the driver
routes token capacity: each pattern offers its tokens once for each permitted epoch, at a convex cost (the first pass
is free, each repeat dearer than the one before), its flow goes to any of its sources, and a source takes no more than
its quota. The flow of a pattern says how often all of its documents are taken and how many tokens an additional
partial pass has; that pass takes documents in the order of a seeded hash.

The partial pass compares hash buckets with a threshold, so that a pattern with any share of all rows is decided
without gathering it; only the few buckets around the threshold are walked in order, to fit the rest exactly.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last; an empty table gives an
empty result; ties of the hash (one id, or a null one) are broken by size and text hash, so reruns agree whatever the
partitions; copies of a row are decided one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from chronolith.llm.common import kept

BUCKETS = 4096
#: Documents after the threshold from which the partial pass may fill what is missing.
TAIL_DOCS = 256
#: The aggregated patterns are gathered on the driver; more than so many are refused.
MAX_PATTERNS = 100_000


@F.pandas_udf(T.LongType())
def n_words(texts: pd.Series) -> pd.Series:
    """Runs of bytes other than space and 0x09-0x0D in UTF-8 texts; 0 for null."""
    return texts.map(lambda b: len(b.split()) if b is not None else 0).astype("int64")


def water_fill(total: float, weights: dict, caps: dict) -> dict:
    """Shares of ``total`` by weight; a share stops at its cap and the excess goes to the others by weight."""
    out, free = {}, set(weights)
    while free:
        left, w = total - sum(out.values()), sum(weights[s] for s in free)
        over = [s for s in free if w > 0 and left * weights[s] / w > caps[s]]
        if not over:
            out.update({s: left * weights[s] / w if w > 0 else 0.0 for s in free})
            break
        out.update({s: float(caps[s]) for s in over})
        free -= set(over)
    return out


def min_cost_flow(supply: dict, quota: dict, epoch_costs: tuple[int, ...]) -> dict:
    """Tokens from each pattern to each of its sources: as much as the quotas take, at the least cost of repeats.

    ``supply``: pattern (a tuple of sources) to tokens. Only the arcs into patterns cost anything, and more flow never
    takes back what a pattern gives, so the cheapest flow opens the epochs in the order of their costs and adds at each
    as much as fits: by blocking flows over shortest paths, whose number hardly depends on that of the patterns.
    """
    patterns, sources = list(supply), list(quota)
    start, end = len(patterns) + len(sources), len(patterns) + len(sources) + 1
    at = {s: len(patterns) + i for i, s in enumerate(sources)}
    graph: list[list[list]] = [[] for _ in range(end + 1)]

    def arc(u: int, v: int, cap: int) -> list:
        a, b = [v, cap, None], [u, 0, None]
        a[2], b[2] = b, a
        graph[u].append(a)
        graph[v].append(b)
        return a

    opened = [arc(start, i, 0) for i in range(len(patterns))]
    links = {(p, s): arc(i, at[s], 1 << 62) for i, p in enumerate(patterns) for s in p}
    for s in sources:
        arc(at[s], end, quota[s])

    def levels() -> list[int]:
        level, row, depth = [-1] * (end + 1), [start], 0
        level[start] = 0
        while row and level[end] < 0:
            depth += 1
            row = list(dict.fromkeys(a[0] for u in row for a in graph[u] if a[1] > 0 and level[a[0]] < 0))
            for v in row:
                level[v] = depth
        return level

    def block(level: list[int]) -> None:
        turn, u, path = [0] * (end + 1), start, []
        while True:
            if u == end:
                push = min(a[1] for a in path)
                for a in path:
                    a[1] -= push
                    a[2][1] += push
                u, path = start, []
            while turn[u] < len(graph[u]) and not (graph[u][turn[u]][1] > 0 and level[graph[u][turn[u]][0]] == level[u] + 1):
                turn[u] += 1
            if turn[u] < len(graph[u]):
                path.append(graph[u][turn[u]])
                u = path[-1][0]
            elif path:
                u = path.pop()[2][0]
                turn[u] += 1
            else:
                return

    for _ in sorted(epoch_costs):
        for a, p in zip(opened, patterns):
            a[1] += supply[p]
        while (level := levels())[end] > 0:
            block(level)
    return {k: a[2][1] for k, a in links.items()}


def _fit(tail: pd.DataFrame) -> pd.DataFrame:
    """In hash order, takes each document that still fits; what ties in all of these are copies of one row."""
    tail = tail.sort_values(["h", "size", "text_hash"], kind="stable")
    left, take = int(tail["rest"].iloc[0]) if len(tail) else 0, []
    for size in tail["size"]:
        take.append(0 < size <= left)
        left -= size if take[-1] else 0
    return pd.DataFrame({"row": tail["row"], "extra": pd.Series(take, index=tail.index).astype("int64")})


def mix(docs: DataFrame, members: Column, quotas_of, *, id_col: str = "doc_id", text_col: str = "text", epoch_costs: tuple[int, ...] = (0, 1, 4), seed: int = 7) -> tuple[DataFrame, dict, dict]:
    """Per row the copies that the mix takes; also the quota and the size of each source.

    ``members``: array of the sources of a row, nulls allowed. ``quotas_of``: from the size of each source (a dict,
    sorted by code point with null last) to target tokens. Returns rows (id, text_hash, nth, size, pattern, copies) and two dicts.
    """
    coded = F.transform(members, lambda s: F.when(s.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), s.cast("string"))))
    rows = kept(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            n_words(F.col(text_col).cast("binary")).alias("size"),
            F.array_sort(F.array_distinct(coded)).alias("members"),
            F.xxhash64(F.lit(seed), F.col(id_col).cast("string")).alias("h"),
            F.xxhash64(F.col(text_col)).alias("text_hash"),
        )
        .withColumn("pattern", F.concat_ws("\u0001", "members"))
        .withColumn("bucket", F.shiftrightunsigned("h", 52))
        .withColumn("nth", F.row_number().over(W.partitionBy("id", "text_hash").orderBy("pattern")))
    )
    per = rows.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("tokens")).limit(MAX_PATTERNS + 1).collect()
    if len(per) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    sizes: dict = {}
    for r in per:
        for s in r["members"]:
            sizes[s] = sizes.get(s, 0) + r["tokens"]
    sizes = dict(sorted(sizes.items(), key=lambda x: x[0]))
    plain = lambda s: None if s == "1" else s[1:]
    targets = quotas_of({plain(s): n for s, n in sizes.items()})
    by_key = {tuple(r["members"]): r for r in sorted(per, key=lambda r: r["pattern"])}
    flow = min_cost_flow({p: r["tokens"] for p, r in by_key.items()}, {s: round(targets[plain(s)]) for s in sizes}, epoch_costs)
    plan = []
    for p, r in by_key.items():
        took = sum(flow[p, s] for s in p)
        times, rest = divmod(took, r["tokens"]) if r["tokens"] else (0, 0)
        plan.append((r["pattern"], int(times), int(rest)))
    spark = docs.sparkSession
    plan_df = spark.createDataFrame(plan, "pattern string, times long, rest long")
    # where the partial pass of each pattern ends
    over = W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    sums = sums.withColumns({"before": F.coalesce(F.sum("size").over(over), F.lit(0)), "docs_before": F.coalesce(F.sum("docs").over(over), F.lit(0))}).join(F.broadcast(plan_df), "pattern")
    inside = F.col("before") + F.col("size") > F.col("rest")
    cut = sums.filter(inside).groupBy("pattern").agg(F.min("bucket").alias("cut"), F.min("docs_before").alias("cut_docs"), F.min("before").alias("cut_before"))
    ends = (
        sums.join(F.broadcast(cut), "pattern").filter((F.col("bucket") >= F.col("cut")) & (F.col("docs_before") < F.col("cut_docs") + TAIL_DOCS))
        .groupBy("pattern").agg(F.max("bucket").alias("last"), F.first("cut").alias("cut"), F.first("cut_before").alias("cut_before"))
    )
    decided = plan_df.join(ends, "pattern", "left").select("pattern", "times", (F.col("rest") - F.coalesce("cut_before", F.lit(0))).alias("rest"), F.coalesce("cut", F.lit(BUCKETS)).alias("cut"), F.coalesce("last", F.lit(BUCKETS)).alias("last"))
    marked = rows.join(F.broadcast(kept(decided)), "pattern")  # a row per pattern: bounded by MAX_PATTERNS
    in_tail = (F.col("bucket") >= F.col("cut")) & (F.col("bucket") <= F.col("last"))
    tail = marked.filter(in_tail).groupBy("pattern").applyInPandas(lambda t: _fit(t), "row long, extra long")
    copies = F.col("times") + F.coalesce(F.col("extra"), F.when(F.col("bucket") < F.col("cut"), 1).otherwise(0))
    taken = marked.join(tail, "row", "left").select("row", "id", "text_hash", "nth", "size", "pattern", copies.alias("copies"))
    return taken, targets, {plain(s): n for s, n in sizes.items()}


def by_rank(weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0):
    """Targets that share all tokens: the sources in order weigh ``weights``, repeating; each stops at ``cap`` times its size."""

    def targets(sizes: dict) -> dict:
        return water_fill(sum(sizes.values()), {s: weights[i % len(weights)] for i, s in enumerate(sizes)}, {s: cap * n for s, n in sizes.items()})

    return targets


def mix_by_source(docs: DataFrame, *, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """Each document belongs to one source: doc_id, size, source_size, target, taken, copies."""
    taken, targets, sizes = mix(docs, F.array(F.col(source_col)), by_rank(), id_col=id_col, text_col=text_col, seed=seed)
    rows = [("1" if s is None else "0" + s, int(sizes[s]), float(targets[s])) for s in sizes]
    info = docs.sparkSession.createDataFrame(rows, "pattern string, source_size long, target double")
    return taken.join(F.broadcast(info), "pattern").select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def select_mix(docs: DataFrame, *, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies``: how often each counts.

    Decisions come back to the texts by id, text hash and a number that tells copies of a row apart.
    """
    taken, _, _ = mix(docs, F.array(F.col(source_col)), by_rank(), id_col=id_col, text_col=text_col, seed=seed)
    named = taken.select(F.col("id").alias("__id"), F.col("text_hash").alias("__t"), F.col("nth").alias("__n"), F.col("copies").alias("__copies"))
    several = kept(named.filter("__n > 1").select("__id", "__t").distinct())
    d = docs.alias("d")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("__t"))
    columns = [*[F.col(f"d.`{c}`") for c in docs.columns if c != "copies"], F.col("__copies").alias("copies")]
    pick = named.filter("__copies > 0")
    if several.isEmpty():  # the texts move once, and need no order
        return d.join(pick, same).select(*columns)
    alone = d.join(several, same, "left_anti").join(pick, same).select(*columns)
    order = W.partitionBy(F.col(id_col), F.xxhash64(F.col(text_col))).orderBy(F.col(source_col).asc_nulls_last())
    numbered = d.join(several, same, "left_semi").withColumn("__nth", F.row_number().over(order)).alias("d")
    return alone.unionByName(numbered.join(pick, same & (F.col("d.__nth") == F.col("__n"))).select(*columns))

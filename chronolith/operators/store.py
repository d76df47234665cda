"""Keyed stores as tables: upserts, merges of runs with owners, subsets and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def upsert(old: DataFrame, batch: DataFrame, key: list[str], overwrite: bool = True) -> DataFrame:
    """The old rows without those whose key the batch has, and the batch; keys that repeat in the batch are refused.

    Without ``overwrite`` old rows win.
    """
    repeated = batch.groupBy(*key).count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"keys repeat in the batch: {repeated}")
    if overwrite:
        return old.join(batch.select(*key), key, "left_anti").unionByName(batch)
    return old.unionByName(batch.join(old.select(*key), key, "left_anti"))


def merge_runs(runs: list[tuple[str, DataFrame]], key: list[str], prefer: list[str]) -> DataFrame:
    """Rows of several runs; of a key that several have, that of the run named first in ``prefer``, with the number of owners."""
    rank = F.create_map(*[x for i, n in enumerate(prefer) for x in (F.lit(n), F.lit(i))])
    both = None
    for name, df in runs:
        own = df.withColumn("run", F.lit(name))
        both = own if both is None else both.unionByName(own)
    w = W.partitionBy(*key)
    r = both.withColumns({"rn": F.row_number().over(w.orderBy(F.coalesce(rank[F.col("run")], F.lit(len(prefer))), "run")), "owners": F.count("*").over(w)})
    return r.filter("rn = 1").drop("rn")


def subset(run: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the wanted keys, and the wanted keys that have none."""
    return run.join(ids.select(key).distinct(), key, "left_semi"), ids.select(key).distinct().join(run, key, "left_anti")


def merge_shards(shards: list[DataFrame], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """All rows, and the keys that occur in more than one place."""
    both = shards[0]
    for s in shards[1:]:
        both = both.unionByName(s)
    return both, both.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def left_join_controls(rows: DataFrame, controls: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows with the control value of their key and a status; keys that repeat among the controls are refused."""
    if controls.groupBy(*key).count().filter("count > 1").limit(1).collect():
        raise ValueError("control keys repeat")
    j = rows.join(controls.select(*key, value, F.lit(True).alias("__has")), key, "left")
    return j.withColumn("control_status", F.when(F.col("__has").isNull(), "missing").when(F.col(value).isNull(), "unavailable").otherwise("available")).drop("__has")

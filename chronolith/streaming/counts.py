"""Count-based windows and debounce, on ordered rows and as stateful streams.

Streams are ordered by an explicit sequence within their key. The stateful forms keep a few numbers (or the last
``length`` items) per key, whatever the stream's length; rows of one micro-batch are put in order before use.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W


def tumbling(rows: DataFrame, key: str, order: list[str], size: int, drop_last: bool = False) -> DataFrame:
    """Rows with ``chunk_index`` and ``padding`` (rows that its last chunk lacks); incomplete chunks go if asked."""
    w = W.partitionBy(key)
    r = rows.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    chunk = F.floor(F.col("__i") / size)
    missing = F.greatest(F.lit(0), (chunk + 1) * size - F.col("__n"))
    out = r.withColumns({"chunk_index": chunk, "padding": missing})
    return (out.filter("padding = 0") if drop_last else out).drop("__i", "__n")


def sliding(rows: DataFrame, key: str, order: list[str], value: str, length: int, stride: int) -> DataFrame:
    """A row each time a window of the last ``length`` rows fires: once full, then every ``stride`` rows."""
    w = W.partitionBy(key).orderBy(*order)
    seq = F.row_number().over(w)
    last = w.rowsBetween(1 - length, 0)
    r = rows.select(key, seq.alias("seq"), F.sum(value).over(last).alias("total"), F.max(value).over(last).alias("largest"))
    return r.filter((F.col("seq") >= length) & ((F.col("seq") - length) % stride == 0)).withColumn("seq", F.col("seq").cast("long"))


def keep_recent(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))).filter(F.col("__r") <= n).drop("__r")


class Debounce:
    """Fires after ``least`` triggers in a row, unless the last time is less than ``cooldown`` ago; then counts anew."""

    def __init__(self, least: int, cooldown: float, count: int = 0, last: float | None = None):
        self.least, self.cooldown, self.count, self.last = least, cooldown, count, last

    def push(self, time: float, triggered: bool) -> bool:
        self.count = self.count + 1 if triggered else 0
        if self.count < self.least or self.last is not None and time - self.last < self.cooldown:
            return False
        self.count, self.last = 0, time
        return True


def debounce(rows: DataFrame, key: str, seq: str, time: str, flag: str, least: int, cooldown: float) -> DataFrame:
    """The rows at which each key's debounce fires (``time`` in seconds); keys are read in order, one row at a time."""
    ordered = rows.select(key, F.col(seq).alias("seq"), F.col(time).cast("double").alias("time"), F.col(flag).cast("int").alias("flag"))
    placed = ordered.repartition(key).sortWithinPartitions(key, "seq")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for part in parts:
            out = []
            for k, s, t, f in part.itertuples(index=False):
                if k != current:
                    current, state = k, Debounce(least, cooldown)
                if state.push(t, bool(f)):
                    out.append((k, s, t))
            yield pd.DataFrame(out, columns=[key, "seq", "time"])

    return placed.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, seq long, time double")


def debounce_stream(rows: DataFrame, key: str, seq: str, time: str, flag: str, least: int, cooldown: float, tie: str | None = None) -> DataFrame:
    """``debounce`` for a streaming frame; the state of a key is its counter and the time it last fired.

    Rows of one ``seq`` come in order of ``tie``.
    """
    kind = dict(rows.dtypes)[key]

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, None)
        d, out = Debounce(least, cooldown, count, last), []
        for s, t, f in pd.concat(list(parts)).sort_values(["seq", "tie"])[["seq", "time", "flag"]].itertuples(index=False):
            if d.push(t, bool(f)):
                out.append((k[0], s, t))
        state.update((d.count, d.last))
        yield pd.DataFrame(out, columns=[key, "seq", "time"])

    slim = rows.select(key, F.col(seq).alias("seq"), F.col(time).cast("double").alias("time"), F.col(flag).cast("int").alias("flag"), F.col(tie or seq).alias("tie"))
    return slim.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, seq long, time double", "count long, last double", "append", GroupStateTimeout.NoTimeout)


def sliding_stream(rows: DataFrame, key: str, seq: str, value: str, length: int, stride: int, tie: str | None = None) -> DataFrame:
    """``sliding`` for a streaming frame; the state of a key is its last ``length`` values and how many there were.

    Rows of one ``seq`` come in order of ``tie``.
    """
    kind = dict(rows.dtypes)[key]

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, n = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out = []
        for v in pd.concat(list(parts)).sort_values(["seq", "tie"])["value"]:
            kept = [*kept, int(v)][-length:]
            n += 1
            if n >= length and (n - length) % stride == 0:
                out.append((k[0], n, sum(kept), max(kept)))
        state.update((kept, n))
        yield pd.DataFrame(out, columns=[key, "seq", "total", "largest"])

    slim = rows.select(key, F.col(seq).alias("seq"), F.col(value).cast("long").alias("value"), F.col(tie or seq).alias("tie"))
    return slim.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, seq long, total long, largest long", "kept array<long>, n long", "append", GroupStateTimeout.NoTimeout)


def out_of_order(rows: DataFrame, key: str, arrival: list[str], step: str) -> DataFrame:
    """Rows whose step isn't above all steps of their key that arrived before, with the highest of those."""
    before = F.max(step).over(W.partitionBy(key).orderBy(*arrival).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("highest_before", before).filter(F.col(step) <= F.col("highest_before"))


def window_counts(rows: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Rows per event-time window and value, with a watermark; the same on streams and tables."""
    r = rows.withColumn("__t", F.col(time).cast("timestamp"))
    return r.withWatermark("__t", late).groupBy(F.window("__t", width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an append stream over what is there now into a Parquet folder, and reads it."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)

"""The driver's tables as temporal entities, in DataFrame form; ``SQL`` has the same views for other engines."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SQL = {
    "clip": """SELECT video_id, clip_index, clip_index*8 AS frame_start, clip_index*8+16 AS frame_end, score_c, alt_c, y FROM (
  SELECT l_orderkey AS video_id, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS clip_index,
  CAST(ROUND(l_discount*100) AS BIGINT) AS score_c, CAST(ROUND(l_tax*100) AS BIGINT) AS alt_c, CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS y FROM lineitem) t""",
    "video": "SELECT video_id, MAX(y) AS weak_label, MAX(frame_end) AS num_frames, COUNT(*) AS clips FROM clip GROUP BY video_id",
    "annotation": "SELECT video_id, clip_index AS ann_ord, frame_start+2 AS span_start, frame_start+10 AS span_end, y AS is_anomaly FROM clip WHERE y=1 OR MOD(clip_index,3)=0",
    "tile": "SELECT video_id, clip_index*8 AS frame_start, clip_index*8+8 AS frame_end, y AS label, score_c AS dense_c, alt_c AS method_c FROM clip",
    "stream_event": "SELECT user_id AS stream_id, event_id, ts, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, CASE WHEN event_type='error' THEN 1 ELSE 0 END AS triggered, CAST(ROUND(value*100) AS BIGINT) AS value_c FROM events",
    "probe": "SELECT event_type AS site, user_id AS video_id, CAST(ts AS DATE) AS clip_id, MOD(user_id,2) AS weak_label, CAST(ROUND(value*100) AS BIGINT) AS value_c FROM events",
    "token": "SELECT vec_id AS token_id, CAST(FLOOR(vec_id/10) AS BIGINT) AS group_id, CAST(FLOOR(vec_id/2) AS BIGINT) AS pair_id, label, embedding FROM embeddings",
}
NEEDS = {"video": ["clip"], "annotation": ["clip"], "tile": ["clip"]}


def with_views(*names: str) -> str:
    """A WITH clause that defines the views, each after those it needs."""
    order: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order)


#: Rows of a table that a task takes where they are dealt by key.
TASK_ROWS = 250_000


def tasks(df: DataFrame) -> int:
    """As many tasks as the rows need, and no fewer than the session's number of partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` where its rows need more tasks than the session's number of partitions.

    What is grouped or ordered by the key afterwards stays in those tasks, so their memory doesn't grow with the table.
    """
    parts = tasks(df)
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


class Bindings:
    """Lazily bound views of the tables in a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def clip_tasks(self) -> int:
        return tasks(self.table("lineitem"))

    @cached_property
    def clip(self) -> DataFrame:
        order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        rows = dealt(self.table("lineitem"), "l_orderkey").select(
            F.col("l_orderkey").alias("video_id"),
            (F.row_number().over(order) - 1).cast("long").alias("clip_index"),
            F.round(F.col("l_discount") * 100).cast("long").alias("score_c"),
            F.round(F.col("l_tax") * 100).cast("long").alias("alt_c"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        )
        start = F.col("clip_index") * 8
        return rows.select("video_id", "clip_index", start.alias("frame_start"), (start + 16).alias("frame_end"), "score_c", "alt_c", "y")

    @cached_property
    def video(self) -> DataFrame:
        return self.clip.groupBy("video_id").agg(F.max("y").alias("weak_label"), F.max("frame_end").alias("num_frames"), F.count("*").alias("clips"))

    @cached_property
    def annotation(self) -> DataFrame:
        rows = self.clip.filter((F.col("y") == 1) | (F.col("clip_index") % 3 == 0))
        return rows.select("video_id", F.col("clip_index").alias("ann_ord"), (F.col("frame_start") + 2).alias("span_start"), (F.col("frame_start") + 10).alias("span_end"), F.col("y").alias("is_anomaly"))

    @cached_property
    def tile(self) -> DataFrame:
        start = F.col("clip_index") * 8
        return self.clip.select("video_id", start.alias("frame_start"), (start + 8).alias("frame_end"), F.col("y").alias("label"), F.col("score_c").alias("dense_c"), F.col("alt_c").alias("method_c"))

    @cached_property
    def stream_event(self) -> DataFrame:
        return dealt(self.table("events"), "user_id").select(
            F.col("user_id").alias("stream_id"), "event_id", "ts",
            F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("triggered"),
            F.round(F.col("value") * 100).cast("long").alias("value_c"),
        )

    @cached_property
    def probe(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("site"), F.col("user_id").alias("video_id"), F.to_date("ts").alias("clip_id"), (F.col("user_id") % 2).alias("weak_label"), F.round(F.col("value") * 100).cast("long").alias("value_c"))

    @cached_property
    def token(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("token_id"), F.floor(F.col("vec_id") / 10).alias("group_id"), F.floor(F.col("vec_id") / 2).alias("pair_id"), "label", "embedding")

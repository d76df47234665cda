"""Near-duplicate pairs of digests at aligned positions, blocked by slices of the digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: Keys of one slice that meet in one chunk of it.
CHUNK = 256


def block_pairs(digests: DataFrame, key: str, pos: str, digest: str, blocks: int = 4, width: int = 8, radius: int = 6, least: int = 4, run: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Pairs of keys with a block in common, that match within ``radius`` bits at ``least`` positions, ``run`` of them in a row.

    Equal digests meet once for each distinct digest: keys are paired only through blocks, and a pair is compared at
    the positions that both have. The digests are hexadecimal, ``blocks`` slices of ``width`` digits. The keys of a slice
    are dealt to chunks of about ``chunk`` and chunks meet in pairs, so a crowded slice is spread over many tasks.
    """
    from chronolith.functions.text import hamming_hex

    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.struct(i.alias("blk"), F.substring(F.col(digest), i * width + 1, F.lit(width)).alias("slice"))))
    rows = digests.select(key, pos, cut.alias("c")).select(key, pos, "c.*")
    shared = rows.groupBy(pos, "blk", "slice").agg(F.count_distinct(key).alias("n")).filter("n > 1")
    rows = rows.join(shared.withColumn("last", F.floor((F.col("n") - 1) / chunk)), [pos, "blk", "slice"])
    rows = rows.select(key, pos, "blk", "slice", "last", F.pmod(F.xxhash64(key), F.col("last") + 1).alias("c")).distinct()
    # chunk c is the first of the pairs (c, c) to (c, last) and the second of (0, c) to (c, c)
    ones = rows.select(key, pos, "blk", "slice", F.col("c").alias("i"), F.explode(F.sequence("c", "last")).alias("j"))
    others = rows.select(F.col(key).alias("other"), pos, "blk", "slice", F.explode(F.sequence(F.lit(0).cast("long"), "c")).alias("i"), F.col("c").alias("j"))
    met = ones.join(others, [pos, "blk", "slice", "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col(key) < F.col("other")))
    pairs = met.select(F.least(key, "other").alias(key), F.greatest(key, "other").alias("other")).distinct()
    a = digests.select(key, pos, F.col(digest).alias("da"))
    b = digests.select(F.col(key).alias("other"), pos, F.col(digest).alias("db"))
    same = pairs.join(a, key).join(b, ["other", pos]).withColumn("match", (hamming_hex(F.col("da"), F.col("db")) <= radius).cast("int"))
    # a position that one of both lacks ends a row of matches
    w = W.partitionBy(key, "other").orderBy(pos)
    islands = same.filter("match = 1").withColumn("off", F.col(pos) - F.row_number().over(w)).groupBy(key, "other", "off").agg(F.sum("match").alias("len"))
    return islands.groupBy(key, "other").agg(F.sum("len").alias("matches"), F.max("len").alias("longest")).filter((F.col("matches") >= least) & (F.col("longest") >= run))

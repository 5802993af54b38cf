"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone (the law `key`): no ring or table is kept, shards
hold nearly equal numbers of keys, and when one shard is appended, only rows that go to it move.

Within a shard every row has a slot, without gaps from 0. Slots need no sort of a whole shard: rows are counted by
(shard, bucket), where the bucket comes from a second hash; the counts' running sums give each bucket its first slot,
and rows are numbered within their bucket only. Rows alike in key, size and checksum are counted before they are
dealt out and numbered together, so a key that very many rows share doesn't make a large bucket.

Defined results: a null key is a key of its own (hash of no value); repeated rows get slots of their own; null text
has size 1 and checksum 0; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import written

SHARDS, BUCKETS = 16, 1024
#: Rows alike are given out in pieces of at most so many, which are then dealt anew.
PIECE = 10_000
STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key (unsigned 64 bits): all keys jump together until each would jump past the end."""
    keys = keys.astype(np.uint64)
    at, to = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    going = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(going):
            at[going] = to[going]
            keys[going] = keys[going] * STEP + np.uint64(1)
            jump = (at[going] + 1) * (float(1 << 31) / ((keys[going] >> np.uint64(33)).astype(np.float64) + 1.0))
            to[going] = jump.astype(np.int64)
            going = going[to[going] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a 64-bit hash of a key."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy().view(np.uint64), shards).astype(np.int32))

    return jump(key)


def assign_shards(rows: DataFrame, key: str, shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """Every row of rows (a narrow table) with shard, slot and grown_shard (the shard if there were one more).

    All columns of rows must be of types that can be grouped by; rows alike in all of them are numbered together.
    """
    names = rows.columns
    alike = rows.groupBy(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).agg(F.count(F.lit(1)).alias("copies"))
    hashed = alike.withColumn("key_hash", F.xxhash64(F.col(f"row.`{key}`"))).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    placed = written(hashed.select("row", "copies", "bucket", shard_of(F.col("key_hash"), shards).alias("shard"), shard_of(F.col("key_hash"), shards + 1).alias("grown_shard")), "shard-rows")
    sums = placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    first = sums.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"))
    within = F.sum("copies").over(Window.partitionBy("shard", "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = placed.withColumn("start", within - F.col("copies")).join(first, ["shard", "bucket"])
    start = F.col("first") + F.col("start")
    few = numbered.where(F.col("copies") <= PIECE).select("row", "shard", "grown_shard", start.alias("start"), "copies")
    many = numbered.where(F.col("copies") > PIECE).select("row", "shard", "grown_shard", start.alias("start"), "copies")
    many = many.select("row", "shard", "grown_shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("copies") - 1, F.lit(PIECE).cast("long"))).alias("from"), (F.col("start") + F.col("copies")).alias("end"))
    many = many.select("row", "shard", "grown_shard", F.col("from").alias("start"), F.least(F.lit(PIECE).cast("long"), F.col("end") - F.col("from")).alias("copies")).repartition("shard", "start")
    each = few.unionByName(many).withColumn("slot", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("copies") - 1)))
    return each.select("row.*", "shard", "slot", "grown_shard")

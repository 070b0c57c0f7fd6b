"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import with_rank

#: Fixed multiplier of the published algorithm's linear congruential step.
STEP = 2862933555777941757


def jump(keys, shards: int):
    """Shards of 64-bit keys. With one more shard a key stays or moves into the new one."""
    import numpy as np

    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    at, nxt = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    todo = np.arange(len(key))
    while len(todo):
        at[todo] = nxt[todo]
        key[todo] = key[todo] * np.uint64(STEP) + np.uint64(1)
        share = (key[todo] >> np.uint64(33)).astype(np.float64) + 1
        nxt[todo] = ((at[todo] + 1) * (float(1 << 31) / share)).astype(np.int64)
        todo = todo[nxt[todo] < shards]
    return at.astype(np.int32)


def shard_column(key, shards: int):
    """A column with the shard of a key column of any type; a null key counts as one key of its own."""
    @F.pandas_udf(IntegerType())
    def of(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(), shards))

    return of(F.xxhash64(key))


def shard(df: DataFrame, key: str, shards: int, grown: int | None = None) -> DataFrame:
    """Adds shard, slot (gapless from 0 in its shard) and, if asked, grown_shard for `grown` shards.

    The shard depends on the key and the shard count alone. Equal keys share a shard; a null key is a key.
    Repeated rows get slots of their own, in no promised order. An empty table gives an empty one. Columns
    already named shard, slot or grown_shard are replaced. Nothing but the rows themselves is shuffled, and
    no task sees a whole shard.
    """
    df = df.drop("shard", "slot", "grown_shard")
    placed = df.withColumn("shard", shard_column(F.col(key), shards))
    if grown is not None:
        placed = placed.withColumn("grown_shard", shard_column(F.col(key), grown))
    return with_rank(placed, ["shard"], "slot", "shard")


def write_shards(df: DataFrame, path: str, key: str, shards: int) -> None:
    """Writes the rows themselves, one folder a shard; several tasks may write into one folder."""
    df.drop("shard").withColumn("shard", shard_column(F.col(key), shards)).write.partitionBy("shard").parquet(path)


def op1_jump_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39, and where they would be among 41. A null text has no bytes (CRC-32 0)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = shard(keyed, "doc_id", 40, 41)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")

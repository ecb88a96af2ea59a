"""Jump consistent hashing (Lamping and Veach): keys to shards without a ring table.

Going from n to n + 1 shards moves a key only into shard n, and only the 1/(n + 1)
of all keys that this shard must hold.

Defined cases. A null key is a key like any other (one fixed hash). Rows with equal
keys share a shard. An empty table gives an empty table. Columns of the input that
are called like an output column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_bytes, written

#: Rows that one slot-numbering task is meant to hold.
ROWS_PER_BUCKET = 100_000


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The published algorithm over an array of 64-bit keys; n_shards >= 1."""
    key = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    jump = np.zeros(len(key), np.int64)
    todo = np.arange(len(key))
    while len(todo):
        shard[todo] = jump[todo]
        key[todo] = key[todo] * np.uint64(2862933555777941757) + np.uint64(1)
        top = (key[todo] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[todo] = ((shard[todo] + 1) * (float(1 << 31) / top)).astype(np.int64)
        todo = todo[jump[todo] < n_shards]
    return shard


def jump_shard(key: str | Column, n_shards: int) -> Column:
    """The shard of a stable key of any hashable type, from 0 to n_shards - 1."""
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")

    @F.pandas_udf("int")
    def shard(h: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(h.to_numpy(), n_shards)).astype("int32")

    return shard(F.xxhash64(key))


def with_slots(df: DataFrame, shard: str, keys: list[str], rows: int | None = None) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, as column slot.

    keys: columns that tell rows apart; rows that agree in all of them and in the shard
    must be equal, and are numbered next to each other. Equal rows are folded to one with
    a count before the shuffle, each shard is dealt to hash buckets of a bounded size, and
    the buckets' totals, summed up per shard, give each bucket its first slot.
    """
    cols = list(dict.fromkeys([shard, *keys]))
    rows = df.count() if rows is None else rows
    buckets = max(1, rows // ROWS_PER_BUCKET)
    folded = (
        df.select(*cols).groupBy(*cols).agg(F.count("*").alias("__n"))
        .withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    )
    within = Window.partitionBy(shard, "__bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    numbered = folded.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        folded.groupBy(F.col(shard).alias("__s"), F.col("__bucket").alias("__b")).agg(F.sum("__n").alias("__t"))
        .select("__s", "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__first"))
    )
    joined = numbered.join(firsts, (F.col(shard) == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    base = (F.col("__first") + F.col("__before")).cast("long")
    return joined.select(*cols, F.explode(F.sequence(base, base + F.col("__n") - 1)).alias("slot"))


def assign_shards(df: DataFrame, key: str, n_shards: int, name: str = "shard") -> DataFrame:
    """df with the shard of each row."""
    return df.withColumn(name, jump_shard(key, n_shards))


def shard_report(docs: DataFrame, n_shards: int) -> DataFrame:
    """One row per document: its size, its shard under the law `key`, its slot there, and
    its shard if there were one more."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (n_bytes("text") + 16).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    keys, rows = ["doc_id", "size", "text_crc32"], written(rows, "shard-rows")  # so texts are read once
    dealt = assign_shards(assign_shards(rows, "doc_id", n_shards), "doc_id", n_shards + 1, "grown_shard")
    out = with_slots(dealt, "shard", [*keys, "grown_shard"], rows.count())
    return out.select(*keys, F.lit("key").alias("law"), "shard", "slot", "grown_shard")

"""Incremental runs: triples as they come, and slices of state merged once each.

Checkpoints of the streams replace the flags that mark a slice as processed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import ALIASES, TRIPLES, normalised_triples


def triple_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Triples of JSON files as they appear in a folder."""
    rows = spark.readStream.schema(f"{TRIPLES}, {ALIASES}").option("maxFilesPerTrigger", per_trigger).json(folder)
    return normalised_triples(rows)


def support_stream(triples: DataFrame) -> DataFrame:
    """Running support of each edge."""
    return triples.groupBy("subj", "obj", "rel").agg(F.count("*").alias("support"))


def merge_support(state: DataFrame | None, new: DataFrame) -> DataFrame:
    """Support of old and new triples together; merging slice by slice gives what one batch gives."""
    counted = new.groupBy("subj", "obj", "rel").agg(F.count("*").alias("support"))
    both = counted if state is None else state.select("subj", "obj", "rel", "support").unionByName(counted)
    return both.groupBy("subj", "obj", "rel").agg(F.sum("support").alias("support"))


#: Batches after which their counts are folded into a base.
COMPACT = 50


def _parts(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """The numbers of the bases and of the batches that are complete under path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"base": [], "batch": []}
    for f in fs.listStatus(p) if fs.exists(p) else []:
        kind, _, number = f.getPath().getName().partition("=")
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")
        if kind in found and number.isdigit() and fs.exists(done):
            found[kind].append(int(number))
    return sorted(found["base"]), sorted(found["batch"])


def _support(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """The support of the newest base, and of the batches after it, up to one."""
    bases, batches = _parts(spark, path)
    bases = [b for b in bases if upto is None or b <= upto]
    names = [f"{path}/base={b}" for b in bases[-1:]]
    names += [f"{path}/batch={b}" for b in batches if (not bases or b > bases[-1]) and (upto is None or b <= upto)]
    if not names:
        return None
    rows = spark.read.schema("subj string, obj string, rel string, support long").parquet(*names)
    return rows.groupBy("subj", "obj", "rel").agg(F.sum("support").alias("support"))


def _fold(spark: SparkSession, path: str, number: int) -> None:
    """Write the base of all batches up to a number, and delete what the base before it has folded;
    that base and its later batches stay for those who are reading them."""
    bases, batches = _parts(spark, path)
    _support(spark, path, number).write.mode("overwrite").parquet(f"{path}/base={number}")
    old = [b for b in bases if b < number]
    for name in [f"base={b}" for b in old[:-1]] + [f"batch={b}" for b in batches if old and b <= old[-1]]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def merge_slices(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, compact: int = COMPACT) -> StreamingQuery:
    """Add each batch of a triple stream to the support table under path. A batch writes its own
    counts under its number, so one that is repeated after a failure writes the same again; every
    `compact` batches they are folded into a base. No batch rewrites the table."""

    def merge(batch: DataFrame, number: int) -> None:
        merge_support(None, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number % compact == compact - 1:
            _fold(batch.sparkSession, path, number)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_support(spark: SparkSession, path: str) -> DataFrame:
    """The support table as of the last complete batch."""
    found = _support(spark, path)
    return spark.createDataFrame([], "subj string, obj string, rel string, support long") if found is None else found

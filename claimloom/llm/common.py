"""Shared helpers: reading tables, cutting lineage, writing tables that all executors see."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Separators of words: space and the ASCII controls tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Most texts, and bytes, that an Arrow batch brings to a Python worker at once.
BATCH_TEXTS, BATCH_BYTES = 1000, 16 << 20

_LOCAL_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, a temporary folder is used if the session is
    local (tests); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="claimloom-")
    return _LOCAL_DIRS[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended already; the folder is temporary
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: the lineage ends here
    and a lost executor costs nothing. The files are deleted when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/claimloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of this session to BATCH_TEXTS rows and BATCH_BYTES, as Spark's default of
    10,000 long texts takes most of a worker's memory. Lower settings stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_TEXTS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now. It does so when the driver's JVM
    collects the plans, which an idle driver may not do while the executors' disks fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_written(df: DataFrame) -> None:
    """Delete a table made by written() that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def columns(df: DataFrame) -> list[Column]:
    """The columns of df, whatever their names are."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def n_bytes(text: str | Column) -> Column:
    """UTF-8 bytes of a text; null counts none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def n_words(text: str | Column) -> Column:
    """Words between ASCII white space; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def hash_sample(rows: DataFrame, n: int, key: list, seed: int) -> DataFrame:
    """At most n rows, those with the least hash of key, in its order. Rows that are far above
    that are filtered out where they are read, so tasks send the driver about 2 n rows in all."""
    spread = F.xxhash64(*key, F.lit(seed))
    total = rows.count()
    if total > 4 * n:
        rows = rows.filter(F.pmod(spread, F.lit(1 << 30)) < int((1 << 30) * 2 * n / total))
    return rows.orderBy(F.pmod(spread, F.lit(1 << 30)), *rows.columns).limit(n)


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with the column __doc, a long in the order of documents. It is doc_id if that is
    there and tells rows apart; else documents are numbered by doc_id and their texts' hashes,
    and rows that are equal in both have the same number. Ranges of that order are numbered
    apart, and start where the counts of those before end."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if not ids.filter((F.col("n") > 1) | F.col("doc_id").isNull()).limit(1).count():
        return docs.withColumn("__doc", F.col("doc_id").cast("long")), False
    key = F.struct(F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("a"), F.md5("text").alias("b"))
    parts = shuffle_partitions(docs.sparkSession)
    keys = docs.select(key.alias("__k")).distinct().repartitionByRange(parts, "__k").withColumn("__p", F.spark_partition_id())
    keys = written(keys, "numbered")
    counts = keys.groupBy(F.col("__p").alias("__q")).agg(F.count("*").alias("n"))
    before = counts.select("__q", F.coalesce(F.sum("n").over(Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    at = F.row_number().over(Window.partitionBy("__p").orderBy("__k"))
    numbers = keys.withColumn("__r", at).join(before, F.col("__p") == F.col("__q")).select("__k", (F.col("__b") + F.col("__r")).cast("long").alias("__doc"))
    return docs.withColumn("__key", key).join(numbers, F.col("__key").eqNullSafe(F.col("__k"))).drop("__key", "__k"), True

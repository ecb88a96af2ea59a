"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, served again from the
start when it ends, up to `max_epochs` times. A document's virtual finish time is the
words its source has sent up to and with it, divided by the source's target. Documents
are sorted by finish time over all sources, in ranges, and taken in this order until the
total budget is reached, so every source stands near its target whenever the queue is cut.

Targets: the budget is shared by weight; a source whose share is over `max_epochs` times
its size gets that much, and the excess is shared again by weight among the others until
none is above. So a target is the lesser of that and of the weight times one level, which
is found by sums over the sources.

Texts are read once for their words. What is queued, sorted and cut is a table of sizes; the
texts are joined to what it says at the end.

Defined cases. A null source is a source like any other, the last in order. Null and
blank texts have size 0; with target 0 or size 0 a source has no document taken. Repeated
rows are queued one after the other. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, n_words, numbered, written

#: Weights of the sources in code point order, repeated as often as needed.
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MAX_EPOCHS = 2
ROWS_PER_BUCKET = 5_000
#: Queued documents that a range of finish times is meant to hold.
ROWS_PER_RANGE = 200_000


def share(sizes: list[float], weights: list[float], budget: float, most: float) -> list[float]:
    """Targets: budget by weight, none above most times its size."""
    caps = [most * s for s in sizes]
    out: list[float] = [0.0] * len(sizes)
    left, free = float(budget), [i for i in range(len(sizes)) if caps[i] > 0 and weights[i] > 0]
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > caps[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(caps[i])
        left -= sum(caps[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target), as share() has it. Only sums over
    the sources reach the driver."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    named = written(sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)), "mix-sources")
    live = named.filter("cap > 0 and weight > 0")
    total = float(budget) * float(named.agg(F.sum("source_size")).first()[0] or 0)
    level, left = 0.0, True
    while left:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        capped, free = live.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if not free:
            level = float("inf")
            break
        last, level = level, (total - (capped or 0.0)) / free
        left = level > last
    target = F.when((F.col("cap") > 0) & (F.col("weight") > 0), F.least("cap", F.col("weight") * F.lit(level))).otherwise(F.lit(0.0))
    return named.select("source", "source_size", target.alias("target"))


def fair_queue(docs: DataFrame, key: list[str], source: str = "source", weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """docs (key, source, size) with source_size, target, and taken: how often each row is taken.

    size: the words of a row. key: columns that tell rows apart; the MD5 of them and the seed is
    the shuffled order. Sources are dealt to buckets of a bounded number of rows by ranges of
    this order, so a source with a third of all rows is many tasks; the buckets' sums, added up
    per source, start each bucket.
    """
    rows = docs.select(*key, F.col(source).alias("s"), "size", F.md5(F.concat_ws(":", F.lit(str(seed)), *key)).alias("place"))
    buckets = docs.count() // ROWS_PER_BUCKET + 1
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * buckets / F.lit(float(1 << 32))).cast("long"))
    cells = written(rows.groupBy("s", "bucket").agg(F.sum("size").alias("sum")), "mix-cells")
    goals = targets(cells.groupBy(F.col("s").alias("source")).agg(F.sum("sum").alias("source_size")), weights, budget, max_epochs)
    goals = written(goals, "mix-targets")
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(F.col("s").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("s", "bucket").orderBy("place", *key).rowsBetween(Window.unboundedPreceding, 0)
    queue = rows.withColumn("sent", F.sum("size").over(within)).join(starts, F.col("s").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
    queue = queue.join(goals, F.col("s").eqNullSafe(F.col("source")))
    # repeated rows have the same key and place, and are told apart by what was sent before
    queue = written(queue.select(*key, F.col("s").alias(source), "size", "place", (F.col("start") + F.col("sent")).alias("sent"), "source_size", "target"), "mix-queue")
    served = queue.filter("target > 0 and size > 0")
    finish = (F.col("sent") + F.col("epoch") * F.col("source_size")) / F.col("target")
    times = served.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).select(finish.alias("finish"), F.col(source).alias("s"), "sent", "epoch", "size")
    order = ["finish", "s", "sent", "epoch"]
    ranges = times.count() // ROWS_PER_RANGE + 1
    ranged = written(times.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "mix-times")
    sums = ranged.groupBy(F.col("range").alias("r")).agg(F.sum("size").alias("n"))
    sums = sums.select("r", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    so_far = F.sum("size").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    total = budget * (goals.agg(F.sum("source_size")).first()[0] or 0)
    sent = ranged.withColumn("so_far", so_far).join(sums, F.col("range") == F.col("r")).filter(F.col("before") + F.col("so_far") <= F.lit(total))
    sent = sent.groupBy(F.col("s").alias("s2"), F.col("sent").alias("sent2")).agg(F.count("*").alias("n"))
    out = queue.join(sent, F.col(source).eqNullSafe(F.col("s2")) & (F.col("sent") == F.col("sent2")) & (F.col("size") > 0), "left")
    return out.select(*key, source, "size", "source_size", "target", F.coalesce("n", F.lit(0)).alias("taken"))


def sized(docs: DataFrame, key: list) -> DataFrame:
    """(key, source, size) of docs, from one reading of the texts."""
    return written(docs.select(*key, "source", n_words("text").alias("size")), "mix-sizes")


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words taken."""
    rows = sized(docs, [F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("__text")])
    out = fair_queue(rows, ["doc_id", "__text"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("taken")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with docs' columns."""
    rows, again = numbered(docs)
    if again:  # rows that are told apart by nothing are numbered where they are written
        rows = written(docs.select(F.struct(*columns(docs)).alias("x")).withColumn("__doc", F.monotonically_increasing_id()), "mix-rows")
        rows = rows.select("x.*", "__doc")
    taken = fair_queue(sized(rows, ["__doc"]), ["__doc"], **params).filter("taken > 0").select(F.col("__doc").alias("__d"), F.col("taken").alias("__taken"))
    out = rows.join(taken, F.col("__doc") == F.col("__d")).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__taken").cast("int"))))
    return out.select(*columns(docs))

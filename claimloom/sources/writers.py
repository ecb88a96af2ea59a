"""Writers of the pipeline's files. Parquet is the store; the other forms are for reading elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def topic_list(topics: DataFrame, path: str) -> None:
    """topic, depth with tabs between, by depth."""
    order = [c for c in ("depth", "seq", "topic") if c in topics.columns]
    topics.orderBy(*order).select("topic", "depth").write.mode("overwrite").csv(path, sep="\t")


def text_list(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def local_models(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One nested JSON row a model, in a folder a focus; the file name is a column."""
    docs = graph.lcm_documents(nodes, edges).withColumn("file", graph.lcm_file()).withColumn("slug", X.focus_slug("focus"))
    docs.write.mode("overwrite").partitionBy("slug").json(path)


def report_table(df: DataFrame, path: str) -> None:
    """CSV files with a header, one for each partition of df, so a large table is many tasks."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_document(df: DataFrame, path: str) -> None:
    """One JSON array of the rows, in their order, of a frame behind a picture, such as hover
    clusters: a few rows, which are brought together."""
    rows = df.sparkSession.createDataFrame([("[" + ", ".join(df.toJSON().collect()) + "]",)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(path)


def state(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def append_slice(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """A timestamped copy of the state, as a partition of each of its tables."""
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")


def append_rows(df: DataFrame, path: str) -> None:
    """Rows of a manifest, of labels, or of usage."""
    df.write.mode("append").parquet(path)


def run_id(seconds_column: str = "now") -> str:
    """The SQL of a slice's time stamp."""
    return f"date_format({seconds_column}(), \"yyyy-MM-dd'T'HH-mm-ss\")"

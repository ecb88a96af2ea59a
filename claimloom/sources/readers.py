"""Readers of the pipeline's files. Every row gets seq, a number that follows the order of files and
of lines, since first and last sight matter later."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pdf
from ..functions import text as X

TOPICS = "topic string, parent string, depth int"
QUESTIONS = "topic string, path array<string>, questions array<string>"
STATEMENTS = "topic string, path array<string>, question string, statements array<string>"
TRIPLES = "topic string, path array<string>, question string, statement string, subj string, rel string, obj string, domain string"
ALIASES = "source string, target string, relation string, head string, tail string, src string, dst string, predicate string"
LCM = "focus string, radius int, nodes array<string>, edges array<struct<src:string,dst:string,rel:string>>, meta map<string,string>"


def with_seq(df: DataFrame) -> DataFrame:
    """df with seq. A file's blocks follow one another, and rows within a block have rising ids."""
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    return df.withColumn("_at", at)


def numbered(df: DataFrame) -> DataFrame:
    """seq from _at: blocks are counted, and each starts where those before end."""
    block = [F.col("_at.f"), F.col("_at.b")]
    counts = df.groupBy(F.col("_at.f").alias("f"), F.col("_at.b").alias("b")).agg(F.count("*").alias("n"), F.min("_at.m").alias("m0"))
    w = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    starts = counts.select("f", "b", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"), "m0")
    own = F.row_number().over(Window.partitionBy(*block).orderBy("_at.m")) - 1
    rows = df.withColumn("_own", own)
    out = rows.join(starts, (F.col("_at.f") == F.col("f")) & (F.col("_at.b") == F.col("b")))
    return out.withColumn("seq", (F.col("start") + F.col("_own")).cast("long")).drop("_at", "_own", "f", "b", "start", "m0")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line fails the read, blank ones are skipped."""
    return numbered(with_seq(spark.read.schema(schema).option("mode", "FAILFAST").json(path)))


def root_topics(spark: SparkSession, path: str) -> DataFrame:
    """(seq, topic): lines that are not blank and no comments. An empty list is an error."""
    rows = numbered(with_seq(spark.read.text(path))).select("seq", X.strip("value").alias("topic"))
    rows = root_topic_rows(rows)
    if not rows.take(1):
        raise ValueError(f"no topics in {path}")
    return rows


def root_topic_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("topic", X.strip("topic")).filter((F.col("topic") != "") & ~F.col("topic").startswith("#"))


def topics(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, TOPICS)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(seq, topic, path, pos, question)."""
    return _json(spark, path, QUESTIONS).select("seq", "topic", "path", F.posexplode("questions").alias("pos", "question"))


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(seq, topic, path, question, pos, statement)."""
    return _json(spark, path, STATEMENTS).select("seq", "topic", "path", "question", F.posexplode("statements").alias("pos", "statement"))


def normalised_triples(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Triples under their own names. An alias counts where the name before it is missing or
    empty; strict: no aliases. Rows without subject or object go."""
    names = {"subj": ["subj", "source", "head", "src"], "obj": ["obj", "target", "tail", "dst"], "rel": ["rel", "relation", "predicate"]}
    pick = lambda ns: F.coalesce(*[X.empty_as_null(n) for n in ns if n in rows.columns], F.lit(None).cast("string"))
    out = rows
    for name, ns in names.items():
        out = out.withColumn(name, pick(ns[:1] if strict else ns))
    drop = [n for ns in names.values() for n in ns[1:] if n in rows.columns]
    return out.drop(*drop).withColumn("rel", F.coalesce("rel", F.lit(""))).filter("subj is not null and obj is not null")


def triples(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return normalised_triples(_json(spark, path, f"{TRIPLES}, {ALIASES}"), strict)


def local_models(spark: SparkSession, folder: str) -> DataFrame:
    """Nested models of a folder of JSON files, with their file. Files that are no JSON are skipped."""
    schema = f"{LCM}, _bad string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    rows = rows.option("pathGlobFilter", "*_r*_m*.json").json(folder).withColumn("file", F.col("_metadata.file_name"))
    good = rows.filter("_bad is null and focus is not null").drop("_bad")
    return good.withColumn("max_nodes", F.regexp_extract("file", r"_m(\d+)\.json$", 1).cast("int"))


def table(spark: SparkSession, path: str, schema: str, need: list[str] = ()) -> DataFrame:
    """A CSV file with a header; an error if a column is missing."""
    head = spark.read.option("header", True).csv(path).columns
    missing = [c for c in need if c not in head]
    if missing:
        raise ValueError(f"{path} has no {missing}")
    types = dict(x.strip().split(" ", 1) for x in schema.split(","))
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select(*[F.expr(f"try_cast(`{c}` AS {types[c]})").alias(c) if c in types else F.col(c) for c in head])


def guide(spark: SparkSession, path: str | None) -> str:
    """A document's guide: the field raw of a JSON object, or the text; empty without a file."""
    if not path:
        return ""
    try:
        got = spark.read.option("wholetext", True).text(path).first()
    except Exception:  # no such file
        return ""
    raw = got[0] if got else ""
    try:
        found = json.loads(raw)
    except ValueError:
        return raw.strip()
    return str(found.get("raw") or "").strip() if isinstance(found, dict) else str(found).strip()


def documents(spark: SparkSession, folder: str, extract: Callable[[bytes], list[str]] | None = None, most: int | None = None, pages: int | None = None, glob: str = "*.pdf", first: int | None = None) -> DataFrame:
    """(name, sha, text) of the files of a folder. extract: from a file's bytes to its pages; the
    default reads PDF files as such and takes others for UTF-8 text. pages and most: only the first of them, and of their characters. A
    file that cannot be read has an empty text. first: only so many files, by name."""
    take = extract or (lambda data: pdf.pages(data) if pdf_files else [data.decode("utf-8", "replace")])
    pdf_files = glob.lower().endswith(".pdf")
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    if first is not None:
        names = files.select("name").orderBy("name").limit(first)
        files = files.join(names, "name", "left_semi")

    @F.arrow_udf("string")
    def text(contents: pa.Array) -> pa.Array:
        out = []
        for data in contents.to_pylist():
            try:
                out.append("\n".join(take(data)[:pages]))
            except Exception:  # a broken file is an empty document
                out.append("")
        return pa.array(out, pa.string())

    got = files.select("name", X.content_id("content").alias("sha"), text("content").alias("text"))
    return got.withColumn("text", F.substring("text", 1, most)) if most else got


def open_slices(meta: DataFrame, payloads: DataFrame) -> DataFrame:
    """Slices (run_id, timestamp, processed) that are not processed and have a payload, in time."""
    return meta.filter(~F.coalesce("processed", F.lit(False))).join(payloads.select("run_id").distinct(), "run_id", "left_semi").orderBy("timestamp", "run_id")


def labels_left(models: DataFrame, labels: DataFrame) -> DataFrame:
    """Models without a decision."""
    return models.join(labels.select("file"), "file", "left_anti")


def runs_left(docs: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Documents that no run has finished."""
    done = manifest.filter((F.col("phase1_status") == "ok") & (F.col("phase2_status") == "ok"))
    return docs if force else docs.join(done.select("sha"), "sha", "left_anti")


def shard(df: DataFrame, n: int, k: int) -> DataFrame:
    """Rows of the k-th of n parts by seq."""
    return df.filter(F.col("seq") % n == k)


def state(spark: SparkSession, path: str, triples: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of a stored relational state; made from triples where there is none."""
    from ..operators.manifold import relational_state

    try:
        return {n: spark.read.parquet(f"{path}/{n}") for n in ("nodes", "rel", "dom", "edges")}
    except Exception:  # nothing stored under path
        if triples is None:
            raise
        return relational_state(triples)

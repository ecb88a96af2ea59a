"""The phases as plans: topics to triples by a model, triples to ranked claims, and batches."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import claims as C
from ..operators import generate as L
from ..operators import graph as G
from ..operators import scoring as S
from ..operators import statements as T
from ..operators import topics as P
from ..operators.lineage import cut, scratch


#: More questions than a topic has, and statements than a question has.
PLACES = 1 << 12


def discover_topics(docs: DataFrame, client: Callable, k: int = V.ROOT_TOPICS, per_chunk: int = V.TOPICS_PER_CHUNK) -> DataFrame:
    """docs (doc_id, text) to the k topics that a model names most often."""
    chunks = P.document_chunks(docs).withColumn("prompt", X.topic_prompt("chunk", per_chunk))
    raw = cut(L.answered(chunks, client, 8), "topic-answers")
    return P.topic_counts(raw.select(F.explode(X.topic_lines("raw")).alias("topic")), k)


def phase_one(roots: DataFrame, client: Callable, guide: str = "", depth: int = V.TOPIC_DEPTH, most: int = 100) -> dict[str, DataFrame]:
    """roots (seq, topic) to tables topics, questions, statements and triples."""
    topics = L.expand_topics(roots, client, depth, most)
    paths = G.paths(topics)
    asked = paths.withColumn("prompt", X.question_prompt("path", guide))
    q = T.questions(cut(L.answered(asked, client), "question-answers"), "topic", guide)
    # seq is the order of files written one after the other: by topic, question and statement
    q = q.join(topics.groupBy("topic").agg(F.min("seq").alias("at")), "topic")
    told = q.withColumn("prompt", X.statement_prompt("question", "path", guide)).withColumn("key", F.concat_ws("\t", "topic", "rank", "question"))
    s = T.statements(cut(L.answered(told, client), "statement-answers").select("key", "path", "question", "raw"), "key", guide)
    s = s.join(told.select("key", "topic", "at", F.col("rank").alias("asked")), "key")
    order = F.col("at") * (PLACES * PLACES) + F.col("asked") * PLACES + F.col("rank")
    rows = s.withColumn("seq", order.cast("long")).select("seq", "topic", "path", "question", "statement")
    return {"topics": topics, "questions": q.drop("at"), "statements": s.drop("at", "asked"), "triples": T.triples(rows)}


@dataclass
class Settings:
    """Of phase two; the defaults are those of the pipeline."""

    foci: int = 200
    radii: list[int] = field(default_factory=lambda: [1, 2, 3])
    max_nodes: list[int] = field(default_factory=lambda: [10, 20, 30, 40, 60])
    edge_cost: float = V.EDGE_COST
    models: int = V.TOP_MODELS
    alpha: float = V.ALPHA
    one_a_focus: bool = False
    blacklist: str | None = None
    keyword_anchors: list[str] = field(default_factory=list)
    anchor_scope: str = "example"
    anchor_in_focus: bool = False


def phase_two(triples: DataFrame, settings: Settings | None = None) -> dict[str, DataFrame]:
    """triples to tables edges, nodes, models, scores, top and claims. Evidence is counted once for
    all models; only the edges of the best models are weighed."""
    s = settings or Settings()
    stated = cut(G.stated(triples), "stated")
    edges = cut(G.stated_edges(stated), "edges")
    nodes, models = G.sweep(edges, G.focus_nodes(edges, s.foci), s.radii, s.max_nodes)
    models = cut(models, "models")
    scores = cut(S.text_scores(nodes, models, G.stated_support(stated), s.edge_cost), "scores")
    best = S.top_models(scores, s.models, 0, s.one_a_focus, s.blacklist, s.keyword_anchors if s.anchor_in_focus else None)
    top = cut(S.softmax(best, "score", s.alpha), "top")
    held = models.join(top.select(*G.MODEL), G.MODEL, "left_semi")
    keys = held.select(F.col("src").alias("subj"), F.col("dst").alias("obj"), "rel").distinct()
    told = S.examples(triples.join(keys, ["subj", "obj", "rel"], "left_semi"))
    found = C.anchored(C.claims(top, held, G.stated_support(stated, True), told), s.keyword_anchors, s.anchor_scope)
    return {"edges": edges, "nodes": nodes, "models": models, "scores": scores, "top": top, "claims": found}


def batch(docs: DataFrame, client: Callable, manifest: DataFrame | None = None, auto_topics: bool = True, settings: Settings | None = None, at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """Both phases for each of docs (name, sha, text) that the manifest has not finished: claims
    with their document, and the manifest's new rows. A document that fails does not stop others;
    of several with one sha the first by name is run. Names come to the driver one after the
    other, `at_once` documents run side by side, and each writes its own claims."""
    spark = docs.sparkSession
    todo = docs if manifest is None else docs.join(manifest.filter("phase1_status = 'ok' and phase2_status = 'ok'").select("sha"), "sha", "left_anti")
    todo = cut(todo.groupBy("sha").agg(F.min("name").alias("name"), F.min_by("text", "name").alias("text")), "batch")
    folder = scratch(spark, "batch-claims")

    def run(job) -> tuple:
        i, r = job
        status, note = ["skipped", "skipped"], ""
        try:
            one = todo.filter(F.col("sha") == r["sha"]).select(F.col("sha").alias("doc_id"), "text")
            found = P.mined_topics(one) if auto_topics else discover_topics(one, client).withColumn("rank", F.monotonically_increasing_id())
            triples = cut(phase_one(found.select(F.col("rank").cast("long").alias("seq"), "topic"), client)["triples"], "triples")
            status[0] = "ok"
            if triples.take(1):
                phase_two(triples, settings)["claims"].withColumn("sha", F.lit(r["sha"])).write.mode("overwrite").parquet(f"{folder}/{r['sha']}")
                status[1] = "ok"
            else:
                note = "no triples"
        except Exception as e:  # the manifest has it; the batch goes on
            status[status.index("skipped")] = "failed"
            note = str(e)[:500]
        return i, r["name"], r["sha"], *status, note

    rows, jobs = [], enumerate(todo.select("name", "sha").orderBy("name").toLocalIterator())
    with ThreadPoolExecutor(at_once) as pool:
        while part := list(islice(jobs, 16 * at_once)):
            rows += pool.map(run, part)
    told = spark.createDataFrame(rows, "idx int, name string, sha string, phase1_status string, phase2_status string, notes string")
    shape, done = C.CLAIM + ", sha string", [f"{folder}/{r[2]}" for r in rows if r[4] == "ok"]
    return (spark.read.schema(shape).parquet(*done) if done else spark.createDataFrame([], shape)), told

"""Layouts, layers, encoders, logs, folded increments, and the order of triples."""

import json
import math
import os

import numpy as np
import pytest

from claimloom.operators import generate as L
from claimloom.operators import graph as G
from claimloom.operators import manifold as M
from claimloom.plans import pipeline
from claimloom.sources import writers
from claimloom.streaming import slices


def test_a_layout_keeps_neighbours_together(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=6) * 0.1 + 3 * np.eye(6)[i % 3]]) for i in range(45)]
    v = spark.createDataFrame(rows, "id long, h array<double>")
    got = {x["id"]: x["xy"] for x in M.neighbour_layout(v, 6, k=5, epochs=3, metric="euclidean").collect()}
    far = lambda a, b: math.dist(got[a], got[b])
    inside = np.mean([far(a, b) for a in got for b in got if a < b and a % 3 == b % 3])
    across = np.mean([far(a, b) for a in got for b in got if a % 3 != b % 3])
    assert len(got) == 45 and all(len(p) == 2 and all(map(math.isfinite, p)) for p in got.values()) and inside < across / 2


def test_a_layer_adds_what_its_network_says(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0, -1.0, 0.5]) for i in range(4)], "id long, h array<double>")
    edges, tri = spark.createDataFrame([(0, 1), (0, 1), (2, 1)], "i long, j long"), spark.createDataFrame([(0, 1, 2)], "a long, b long, c long")
    out = {r["id"]: r["h"] for r in M.simplicial_layer(v, edges, tri, 4).collect()}
    again = {r["id"]: r["h"] for r in M.simplicial_layer(v, edges, tri, 4).collect()}
    assert len(out) == 4 and all(np.allclose(out[i], again[i]) for i in out)
    none = {r["id"]: r["h"] for r in M.simplicial_layer(v, edges.limit(0), tri.limit(0), 4).collect()}
    assert np.allclose(out[3], none[3]) and not np.allclose(out[1], none[1])


def test_an_encoder_of_ones_own(spark):
    df = spark.createDataFrame([("ab",), (None,)], "text string")
    got = {r["text"]: r["h"] for r in M.encoded(df, "text", lambda: lambda texts: [[len(t), 1] for t in texts]).collect()}
    assert got == {"ab": [2.0, 1.0], None: [0.0, 1.0]}


def test_a_score_without_its_model_is_an_error(spark):
    docs = spark.createDataFrame([("f", 1, 10, ["a"])], "focus string, radius int, max_nodes int, nodes array<string>")
    keys = "focus string, radius int, max_nodes int"
    assert G.documents_of(spark.createDataFrame([("f", 1, 10)], keys), docs).count() == 1
    with pytest.raises(ValueError, match="without a model"):
        G.documents_of(spark.createDataFrame([("f", 1, 10), ("g", 1, 10)], keys), docs)


class Counting(L.StubClient):
    def __init__(self):
        super().__init__()
        self.used = {"prompt_tokens": 0, "completion_tokens": 0}

    def ask(self, prompt):
        self.used["prompt_tokens"] += len(prompt)
        self.used["completion_tokens"] += 1
        return "x"


def test_usage_reaches_the_log(spark):
    import sys

    from pyspark.cloudpickle import register_pickle_by_value

    register_pickle_by_value(sys.modules[__name__])
    df = spark.createDataFrame([("ab",), ("cde",), ("f",)], "prompt string").repartition(2)
    log = L.usage_log(L.answered(df, Counting), "stage").first()
    assert (log["prompts"], log["failed"], log["prompt_tokens"], log["completion_tokens"]) == (3, 0, 6, 3)


def test_batches_are_folded_and_old_ones_go(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    for k in range(7):
        row = {"topic": "t", "subj": f"s{k % 2}", "obj": "b", "rel": "causes"}
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(row) + "\n")
        slices.merge_slices(slices.triple_stream(spark, src, 1), out, check, compact=2).awaitTermination()
    assert {r["subj"]: r["support"] for r in slices.latest_support(spark, out).collect()} == {"s0": 4, "s1": 3}
    assert sorted(x for x in os.listdir(out) if x.startswith("b")) == ["base=3", "base=5", "batch=4", "batch=5", "batch=6"]
    assert slices.latest_support(spark, str(tmp_path / "nothing")).count() == 0


def test_triples_follow_topics_questions_and_statements(spark):
    roots = spark.createDataFrame([(5, "rain"), (2, "soil")], "seq long, topic string")
    got = pipeline.phase_one(roots, L.StubClient, "", 0, 2)
    rows = got["triples"].orderBy("seq").collect()
    assert len({r["seq"] for r in rows}) == len(rows) and [r["topic"] for r in rows] == sorted((r["topic"] for r in rows), reverse=True)
    rank = {(r["topic"], r["question"]): r["rank"] for r in got["questions"].collect()}
    for a, b in zip(rows, rows[1:]):
        assert a["topic"] != b["topic"] or rank[a["topic"], a["question"]] <= rank[b["topic"], b["question"]]


def test_a_batch_runs_each_content_once(spark):
    text = "soil water soil water soil water yield"
    docs = spark.createDataFrame([("b.txt", "s1", text), ("a.txt", "s1", text), ("c.txt", "s2", "")], "name string, sha string, text string")
    claims, told = pipeline.batch(docs.filter("sha = 's1'"), L.StubClient, settings=pipeline.Settings(foci=3, radii=[1], max_nodes=[10]))
    assert [(r["name"], r["phase1_status"]) for r in told.collect()] == [("a.txt", "ok")]
    assert {r["sha"] for r in claims.select("sha").distinct().collect()} == {"s1"}


def test_paths_of_deep_and_circular_topics(spark):
    rows = [(f"t{i}", f"t{i - 1}" if i else None) for i in range(14)] + [("x", "y"), ("y", "x")]
    got = {r["topic"]: r["path"] for r in G.paths(spark.createDataFrame(rows, "topic string, parent string")).collect()}
    assert set(got) == {f"t{i}" for i in range(14)} and got["t13"] == [f"t{i}" for i in range(14)]


def test_frames_as_one_document(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "cluster int, labels array<string>").orderBy("cluster")
    writers.json_document(df, str(tmp_path / "x"))
    assert json.loads(spark.read.text(str(tmp_path / "x")).first()[0]) == [{"cluster": 1, "labels": ["a"]}, {"cluster": 2, "labels": ["b"]}]

"""Sources, sinks, generation, increments, and whole phases."""

import json
import sys

import pytest
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from claimloom.operators import generate as L
from claimloom.operators import manifold as M
from claimloom.operators import reports as R
from claimloom.operators import topics as P
from claimloom.plans import pipeline
from claimloom.sources import readers, writers
from claimloom.streaming import slices


register_pickle_by_value(sys.modules[__name__])


class Broken(L.StubClient):
    def ask_batch(self, prompts):
        raise RuntimeError("no batch")

    def ask(self, prompt):
        if "bad" in prompt:
            raise RuntimeError("no answer")
        return "one topic"


def test_a_bad_prompt_costs_only_itself(spark):
    df = spark.createDataFrame([("good",), ("bad",)], "prompt string")
    got = {r["prompt"]: (r["raw"], r["error"]) for r in L.answered(df, Broken).collect()}
    assert got == {"good": ("one topic", None), "bad": ("", "no answer")}


def test_settings_keep_zero(monkeypatch):
    monkeypatch.setenv("CHAT_TEMPERATURE", "0.5")
    assert L.ChatClient(temperature=0).temperature == 0
    assert L.ChatClient().temperature == 0.5
    assert (L.max_tokens(1), L.max_tokens(3)) == (96, 288)


def test_expansion(spark):
    roots = spark.createDataFrame([(0, "rain"), (1, "soil")], "seq long, topic string")
    got = L.expand_topics(roots, L.StubClient, 2, 10).collect()
    assert len(got) == len({r["topic"] for r in got}) <= 10
    assert {r["topic"] for r in got if r["depth"] == 0} == {"rain", "soil"}
    names = {r["topic"]: r["depth"] for r in got}
    assert all(names[r["parent"]] == r["depth"] - 1 for r in got if r["parent"])
    assert L.expand_topics(roots, None).count() == 2
    assert L.expand_topics(roots, L.StubClient, 2, 2).count() == 2


def test_phases_and_reports(spark):
    roots = spark.createDataFrame([(0, "rain"), (1, "soil")], "seq long, topic string")
    one = pipeline.phase_one(roots, L.StubClient, "", 2, 12)
    assert one["triples"].count() > 0
    assert one["statements"].groupBy("topic", "question").count().agg(F.max("count")).first()[0] <= 2
    two = pipeline.phase_two(one["triples"], pipeline.Settings(foci=5, radii=[1], max_nodes=[10]))
    top, claims = two["top"], two["claims"]
    assert "## Claims" in R.credibility_report(top, claims)
    assert "## Strong claims" in R.executive_summary(claims)
    evidence = spark.createDataFrame([], "subj string, rel string, obj string, support long")
    assert "hub" in R.deep_dive(top, two["models"], evidence, claims)


def test_batch_goes_on(spark):
    docs = spark.createDataFrame([("a.txt", "s1", "soil water soil water soil water yield"), ("b.txt", "s2", "")], "name string, sha string, text string")
    s = pipeline.Settings(foci=3, radii=[1], max_nodes=[10])
    claims, manifest = pipeline.batch(docs.filter("name = 'a.txt'"), L.StubClient, settings=s)
    assert [r["phase1_status"] for r in manifest.collect()] == ["ok"]
    again, told = pipeline.batch(docs.filter("name = 'a.txt'"), L.StubClient, manifest, settings=s)
    assert told.count() == 0 and again.count() == 0
    assert claims.count() > 0


def test_files(spark, tmp_path):
    p = tmp_path / "triples.jsonl"
    rows = [{"topic": "t", "subj": "", "source": "a", "obj": "b", "relation": "causes"}, {"topic": "t", "head": "c", "tail": "d"}, {"topic": "t", "subj": "x"}]
    p.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    got = readers.triples(spark, str(p)).orderBy("seq").collect()
    assert [(r["seq"], r["subj"], r["rel"], r["obj"]) for r in got] == [(0, "a", "causes", "b"), (1, "c", "", "d")]
    assert readers.triples(spark, str(p), strict=True).count() == 0
    (tmp_path / "bad.jsonl").write_text("{not json\n")
    with pytest.raises(Exception):
        readers.triples(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "roots.txt").write_text("# no\n rain \n\nsoil\n")
    assert [r["topic"] for r in readers.root_topics(spark, str(tmp_path / "roots.txt")).orderBy("seq").collect()] == ["rain", "soil"]
    (tmp_path / "none.txt").write_text("# no\n")
    with pytest.raises(ValueError):
        readers.root_topics(spark, str(tmp_path / "none.txt"))
    (tmp_path / "guide.json").write_text('{"raw": " the story "}')
    assert readers.guide(spark, str(tmp_path / "guide.json")) == "the story"
    assert readers.guide(spark, str(tmp_path / "missing")) == "" == readers.guide(spark, None)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("hello")
    assert [(r["name"], r["text"]) for r in readers.documents(spark, str(tmp_path / "d"), glob="*.txt", most=4).collect()] == [("x.txt", "hell")]


def test_models_and_tables_round_trip(spark, tmp_path):
    (tmp_path / "f_r1_m10.json").write_text(json.dumps({"focus": "f", "radius": 1, "nodes": ["a"], "edges": [{"src": "a", "dst": "b", "rel": "causes"}], "meta": {}}, indent=1))
    (tmp_path / "g_r1_m10.json").write_text("{broken")
    got = readers.local_models(spark, str(tmp_path)).collect()
    assert [(r["focus"], r["max_nodes"], r["file"]) for r in got] == [("f", 10, "f_r1_m10.json")]
    df = spark.createDataFrame([("a", 1.5), ('q"x,y', 2.0)], "file string, score double")
    writers.report_table(df, str(tmp_path / "csv"))
    back = readers.table(spark, str(tmp_path / "csv"), "score double", ["file", "score"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        readers.table(spark, str(tmp_path / "csv"), "score double", ["nope"])


def test_slices_merge_to_one_batch(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    row = lambda s: json.dumps({"topic": "t", "subj": s, "obj": "b", "rel": "causes"}) + "\n"
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(row("a") + row(f"s{k}"))
        slices.merge_slices(slices.triple_stream(spark, src, 1), out, check).awaitTermination()
    got = {r["subj"]: r["support"] for r in slices.latest_support(spark, out).collect()}
    assert got == {"a": 2, "s0": 1, "s1": 1}


def test_state_and_numbers(spark):
    t = spark.createDataFrame([(1, "b", "causes", "a", "d1"), (2, "a", "reduces", "c", "d0")], "seq long, subj string, rel string, obj string, domain string")
    s = M.relational_state(t)
    assert {r["value"]: r["id"] for r in s["nodes"].collect()} == {"b": 0, "a": 1, "c": 2}
    labels = M.node_labels(s["nodes"], s["edges"], s["dom"], "dom_id").collect()
    assert {r["id"]: r["label"] for r in labels} == {0: "d1", 1: "d1", 2: "d0"}
    v = s["nodes"].select("id", M.hashed_vectors("value", 8).alias("h"))
    out = M.message_pass(v, s["edges"], 2, 8).collect()
    assert len(out) == 3 and all(abs(sum(r["h"])) < 1e-6 for r in out)
    assert M.expert_block(v, 8).count() == 3
    tri = spark.createDataFrame([(0, 1, 2)], "a long, b long, c long")
    assert M.triangle_pass(v, tri, 8).count() == 3
    near = M.nearest(v, v, 2, "euclidean").collect()
    assert len(near) == 6 and all(r["id"] != r["other"] for r in near)
    assert len(M.mean_vector(v, 8).first()["h"]) == 8


def test_mined_topics(spark):
    docs = spark.createDataFrame([(1, "soil water yield. Soil water yield! data paper"), (2, "rice")], "doc_id long, text string")
    got = [r["topic"] for r in P.mined_topics(docs, 6).orderBy("rank").collect()]
    assert got[:3] == ["soil water yield", "water yield soil", "yield soil water"] or got[0] == "soil water yield"
    assert got[-2:] == ["association versus causation", "key mechanisms and mediators"]

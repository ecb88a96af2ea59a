"""Graph, scores and claims against brute force on small inputs."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimloom.operators import claims as C
from claimloom.operators import graph as G
from claimloom.operators import scoring as S
from claimloom.plans import pipeline

COLUMNS = "seq long, topic string, path array<string>, question string, statement string, subj string, rel string, obj string, domain string"


def some_triples(spark, n=120, nodes=16, seed=1):
    r = random.Random(seed)
    name = lambda: f"n{r.randint(0, nodes - 1):02d}"
    rows = [(i, f"t{i % 3}", ["d", f"t{i % 3}"], "q", f"s{i}" if i % 4 else "", name(), r.choice(["causes", "reduces"]), name(), f"d{i % 2}") for i in range(n)]
    return rows, spark.createDataFrame(rows, COLUMNS)


def brute_edges(rows):
    out = {}
    for r in rows:
        out[(r[5], r[7])] = r[6]
        out[(r[1], r[5])] = "has_subj"
        out[(r[1], r[7])] = "has_obj"
    return out


def brute_model(edges, focus, radius, most):
    hop, wave = {focus: 0}, [focus]
    for k in range(1, radius + 1):
        wave = sorted({d for s, d in edges for w in wave if s == w and d not in hop})
        hop |= {n: k for n in wave}
    inner = [e for e in edges if e[0] in hop and e[1] in hop]
    degree = {n: sum((s == n) + (d == n) for s, d in inner) for n in hop}
    if len(hop) <= most:
        return set(hop)
    return {focus, *sorted(hop, key=lambda n: (-degree[n], n))[: most - 1]}


def test_edges_and_sweep(spark):
    rows, t = some_triples(spark)
    edges = G.graph_edges(t)
    want = brute_edges(rows)
    assert {(r["src"], r["dst"]): r["rel"] for r in edges.collect()} == want
    foci = G.focus_nodes(edges, 4)
    nodes, lcm = G.sweep(edges, foci, [1, 2], [5, 8])
    got: dict = {}
    for r in nodes.collect():
        got.setdefault((r["focus"], r["radius"], r["max_nodes"]), set()).add(r["node"])
    assert len(got) == 16
    for (f, radius, most), own in got.items():
        assert own == brute_model(want, f, radius, most)
        assert f in own and len(own) <= most
    own = {}
    for r in lcm.collect():
        own.setdefault((r["focus"], r["radius"], r["max_nodes"]), set()).add((r["src"], r["dst"]))
    for k, es in own.items():
        assert es == {e for e, rel in want.items() if not rel.startswith("has_") and e[0] in got[k] and e[1] in got[k]}


def test_topic_that_is_the_subject_keeps_an_anchor(spark):
    t = spark.createDataFrame([(1, "a", ["a"], "", "", "a", "causes", "b", "a")], COLUMNS)
    assert {(r["src"], r["dst"]): r["rel"] for r in G.graph_edges(t).collect()} == {("a", "b"): "has_obj", ("a", "a"): "has_subj"}


def test_scores_and_weights(spark):
    nodes = spark.createDataFrame([("f", 1, 10, n) for n in "fab"], "focus string, radius int, max_nodes int, node string")
    edges = spark.createDataFrame([("f", 1, 10, "f", "a", "causes"), ("f", 1, 10, "f", "b", "causes")], "focus string, radius int, max_nodes int, src string, dst string, rel string")
    evidence = spark.createDataFrame([("f", "a", 1)], "subj string, obj string, support long")
    assert S.text_scores(nodes, edges, evidence).first()["score"] == pytest.approx(math.log(2) - 0.5)
    same = spark.createDataFrame([(f"f{i}", 1.5) for i in range(5)], "focus string, score double")
    assert {round(r["weight"], 9) for r in S.softmax(same).collect()} == {0.2}
    moved = S.softmax(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "focus string, score double")).collect()
    far = S.softmax(spark.createDataFrame([("a", 1001.0), ("b", 1002.0)], "focus string, score double")).collect()
    assert sorted(r["weight"] for r in moved) == pytest.approx(sorted(r["weight"] for r in far))


def test_claims_add_up(spark):
    _, t = some_triples(spark)
    got = pipeline.phase_two(t, pipeline.Settings(foci=4, radii=[1, 2], max_nodes=[5, 8], models=3))
    claims, top = got["claims"].toPandas(), got["top"].toPandas()
    assert claims["credibility"].sum() == pytest.approx((top["weight"] * top["n_edges"]).sum())
    assert top["weight"].sum() == pytest.approx(1)
    folded = C.quotient(got["claims"]).toPandas()
    assert folded["summary_variant_count"].sum() == len(claims)


def test_no_edges_give_no_claims(spark):
    t = spark.createDataFrame([], COLUMNS)
    assert pipeline.phase_two(t, pipeline.Settings(foci=2, radii=[1], max_nodes=[5]))["claims"].count() == 0


def naive_groups(rows):
    groups = []
    for i, (s, d) in enumerate(rows):
        for g in groups:
            a, b = rows[g[0]]
            j = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
            if (j(s, a) >= 0.85 and j(d, b) >= 0.6) or (j(s, a) >= 0.75 and j(d, b) >= 0.8):
                g.append(i)
                break
        else:
            groups.append([i])
    return groups


def test_groups_against_all_pairs():
    r = random.Random(2)
    rows = [(set(r.sample("abcde", r.randint(0, 5))), set(r.sample("vwxyz", r.randint(1, 5)))) for _ in range(300)]
    pdf = pd.DataFrame({"_s": [sorted(a) for a, _ in rows], "_d": [sorted(b) for _, b in rows]})
    assert C._groups(pdf) == naive_groups(rows)


def test_quotient_folds_examples(spark):
    rows = [
        (0.9, "use of rain", "causes", "floods", 2, "b; a", "e1", "", ""),
        (0.5, "the rain", "leads to", "the floods", 7, "c", "e2", "e1", ""),
        (0.4, "rain", "reduces", "floods", 1, "d", "", "", ""),
    ]
    got = {r["rel"]: r for r in C.quotient(spark.createDataFrame(rows, C.CLAIM)).collect()}
    assert set(got) == {"causes", "reduces"}
    r = got["causes"]
    assert (r["support_count"], r["models_supporting"], r["example_1"], r["example_2"], r["summary_variant_count"]) == (7, "a; b; c", "e1", "e2", 2)


def test_tiers(spark):
    df = spark.createDataFrame([(0.6,), (0.3,), (0.2999,)], "credibility double")
    assert [r[0] for r in df.select(C.tier()).collect()] == [1, 2, 3]


def test_paths_and_parents(spark):
    t = spark.createDataFrame([("r", None, 0), ("a", "r", 1), ("b", "a", 2), ("x", "gone", 1), ("c1", "c2", 1), ("c2", "c1", 1)], "topic string, parent string, depth int")
    assert {r["topic"]: r["path"] for r in G.paths(t).collect()} == {"r": ["r"], "a": ["r", "a"], "b": ["r", "a", "b"]}
    e = spark.createDataFrame([("a", "b", "causes"), ("b", "b", "causes"), ("a", "z", "causes"), ("c", "b", "has_obj")], "src string, dst string, rel string")
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert {r["node"]: r["parents"] for r in G.parents(e, n, {"a": "col_a"}).collect()} == {"col_a": [], "b": ["col_a"], "c": []}


def test_bic_against_least_squares(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x = r.normal(size=(200, 3))
    y = x @ [1, -2, 0.5] + r.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=list("abcy")))
    got = S.linear_bic(df, {"y": ["a", "b", "c"], "a": []})
    z = np.column_stack([np.ones(200), x])
    rss = ((y - z @ np.linalg.lstsq(z, y, rcond=None)[0]) ** 2).sum()
    assert got["y"] == pytest.approx(200 * (math.log(2 * math.pi) + math.log(rss / 200) + 1) + 4 * math.log(200))
    with pytest.raises(KeyError):
        S.linear_bic(df, {"nope": []})


def test_any_focus_is_stable(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "d")], "src string, dst string")
    assert G.any_focus(e, ["d"]).first()["node"] == "d"
    assert G.any_focus(e, ["zz"], 3).first() == G.any_focus(e, ["zz"], 3).first()
    assert F is not None

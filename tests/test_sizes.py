"""Steps that once grew faster than their input, against plain forms of the same."""

import numpy as np
import pytest


@pytest.mark.parametrize("most", [500_000, 40])
def test_triangles_of_edges_need_no_rows(spark, most):
    from claimloom.operators import graph as G
    from claimloom.operators import manifold as M

    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 30, (160, 2))] + [(2, 2), (2, 5), (2, 5)]
    e = spark.createDataFrame(edges, "i long, j long")
    v = spark.createDataFrame([(i, rng.standard_normal(3).tolist()) for i in range(29)], "id long, h array<double>")  # 29 has none
    t = G.triangles(e.select(e.i.alias("src"), e.j.alias("dst")))
    want = {r["id"]: r["h"] for r in M.simplicial_layer(v, e, t, 3).collect()}
    got = {r["id"]: r["h"] for r in M.simplicial_layer(v, e, None, 3).collect()}
    assert set(got) == set(want) == set(range(29))
    for i in got:
        assert np.allclose(got[i], want[i], rtol=1e-9, atol=1e-9)
    h = dict((r["id"], np.array(r["h"])) for r in v.collect())
    sums = {i: np.zeros(3) for i in h}
    for r in t.collect():
        if all(x in h for x in r):
            for x in r:
                sums[x] += np.maximum(sum(h[y] for y in r), 0)
    for r in M.triangle_sums(v, e.distinct(), 3, most).collect():
        sums[r["to"]] -= np.array(r["h"])
    assert max(abs(x).max() for x in sums.values()) < 1e-9


def test_simplices_leave_the_join_as_arrays(spark):
    from collections import Counter

    from claimloom.operators import graph as G

    rows = [(f"n{i * i % 11}", f"n{i * 7 % 12}", "ab"[i % 2]) for i in range(150)]
    t = spark.createDataFrame(rows, "subj string, obj string, domain string")
    want = Counter((a, b, d, e) for a, b, e in rows for c, d, f in rows if b == c and e == f)
    for chunk in (4096, 3):
        found = G.simplex_counts(t, chunk)
        assert {tuple(r)[:4]: r["n"] for r in found.collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan


def test_hashed_vectors_split_a_text_once(spark):
    from claimloom.operators import manifold as M

    df = spark.createDataFrame([("Red widget, red",), ("",), (None,), ("a b c d e",)], "t string").select("t", M.hashed_vectors("t", 4).alias("h"))
    for r in df.collect():
        assert np.isclose(np.linalg.norm(r["h"]), 1.0 if r["t"] else 0.0)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_in_small_pieces(spark, metric):
    from claimloom.operators import manifold as M

    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((700, 3)), 1)  # many ties and copies
    x[:40] = x[40]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, h array<double>").repartition(2)
    if metric == "cosine":
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        d = 1 - u @ u.T
    else:
        d = np.sqrt(np.maximum(0, ((x[:, None] - x[None]) ** 2).sum(2)))
    np.fill_diagonal(d, np.inf)
    want = {i: np.sort(np.round(r, 7))[:6] for i, r in enumerate(d)}
    for block, cells in ((100, 300), (20000, 2_000_000)):
        got = M.nearest(v, v, 6, metric, block, cells).orderBy("id", "rank").toPandas()
        assert len(got) == 700 * 6 and (got["id"] != got["other"]).all()
        for i, g in got.groupby("id"):
            assert np.allclose(g["distance"], want[i], atol=1e-6) and g["other"].is_unique
            assert np.allclose(d[i][g["other"]], want[i], atol=1e-6)


def test_nearest_holds_few_distances():
    import tracemalloc

    import pandas as pd

    from claimloom.operators import manifold as M

    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 8))
    batch = pd.DataFrame({"id": np.arange(6000), "h": list(x)})
    tracemalloc.start()
    list(M._nearest_of(np.arange(2000), x[:2000], 5, "cosine", 200_000)(iter([batch])))
    assert tracemalloc.get_traced_memory()[1] < 40e6  # all distances of the batch are 96 MB
    tracemalloc.stop()


def test_sweep_makes_no_row_for_each_focus_and_edge(spark, monkeypatch):
    from collections import Counter

    from claimloom.operators import graph as G

    rng = np.random.default_rng(8)
    pairs = sorted({(f"n{a:02d}", f"n{b:02d}") for a, b in rng.integers(0, 90, (700, 2))} | {("n01", "n01"), ("n01", "x"), ("y", "n01")})
    edges = [(a, b, "leads_to" if (i % 5) else "has_subj", i % 5 == 0) for i, (a, b) in enumerate(pairs)]
    e = spark.createDataFrame(edges, "src string, dst string, rel string, anchor boolean")
    names = [f"n{i:02d}" for i in range(70)]  # more than a word of bits
    written, plain = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df, name: (lambda out: (written.append(out.count()), out)[1])(plain(df, name)))
    nodes, lcm = G.sweep(e, spark.createDataFrame([(n,) for n in names], "node string"), [1, 2], [4, 9])
    got_nodes, got_edges = {tuple(r) for r in nodes.collect()}, {tuple(r) for r in lcm.collect()}
    assert max(written) <= 2 * len(names) * 9  # models and their nodes; all edges of all foci are over 20,000
    want_nodes, want_edges = set(), set()
    for f in names:
        hop, front = {f: 0}, {f}
        for k in (1, 2):
            front = {d for s, d, _, _ in edges if s in front} - set(hop)
            hop |= {n: k for n in front}
        for r in (1, 2):
            inside = {n for n, h in hop.items() if h <= r}
            deg = Counter(x for s, d, _, _ in edges if s in inside and d in inside for x in (s, d))
            order = sorted(inside, key=lambda n: (-deg[n], n))
            for m in (4, 9):
                keep = inside if len(order) <= m else {*order[: m - 1], f}
                want_nodes |= {(f, r, m, n) for n in keep}
                want_edges |= {(f, r, m, s, d, x) for s, d, x, anchor in edges if not anchor and s in keep and d in keep}
    assert got_nodes == want_nodes and got_edges == want_edges


def test_mined_topics_count_only_what_may_win(spark, monkeypatch):
    from claimloom.operators import topics as P

    rng = np.random.default_rng(9)
    vocabulary = [f"{a}{b}{c}word" for a in "abcd" for b in "efgh" for c in "ijkl"] + ["blue-bolt", "blue", "bolt"]
    docs = [(i, " ".join(vocabulary[min(int(x), len(vocabulary) - 1)] for x in rng.exponential(12, 60)) + f" only{'abcdefghij'[i % 10]}once{'klmnopqrst'[i // 10]}") for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    written, plain = {}, P.cut
    monkeypatch.setattr(P, "cut", lambda d, name: (lambda out: (written.setdefault(name, []).append(out.count()), out)[1])(plain(d, name)))
    want = [tuple(r) for r in P.mined_topics(df).orderBy("rank").collect()]  # all slots
    everything = max(written["phrases"])
    for slots, first in ((1 << 20, 64), (512, 8), (7, 3)):
        written.clear()
        got = [tuple(r) for r in P.mined_topics(df, slots=slots, first=first).orderBy("rank").collect()]
        assert got == want
        if slots == 1 << 20:
            assert max(written["phrases"]) < everything / 4

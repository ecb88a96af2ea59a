"""Exact neighbours and the layout over them: equal vectors, uneven scales, one file's rows, many points."""

import numpy as np
import pytest

from claimloom.operators import manifold as M


def _brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), np.round(d, 9)))[:, :k]
    return order, np.take_along_axis(d, order, 1)


def test_equal_vectors_are_at_no_distance_and_few_are_held(spark, monkeypatch):
    x = np.random.default_rng(2).standard_normal((4, 20))[np.arange(400) % 4]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, h array<double>")
    held, plain = {}, M.cut
    monkeypatch.setattr(M, "cut", lambda df, name: (lambda out: (held.setdefault(name, out.count()), out)[1])(plain(df, name)))
    want, _ = _brute(x, 5)
    for block in (1 << 17, 7):
        got = M.nearest(v, v, 5, "euclidean", block).orderBy("id", "rank").toPandas()
        assert (got["distance"] == 0).all() and (got["other"].to_numpy().reshape(-1, 5) == want).all()
    assert held["held"] == 4 * 6


@pytest.mark.parametrize("shift", [0, 1e6])
def test_nearest_of_uneven_scales(shift):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 8)) * 10.0 ** rng.integers(-3, 3, (3000, 1)) + shift
    x[5] = 1e9
    x[6] = np.nan
    q = np.r_[0:6, 7:150]
    ids = np.arange(3000)
    ((best, who),) = M._nearest_of(ids[q], x[q], 5, "euclidean", 50_000)([{"id": ids, "h": x}])
    d = np.sqrt(((x[q][:, None] - x[None]) ** 2).sum(2))
    d[np.arange(len(q)), q] = np.inf
    d[:, 6] = np.inf
    assert np.allclose(best, np.sort(d, 1)[:, :5], rtol=1e-12, atol=1e-12)
    assert np.allclose(np.take_along_axis(d, who, 1), best, rtol=1e-12, atol=1e-12)


def test_rows_of_one_file_are_dealt_to_all_tasks(spark):
    x = np.random.default_rng(5).standard_normal((300, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, h array<double>").coalesce(1)
    near = M.nearest(v, v, 3, "euclidean")
    assert near.rdd.getNumPartitions() == M._tasks(v) > 1
    order, d = _brute(x, 3)
    got = near.orderBy("id", "rank").toPandas()
    assert (got["other"].to_numpy().reshape(-1, 3) == order).all() and np.allclose(got["distance"].to_numpy().reshape(-1, 3), d, atol=1e-12)


def test_edges_stay_while_points_move(spark, monkeypatch):
    r = np.random.default_rng(7)
    v = spark.createDataFrame([(3 * i, r.standard_normal(5).tolist()) for i in range(60)], "id long, h array<double>")
    plans, plain = [], M.cut
    monkeypatch.setattr(M, "cut", lambda df, name: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), plain(df, name))[1])
    sent, shuffled = ({x["id"]: x["xy"] for x in M.neighbour_layout(v, 5, k=4, epochs=3, metric="euclidean", most=most).collect()} for most in (1 << 20, 0))
    epochs = [p for name, p in plans if name == "layout"]
    assert [p.count("strategy=broadcast") for p in epochs[1:4] + epochs[5:]] == [2, 2, 2, 0, 0, 0]  # each first one is the start
    assert sorted(sent) == [3 * i for i in range(60)] and all(np.allclose(sent[i], shuffled[i], atol=1e-9) for i in sent)

"""Exact search against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import topk


def brute(rows, scale=256, k=5, step=50):
    ok = sorted({(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for q, v in ok:
        if q % step == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, **params):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return sorted(map(tuple, topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, **params).collect()))


@pytest.mark.parametrize("size", [1, 30])
def test_against_all_pairs(spark, size, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE", 60)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "ANNULUS", 10)
    monkeypatch.setattr(topk, "CHUNK", 16)
    r = np.random.default_rng(size)
    rows = [(i, [float(x) for x in np.float32(size * (r.normal(size=6) + 2 * (i % 3)))]) for i in range(500)]
    rows += [(1000 + i, rows[7][1]) for i in range(120)]  # ties
    rows += [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (2200, [1.0, 2.0]), (2250, []), rows[50], rows[50], (None, [1.0] * 6)]
    assert run(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert run(spark, [(0, [1.0, 0.5])]) == []
    assert run(spark, [(0, [1.0]), (3, [2.0]), (2, [2.0])]) == [(0, 1, 2, 256 * 512), (0, 2, 3, 256 * 512)]
    assert run(spark, [(1, [1.0])]) == []
    assert topk.top_k_report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**20 + i), -float(2**20), 3.0]) for i in range(60)]
    assert run(spark, rows) == brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows])
    assert topk.exact_kind(64, 256) is np.float32 and topk.exact_kind(64, 2**20) is np.float64 and topk.exact_kind(64, 2**24) is np.int64


def test_extra_columns(spark):
    df = spark.createDataFrame([(0, [1.0], "x", 1), (1, [2.0], "y", 2)], "vec_id long, embedding array<float>, score string, id int")
    assert [tuple(r) for r in topk.top_k_report(df).collect()] == [(0, 1, 1, 256 * 512)]


def test_one_block_of_queries_at_a_time(spark, monkeypatch):
    """With 50 blocks what each finds is written, and its queries are let go."""
    monkeypatch.setattr(topk, "QUERIES", 1)
    r = np.random.default_rng(5)
    rows = [(i * 50, [float(x) for x in r.normal(size=3)]) for i in range(49)]
    plans, whole = [], topk.written

    def written(df, name):
        plans.append(name)
        return whole(df, name)

    monkeypatch.setattr(topk, "written", written)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, "vec_id", "embedding", F.lit(True), k=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, k=3)
    assert 25 < plans.count("topk-found") <= 50
    assert "mapInArrow" not in got._jdf.queryExecution().logical().toString() and "MapInArrow" not in got._jdf.queryExecution().logical().toString()

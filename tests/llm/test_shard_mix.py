"""Sharding and mixing against loops written from their definitions."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import mix, shard


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one():
    keys = [0, 1, 2**63 + 5, 2**64 - 1, 123456789]
    for n in (1, 2, 40, 1000):
        got = shard.jump_hash(np.array(keys, np.uint64).view(np.int64), n)
        assert got.tolist() == [jump(k, n) for k in keys]


def test_growth_moves_rows_into_the_new_shard_only():
    keys = np.arange(20_000) * 7919
    a, b = shard.jump_hash(keys, 40), shard.jump_hash(keys, 41)
    assert set(b[a != b]) == {40} and 0.018 < (a != b).mean() < 0.031
    assert np.bincount(a, minlength=40).min() > 400


def test_report(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(shard, "ROWS_PER_BUCKET", 10)
    got = shard.shard_report(docs, 5).collect()
    assert len(got) == len(rows)
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and (r["grown_shard"] == r["shard"] or r["grown_shard"] == 5)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    hashed = {r["doc_id"]: r["h"] % 2**64 for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    assert all((r["shard"], r["grown_shard"]) == (jump(hashed[r["doc_id"]], 5), jump(hashed[r["doc_id"]], 6)) for r in got)
    assert got and sorted(map(tuple, got), key=str) == sorted(map(tuple, shard.shard_report(docs, 5).collect()), key=str)


def test_edge_tables(no_docs, clashing):
    assert shard.shard_report(no_docs, 5).count() == 0
    out = shard.assign_shards(clashing, "doc_id", 3)
    assert out.columns == clashing.columns and dict(out.dtypes)["shard"] == "int"
    with pytest.raises(ValueError):
        shard.jump_shard("doc_id", 0)


def test_targets():
    assert mix.share([10, 10, 10], [3, 1, 2], 30, 2) == [15.0, 5.0, 10.0]
    assert mix.share([10, 100], [3, 1], 60, 2) == [20.0, 40.0]
    assert mix.share([0, 10], [3, 1], 15, 2) == [0.0, 15.0]
    assert mix.share([], [], 0, 2) == []
    got = mix.share([5, 50, 7, 20], [3, 1, 2, 3], 123, 2)
    assert sum(got) == pytest.approx(123) and all(t <= 2 * s + 1e-9 for t, s in zip(got, [5, 50, 7, 20]))


def test_mix_report(docs, rows, monkeypatch):
    monkeypatch.setattr(mix, "ROWS_PER_BUCKET", 8)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = mix.mix_report(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mix.share([sizes[s] for s in names], [mix.WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2)))
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == {(sizes[s], round(want[s], 6)) for s in names}
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    by = defaultdict(int)
    for r in got:
        by[r["source_size"]] += r["taken"]
    largest = max(size(r[1]) for r in rows if r[3] != "s3")
    for s in names:
        if s != "s3":  # s3 has one text of most of its words
            assert abs(by[sizes[s]] - want[s]) <= 2 * largest
    assert sorted(map(str, got)) == sorted(map(str, mix.mix_report(docs).collect()))


def test_one_source_of_many_equal_texts(spark):
    df = spark.createDataFrame([(i, "two words", "a") for i in range(400)] + [(i, "x y z", "b") for i in range(400, 440)], "doc_id long, text string, source string")
    got = mix.mix_report(df).groupBy("source_size").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 3 for r in got)


def test_mix_edge_tables(no_docs, clashing):
    assert mix.mix_report(no_docs).count() == 0
    assert mix.mixed(no_docs).count() == 0
    out = mix.mixed(clashing)
    assert out.columns == clashing.columns
    again = Counter(map(str, out.collect()))
    known = Counter(map(str, clashing.collect()))
    assert all(n <= 2 * known[k] for k, n in again.items())


def queue(rows, budget=1.5, most=2):
    """rows (doc_id, source, size, order) served in the order of finish times, up to the budget."""
    size, entries = Counter(), []
    for _, s, n, _ in rows:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mix.share([size[s] for s in names], [mix.WEIGHTS[i % 3] for i in range(len(names))], budget * sum(size.values()), most)))
    for s in names:
        sent = 0
        for d, _, n, _ in sorted((r for r in rows if r[1] == s), key=lambda r: r[3]):
            sent += n
            entries += [((sent + e * size[s]) / goal[s], s is not None, s or "", sent, e, n, d) for e in range(most) if n and goal[s]]
    taken, total = Counter(), 0
    for *_, n, d in sorted(entries):
        total += n
        if total > budget * sum(size.values()):
            break
        taken[d] += n
    return taken


def test_the_queue_is_served_by_finish_time(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(mix, "ROWS_PER_BUCKET", 15)
    monkeypatch.setattr(mix, "ROWS_PER_RANGE", 40)
    r = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 30))), ["a", "b", "c", None, "d"][min(4, int(r.integers(0, 9)))]) for i in range(400)]
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    want = queue([(i, s, len(t.split()), md5(f"7:{i}:{md5(t)}")) for i, t, s in rows])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {x["doc_id"]: x["taken"] for x in mix.mix_report(df).collect()}
    assert got == {i: want[i] for i, _, _ in rows} and sum(got.values()) > 1.4 * sum(len(t.split()) for _, t, _ in rows)
    counts = Counter(x["doc_id"] for x in mix.mixed(df).collect())
    assert sum(n * len(rows[i][1].split()) for i, n in counts.items()) > 1.4 * sum(len(t.split()) for _, t, _ in rows)


def test_targets_of_very_many_sources(spark):
    r = np.random.default_rng(4)
    sizes = [(f"s{i:05d}", int(r.integers(0, 1000))) for i in range(5_000)]
    got = {x["source"]: x["target"] for x in mix.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    want = mix.share([n for _, n in sizes], [mix.WEIGHTS[i % 3] for i in range(len(sizes))], 1.5 * sum(n for _, n in sizes), 2)
    assert all(abs(got[s] - t) < 1e-6 * max(1, t) for (s, _), t in zip(sizes, want))


def test_mixed_columns_of_any_kind_and_name(spark):
    df = spark.createDataFrame([(i // 2, "a b c", "s", {"k": i}, i) for i in range(8)], "doc_id long, text string, source string, `a map` map<string,int>, `dotted.name` int")
    out = mix.mixed(df)
    assert out.columns == df.columns and 8 <= out.count() <= 16

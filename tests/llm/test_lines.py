"""Line classes against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abé", max_size=14), st.text("abé", max_size=14)), max_size=6), st.integers(1, 4))
def test_banded_distance(pairs, k):
    got = lines.within([a for a, _ in pairs], [b for _, b in pairs], k)
    assert got.tolist() == [distance(a, b) <= k for a, b in pairs]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_no_link_is_lost(k):
    r = random.Random(k)
    some = sorted({"".join(r.choice("ab") for _ in range(r.randint(k + 1, 12))) for _ in range(250)})
    n = len(some)
    keyed = []
    sent = [delta > 0 or shift != 0 for delta, _, shift in lines.probes(k)]
    index, probe = lines.line_keys(some, k)
    for x in (index, probe[:, sent]):
        r = np.zeros(x.size, lines._KEY)
        r["key"], r["a"] = x.ravel(), np.repeat(np.arange(n), x.shape[1])
        keyed.append(r)
    want = {(a, b) for a in range(n) for b in range(a) if distance(some[a], some[b]) <= k}
    for side in (2048, 7):
        rows = lines.met(*keyed, side)
        assert len(lines.met(*keyed)) <= 2 * len(keyed[0]) + len(keyed[1]) and len(want) > 50
        _, group = np.unique(rows[["key", "block", "other"]], return_inverse=True)
        size = np.bincount(group)
        assert size.max() <= 2 * side
        got = [tuple(map(int, p)) for u, v in lines.links(group, rows["key"], rows["probes"] == 1, rows["a"].astype(np.int64), [some[i] for i in rows["a"]], k) for p in zip(u, v)]
        assert len(got) == len(set(got)) and {(max(p), min(p)) for p in got} == want  # each once


def some_docs(seed=4, n=50):
    r = random.Random(seed)
    base = ["".join(r.choice("abcde ") for _ in range(r.randint(18, 60))) for _ in range(25)]

    def line():
        x = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            x[r.randrange(len(x))] = r.choice("xyz")
        return "".join(x)

    return [(i, "\n".join(r.choice([line(), line(), "short", "", "  "]) for _ in range(r.randint(0, 6)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "word " * 20_000)]


def brute(rows, k=2, least=20):
    first = {}
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            if x.strip():
                first.setdefault(x, (d, i))
    up = {x: x for x in first}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    near, long = Counter(), [x for x in first if len(x) >= least]
    for i, x in enumerate(long):
        for y in long[:i]:
            if abs(len(x) - len(y)) <= k and distance(x, y) <= k:
                near[x] += 1
                near[y] += 1
                up[top(x)] = top(y)
    least_of = {}
    for x in first:
        least_of[top(x)] = min(least_of.get(top(x), first[x]), first[x])
    out = {}
    for d, t in rows:
        own = [(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip()]
        lost = [(i, *least_of[top(x)]) for i, x in own if least_of[top(x)] != (d, i)]
        out[d] = (len(own), lost, sum(near[x] for _, x in own))
    return out


def test_report(spark):
    rows = some_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    got = {r["doc_id"]: (r["n_lines"], list(zip(r["removed_lines"], r["class_docs"], r["class_lines"])), r["n_links"]) for r in lines.line_report(df).collect()}
    assert got == want and sum(w[2] for w in want.values()) > 10
    kept = {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(df).collect()}
    for d, t in rows:
        assert kept[d] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in [w[0] for w in want[d][1]]))


def test_edge_tables(no_docs, docs, rows, clashing):
    assert lines.line_report(no_docs).count() == 0
    got = lines.line_report(docs).collect()
    assert len(got) == len(rows)
    assert len({str(r) for r in got if r["doc_id"] == 3}) == 1  # repeated rows have one result
    assert lines.without_repeated_lines(clashing).columns == clashing.columns
    with pytest.raises(ValueError):
        lines.line_classes(docs.withColumnRenamed("doc_id", "__doc"), 0)


def test_a_template_line_with_very_many_variants(spark, monkeypatch):
    """Links are counted where lines meet, and only stars of them are written."""
    n = 3_000
    monkeypatch.setattr(lines, "SIDE", 500)
    df = spark.range(n).selectExpr("id as doc_id", "concat('the number that this page was given is ', lpad(cast(id as string), 4, '0')) as text")
    names = [f"{i:04d}" for i in range(n)]
    near = lambda i, j: sum(a != b for a, b in zip(names[i], names[j])) <= 2 or distance(names[i], names[j]) <= 2
    got = {r["doc_id"]: (r["n_removed"], r["class_docs"], r["n_links"]) for r in lines.line_report(df.repartition(6)).collect()}
    assert all(got[i][0] == (i > 0) and got[i][1] == ([0] if i else []) for i in range(n))
    for i in (0, 7, 1234, n - 1):
        assert got[i][2] == sum(near(i, j) for j in range(n) if j != i)


def test_columns_of_any_kind_and_name(spark):
    df = spark.createDataFrame([(1, "x\nx", {"k": 1}, 2)], "doc_id long, text string, `a map` map<string,int>, `dotted.name` int")
    kept = lines.without_repeated_lines(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "x", {"k": 1}, 2)]

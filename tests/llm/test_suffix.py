"""Repeated byte strings against a set of all windows."""

import hashlib
import random

import numpy as np
import pytest

from claimloom.llm import suffix_dedup as sd


def brute(rows, n):
    """rows (key, text) in order; equal keys are one document."""
    seen, out = set(), {}
    for key, text in rows:
        if key in out:
            continue
        x = (text or "").encode()
        gone = bytearray(len(x))
        for i in range(len(x) - n + 1):
            if x[i : i + n] in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(x[i : i + n])
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_previous_factors_against_the_definition():
    r = random.Random(5)
    for _ in range(60):
        x = "".join(r.choice("ab") for _ in range(r.randint(1, 40)))
        order = sorted(range(len(x)), key=lambda i: x[i:])
        common = lambda i, j: next((k for k in range(len(x)) if i + k >= len(x) or j + k >= len(x) or x[i + k] != x[j + k]), len(x))  # noqa: E731, B023
        lcp = np.array([0] + [common(a, b) for a, b in zip(order, order[1:])])
        got = dict(zip(order, sd.longest_previous_factors(np.array(order), lcp).tolist()))
        assert got == {i: max((common(i, j) for j in range(i)), default=0) for i in range(len(x))}


def texts(seed, n=60):
    r = random.Random(seed)
    said = ["".join(r.choice("abcdé ") for _ in range(r.randint(5, 200))) for _ in range(12)]
    out = ["".join(r.choice(said) if r.random() < 0.5 else "".join(r.choice("xyz") for _ in range(r.randint(0, 90))) for _ in range(r.randint(0, 6))) for _ in range(n)]
    return [*out, "", None, "a" * 500, "ab" * 400, "\0" * 300, out[3], out[3]]


@pytest.mark.parametrize("n,gram,split", [(100, 32, 100_000), (40, 16, 100_000), (40, 16, 2), (20, 1, 100_000), (20, 1, 1)])
def test_against_all_windows(spark, n, gram, split):
    rows = list(enumerate(texts(n + gram)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = sd.with_spans(df, n, gram=gram, split=split)
    got = {r["doc_id"]: tuple(r[1:]) for r in found.select("doc_id", sd.digest("text", "__spans").alias("x")).select("doc_id", "x.*").collect()}
    assert got == brute(rows, n)


def test_ids_that_repeat_or_are_missing(spark):
    a, b = "q" * 60 + "w" * 60, "e" * 150
    rows = [(3, a), (3, a), (None, b), (4, b), (4, a), (4, a), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = brute([((d, t), t) for d, t in order], 100)
    got = sorted(str(tuple(r)) for r in sd.suffix_report(df).collect())
    assert got == sorted(str((d, *want[(d, t)])) for d, t in rows)


def test_edge_tables(no_docs, docs, rows, clashing):
    assert sd.suffix_report(no_docs).count() == 0
    assert sd.suffix_report(docs).count() == len(rows)
    assert set(clashing.columns) < set(sd.with_spans(clashing).columns)


def test_every_window_is_in_one_run():
    made = [(t or "").encode() for t in texts(9)]
    docs = list(range(len(made)))
    for block in (300, 1 << 19):
        seen = set()
        for cut in sd.pieces(docs, made, 100, block):
            data, anchors, edges, at = sd.runs(cut)
            for e, a in zip(edges.tolist(), at.tolist()):
                doc, start, _, count, _ = e
                assert data[a : a + count + 99].tobytes() == made[doc][start : start + count + 99]
                for i in range(count):
                    assert (doc, start + i) not in seen
                    seen.add((doc, start + i))
        assert len(seen) == sum(max(0, len(t) - 99) for t in made)


def test_suffixes_are_sorted_by_their_bytes():
    x = np.frombuffer("".join(t or "" for t in texts(4)).encode(), np.uint8)
    at = np.random.default_rng(1).permutation(len(x) - 99)[:2000]
    order, lcp = sd.suffix_order(x, at)
    rows = [x[i : i + 100].tobytes() for i in at[order]]
    assert rows == sorted(rows) and lcp[0] == 0
    for a, b, n in zip(rows, rows[1:], lcp[1:].tolist()):
        assert a[:n] == b[:n] and (n == 100 or a[n] != b[n])


def test_the_array_decides(spark, monkeypatch):
    """With factors of zero nothing goes but whole copies."""
    r = random.Random(8)
    p, q = ("".join(r.choice("abcdefgh") for _ in range(n)) for n in (40, 120))
    df = spark.createDataFrame([(1, "x" + p + q), (2, "y" + p + q), (3, "y" + p + q), (4, q + p)], "doc_id long, text string")
    removed = lambda: [r["n_removed"] for r in sd.suffix_report(df).sort("doc_id").collect()]
    assert removed() == [0, 160, 161, 120]
    monkeypatch.setattr(sd, "longest_previous_factors", lambda place, lcp: np.zeros(len(place), np.int64))
    assert removed() == [0, 0, 161, 0]


def test_one_anchor_with_very_many_runs(spark, monkeypatch):
    """A string that 100,000 texts share, between bytes of their own: no part gets too many runs."""
    line, whole = "a line that all of these texts have, and that is far longer than the hundred bytes which make a copy of it, so", sd.repeated

    def bounded(edges, data, length):
        assert edges["count"].sum() <= 2 * sd.SORTED
        return whole(edges, data, length)

    monkeypatch.setattr(sd, "repeated", bounded)
    df = spark.range(100_000).selectExpr("id as doc_id", f"concat(md5(cast(id as string)), '{line}', md5(cast(-id as string))) as text")
    got = {r["doc_id"]: r["n_removed"] for r in sd.suffix_report(df.repartition(8)).collect()}
    assert len(got) == 100_000 and got.pop(0) == 0 and min(got.values()) >= len(line)

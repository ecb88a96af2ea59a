"""The two classifiers: gradients, learning, rules and defined cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from claimloom.llm import langid, quality


def test_gradients():
    p = {k: v.astype(np.float64) for k, v in langid.init(3, 3, 0).items()}
    r = np.random.default_rng(0)
    x, y, m = r.integers(0, 5, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones((6, 4))
    m[4:, 1] = 0
    _, g = langid.loss_and_grads(x, y, m, p)
    for k in p:
        i = tuple(r.integers(0, s) for s in p[k].shape)
        i = (int(x[0, 0]), i[1]) if k[0] == "E" else i
        was = p[k][i]
        p[k][i] = was + 1e-2
        up = langid.loss_and_grads(x, y, m, p)[0]
        p[k][i] = was - 1e-2
        down = langid.loss_and_grads(x, y, m, p)[0]
        p[k][i] = was
        assert abs((up - down) / 2e-2 - g[k][i]) < 1e-4


def test_fast_pass_is_the_slow_one():
    p = langid.init(3, 4, 2)
    x = np.random.default_rng(1).integers(0, 256, (20, 7)).astype(np.uint8)
    slow = langid.scan(x, p["Ef"], p["Uf"]) @ p["Wf"] + langid.scan(x[::-1], p["Eb"], p["Ub"])[::-1] @ p["Wb"] + p["b"]
    assert np.allclose(langid.logits(x, p), slow, atol=1e-5)


def test_languages(spark, docs, rows, no_docs, clashing):
    got = {(r["doc_id"], r["lang_pred"]): r for r in langid.language_report(docs).collect()}
    by = {r["doc_id"]: r for r in got.values()}
    right = [by[r[0]]["lang_pred"] == r[2] for r in rows[:60]]
    assert np.mean(right) > 0.9
    for d, t, *_ in rows:
        r = by[d]
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2)
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
    assert langid.language_report(docs).count() == len(rows)
    assert langid.language_report(no_docs).count() == 0
    kept = langid.accepted(clashing)
    assert kept.columns == clashing.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
    alone = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.language_report(alone).first()["lang_pred"] == "und"


def test_one_long_text_is_read_whole():
    m = langid.train([(b"the river and the bread", "en"), ("été français où très".encode(), "fr")] * 20, steps=60)
    a, b = "the river and the bread " * 50, "été français où très " * 2000
    assert langid.predict([a, a + b], m)[0][0] == "en"
    assert langid.predict([a, a + b], m)[1][0] == "fr"
    assert langid.predict([], m) == [] and langid.predict([None, "", "12"], m) == [("und", 0.0)] * 3


def test_statistics():
    s = dict(zip(quality.STATISTICS, quality.statistics(b"Ab ab ab | x#\n\nAb 1.")))
    assert s["words"] == 7 and s["lines"] == 2 and s["repeats"] == 1 / 7 and s["longest_run"] == 1 / 7
    assert s["bars"] == 1 / 20 and s["digits"] == 1 / 20 and s["marked_words"] == 1 / 7 and s["capital_words"] == 2 / 7
    assert quality.statistics(None) == quality.statistics(b"") == [0.0] * len(quality.STATISTICS)


def test_rules_and_their_columns_agree(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.2) & (x[:, 3] <= 0.5)).astype(float)
    m = quality.fit(x, y)
    assert 0 < len(m["rules"]) < 150
    own = m["intercept"] + sum(w * quality.holds(x, p) for w, p in m["rules"])
    assert ((own > 0) == (y > 0)).mean() > 0.97
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x[:50])], "i int, s array<double>")
    got = df.select("i", quality.compiled(m, [F.col("s")[k] for k in range(x.shape[1])]).alias("p")).orderBy("i").collect()
    assert np.allclose([g["p"] for g in got], 1 / (1 + np.exp(-own[:50])))


def test_lasso_is_sparse_and_right():
    r = np.random.default_rng(0)
    z = (r.random((600, 30)) < 0.4).astype(float)
    y = (r.random(600) < 1 / (1 + np.exp(-(3 * z[:, 0] - 3 * z[:, 1])))).astype(float)
    w = quality.lasso(z, y, 0.02, np.zeros(31), 400)
    assert w[0] > 1 and w[1] < -1 and (w[2:30] == 0).sum() > 20


def test_quality(spark, docs, no_docs, some):
    good = [int(r[4] > 130) for r in some[:300]]
    labels = spark.createDataFrame([(i, good[i], 0) for i in range(300)] + [(1, None, 0), (2, good[2], 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_report(spark.createDataFrame(some, docs.schema), labels).collect()
    assert len(got) == len(some)
    by = {r["doc_id"]: r for r in got}
    out = [i for i in range(300) if by[i]["held_out"]]
    assert out == [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([by[i]["predicted"] == good[i] for i in out]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality_report(docs, none).collect()} == {0.5}
    assert quality.quality_report(no_docs, labels).count() == 0
    ones = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    assert min(r["score"] for r in quality.quality_report(docs, ones).collect()) > 0.5


def test_letters_are_those_of_the_categories():
    m = langid.train([(b"the river", "en")] * 20, steps=2)
    assert langid.predict(["\u00bd \u00bd", "\u00b2 \u216b", "12 _"], m) == [("und", 0.0)] * 3
    assert [x[0] for x in langid.predict(["\u02b0", "\u00aa 1", "\u6c34"], m)] == ["en"] * 3


def test_every_position_counts_once_and_has_seen_its_surroundings():
    texts = [bytes(range(1, 256)) * 4, b"", b"ab", bytes(128), b"x" * 129]
    x, counts, owner = langid.windows(texts)
    assert [int(counts[owner == i].sum()) for i in range(5)] == [len(t) for t in texts]
    assert b"".join(x[i][counts[i]].tobytes() for i in np.flatnonzero(owner == 0)) == texts[0]
    for row, c in zip(x[owner == 0][1:-1], counts[owner == 0][1:-1]):
        assert c.argmax() == langid.MARGIN and c[::-1].argmax() == langid.MARGIN


def test_windows_are_drawn_over_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda samples: seen.extend(samples) or {"langs": [], "p": {}})
    text = "".join(chr(65 + i % 26) * 128 for i in range(26 * 4))
    df = spark.createDataFrame([(i, text, "en") for i in range(60)] + [(99, "abc", "fr")], "doc_id long, text string, lang string")
    langid.fit(df, F.lit(True))
    assert {t[:1] for t, lang in seen if lang == "en"} == {chr(65 + i).encode() for i in range(26)} and (b"abc", "fr") in seen
    assert len(seen) == 60 * langid.DRAWN + 1


def test_held_out_accuracy_on_the_tables(spark):
    import os

    import pytest

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path)
    rows = langid.language_report(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred <> 'und'")
    right, n = rows.filter("lang = lang_pred").count(), rows.count()
    assert n > 150 and right >= 0.97 * n

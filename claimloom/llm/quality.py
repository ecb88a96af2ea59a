"""Quality classification by a sparse rule ensemble, compiled to column expressions.

Statistics of each text are the inputs. Small boosted trees over them are grown on labelled
rows; every path from a root to a node is a rule, a conjunction of comparisons. A logistic
regression with a lasso penalty gives few of the rules a weight, and those become one Spark
expression over the statistics. All in numpy, on a bounded sample of labelled rows.

Defined cases. Null and empty texts have statistics zero and a score like any other. Without
labelled rows the score is 0.5; with labels of one kind it is their smoothed share. Labels
that are null, and documents with several labels that differ, are not learned from. Repeated
rows are scored alike. An empty table gives an empty table.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, small_batches, written

#: Bound on the sample, trees, their depth, least rows of a node (a fiftieth of few rows), borders and
#: penalties tried.
SAMPLE, TREES, DEPTH, LEAF, BORDERS = 20_000, 24, 3, 20, 24
PENALTIES = (0.02, 0.01, 0.005, 0.002, 0.001)
STATISTICS = (
    "bytes", "words", "lines", "word_bytes", "line_words", "letters", "upper", "digits", "stops", "commas", "symbols",
    "bars", "blanks", "distinct_words", "repeats", "longest_run", "distinct_lines", "short_lines", "marked_words", "capital_words",
)
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS, _STOPS, _COMMAS, _BARS, _BLANKS = b"0123456789", b".!?", b",;:", b"|", b" \t\n\r\x0b\x0c"
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOPS + _COMMAS + _BARS + b"'\"-()")


def statistics(text: bytes | None) -> list[float]:
    """The STATISTICS of one text; shares unless it is a count."""
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    share = lambda kind: (n - len(text.translate(None, kind))) / n
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    m, k = max(1, len(words)), max(1, len(lines))
    same = list(map(operator.eq, words, words[1:]))
    run = longest = 0
    if any(same):
        for x in same:
            run = run + 1 if x else 0
            longest = max(longest, run)
    return [
        float(n), float(len(words)), float(len(lines)), sum(map(len, words)) / m, len(words) / k, share(_LETTERS), share(_UPPER), share(_DIGITS), share(_STOPS), share(_COMMAS), share(_SYMBOLS),
        share(_BARS), share(_BLANKS), len(set(words)) / m, sum(same) / m, longest / m, len(set(lines)) / k, sum(len(x) < 40 for x in lines) / k,
        sum(w[-1] in _SYMBOLS for w in words) / m, sum(w[0] in _UPPER for w in words) / m,
    ]


def with_statistics(text: str) -> Column:
    kind = ",".join(f"{s}:double" for s in STATISTICS)

    @F.arrow_udf(f"struct<{kind}>")
    def run(texts: pa.Array) -> pa.Array:
        got = [statistics(t) for t in texts.cast(pa.binary()).to_pylist()]
        columns = np.array(got, np.float64).reshape(len(got), len(STATISTICS)).T
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], list(STATISTICS))

    return run(text)


def _tree(x, borders, g, h, depth: int, path: tuple, rows, rules: set, out, leaf: int) -> None:
    """Grow a node on gradients g and curvatures h; adds its path to rules, its value to out."""
    if path:
        rules.add(path)
    value = -g[rows].sum() / (h[rows].sum() + 1.0)
    best = (1e-6, None)
    if depth and len(rows) >= 2 * leaf:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        base = total_g * total_g / (total_h + 1.0)
        for f in range(x.shape[1]):
            if not len(borders[f]):
                continue
            bin_ = np.searchsorted(borders[f], x[rows, f], "left")  # bin b: x <= borders[b]
            size = len(borders[f]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(bin_, w, size))[:-1] for w in (g[rows], h[rows], None))
            gain = gs**2 / (hs + 1.0) + (total_g - gs) ** 2 / (total_h - hs + 1.0) - base
            gain[(ns < leaf) | (len(rows) - ns < leaf)] = 0
            if gain.max() > best[0]:
                best = (float(gain.max()), (f, float(borders[f][gain.argmax()])))
    if best[1] is None:
        out[rows] += value
        return
    f, border = best[1]
    left = x[rows, f] <= border
    _tree(x, borders, g, h, depth - 1, (*path, (f, "<=", border)), rows[left], rules, out, leaf)
    _tree(x, borders, g, h, depth - 1, (*path, (f, ">", border)), rows[~left], rules, out, leaf)


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 1) -> list[tuple]:
    """Rules (a tuple of (statistic, comparison, border) each) of boosted trees."""
    r = np.random.default_rng(seed)
    borders = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BORDERS + 2)[1:-1])) for f in range(x.shape[1])]
    borders = [b[b < x[:, f].max()] for f, b in enumerate(borders)]
    score, rules = np.zeros(len(y)), set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rows = np.sort(r.permutation(len(y))[: max(1, len(y) // 2)])
        step = np.zeros(len(y))
        kept: set = set()
        _tree(x, borders, p - y, p * (1 - p) + 1e-6, depth, (), rows, kept, step, min(LEAF, max(2, len(y) // 50)))
        rules |= kept
        # rows outside the half follow the paths of the leaves
        other = np.setdiff1d(np.arange(len(y)), rows)
        for path in kept:
            if not any(q != path and q[: len(path)] == path for q in kept):
                inside = holds(x, path)
                known = rows[inside[rows]]
                if len(known):
                    step[other[inside[other]]] = step[known[0]]
        score += 0.3 * step
    return sorted({tuple(sorted(path)) for path in rules})


def holds(x: np.ndarray, path: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, way, border in path:
        out &= x[:, f] <= border if way == "<=" else x[:, f] > border
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, steps: int = 150) -> np.ndarray:
    """Logistic weights, the intercept last and free, by accelerated proximal gradient steps."""
    z1 = np.concatenate([z, np.ones((len(z), 1))], 1)
    v = np.random.default_rng(0).standard_normal(z1.shape[1])
    for _ in range(15):
        v = z1.T @ (z1 @ v)
        v /= np.linalg.norm(v)
    rate = 4 * len(y) / max(1e-9, float(v @ (z1.T @ (z1 @ v)))) * 0.9
    w, look, t = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        g = z1.T @ (1 / (1 + np.exp(-np.clip(z1 @ look, -30, 30))) - y) / len(y)
        new = look - rate * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def fit(x: np.ndarray, y: np.ndarray, seed: int = 1) -> dict:
    """{intercept, rules: [(weight, path)]} from statistics and labels 0 and 1."""
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2) if len(y) else 0.5
        return {"intercept": float(np.log(share / (1 - share))), "rules": []}
    rules = grow_rules(x, y, seed=seed)
    z = np.stack([holds(x, p) for p in rules], 1).astype(np.float64) if rules else np.zeros((len(y), 0))
    test = np.random.default_rng(seed).random(len(y)) < 0.2
    if test.all() or not test.any() or y[~test].min() == y[~test].max():
        test = np.zeros(len(y), bool)
    w, best = np.zeros(z.shape[1] + 1), (np.inf, PENALTIES[-1])
    for penalty in PENALTIES:
        w = lasso(z[~test], y[~test], penalty, w)
        s = z[test] @ w[:-1] + w[-1]
        loss = float(np.logaddexp(0, np.where(y[test] > 0, -s, s)).mean()) if test.any() else 0.0
        if loss < best[0] - 1e-4:
            best = (loss, penalty)
    w = lasso(z, y, best[1], np.zeros(z.shape[1] + 1), 400)
    return {"intercept": float(w[-1]), "rules": [(float(v), p) for v, p in zip(w, rules) if v]}


def compiled(model: dict, columns: list[Column]) -> Column:
    """The model's score, from 0 to 1, as a column expression over the statistics."""
    total = F.lit(model["intercept"])
    for weight, path in model["rules"]:
        test = None
        for f, way, border in path:
            one = columns[f] <= F.lit(border) if way == "<=" else columns[f] > F.lit(border)
            test = one if test is None else test & one
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(fold: int = 1, folds: int = 3) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def learned(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from rows (doc_id, held_out, s: statistics) and labels (doc_id, quality)."""
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).filter("y = y2")
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "y").filter(~held_out())
    got = rows.join(hash_sample(known, sample, ["doc_id"], 5), "doc_id").orderBy("doc_id", "s").limit(sample).collect()
    x = np.array([list(r["s"]) for r in got], np.float64).reshape(len(got), len(STATISTICS))
    return fit(x, np.array([r["y"] for r in got], np.float64))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Learned without fold 1 of 3."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), with_statistics("text").alias("s"))
    rows = written(rows, "quality")
    model = learned(rows, labels)
    score = compiled(model, [F.col(f"s.{s}") for s in STATISTICS])
    return rows.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

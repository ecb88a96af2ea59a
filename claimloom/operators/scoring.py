"""Evidence, scores of local models, and what is drawn from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import values as V
from .graph import MODEL


def support(triples: DataFrame, with_relation: bool = False) -> DataFrame:
    """(subj, obj[, rel], support): how many triples state an edge."""
    keys = ["subj", "obj", "rel"] if with_relation else ["subj", "obj"]
    return triples.filter((F.coalesce("subj", F.lit("")) != "") & (F.coalesce("obj", F.lit("")) != "")).groupBy(*keys).agg(F.count("*").alias("support"))


def examples(triples: DataFrame, k: int = V.EXAMPLES) -> DataFrame:
    """(subj, obj, rel, examples): the first k statements of each edge that are not empty.
    They are ranked by seq in a window of which Spark keeps k rows a group before it shuffles."""
    w = Window.partitionBy("subj", "obj", "rel").orderBy("seq")
    first = triples.filter(F.coalesce("statement", F.lit("")) != "").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k)
    got = first.groupBy("subj", "obj", "rel").agg(F.array_sort(F.collect_list(F.struct("seq", "statement"))).alias("e"))
    return got.select("subj", "obj", "rel", F.col("e.statement").alias("examples"))


def node_support(triples: DataFrame) -> DataFrame:
    """(node, support): in how many triples a node stands."""
    return triples.select(F.explode(F.array("subj", "obj")).alias("node")).groupBy("node").agg(F.count("*").alias("support"))


def text_scores(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, edge_cost: float = V.EDGE_COST, local_only: bool = False) -> DataFrame:
    """(model, n_nodes, n_edges, score): the logarithms of one plus each edge's support, summed,
    less a cost for each edge. The evidence is counted once and met by the edges once. local_only:
    only evidence between nodes of models counts, which changes nothing for models of a sweep, as
    the ends of their edges are their nodes."""
    if local_only:
        for end in ("subj", "obj"):
            evidence = evidence.join(nodes.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    held = edges.join(evidence, (F.col("src") == F.col("subj")) & (F.col("dst") == F.col("obj")), "left")
    gain = F.log1p(F.coalesce("support", F.lit(0)))
    e = held.groupBy(*MODEL).agg(F.count("*").alias("n_edges"), (F.sum(gain) - edge_cost * F.count("*")).alias("score"))
    n = nodes.groupBy(*MODEL).agg(F.count("*").alias("n_nodes"))
    return n.join(e, MODEL, "left").fillna(0, ["n_edges"]).fillna(0.0, ["score"])


def numbers(column: str) -> Column:
    """A score read from text; null where it is none."""
    x = F.expr(f"try_cast(`{column}` AS double)")
    return F.when(~F.isnan(x), x)


def top_models(scores: DataFrame, k: int = V.TOP_MODELS, min_edges: int = 0, one_a_focus: bool = False, blacklist: str | None = None, anchors: list[str] | None = None) -> DataFrame:
    """The k best scores; ties by focus, radius and size. blacklist: a pattern of foci that do not
    count; anchors: words of which the focus must have one."""
    out = scores.filter(F.col("score").isNotNull() & (F.col("n_edges") >= min_edges))
    if blacklist:
        out = out.filter(~F.col("focus").rlike(f"(?i){blacklist}"))
    if anchors:
        out = out.filter(X._any(F.lower("focus"), [a.lower() for a in anchors]))
    if one_a_focus:
        w = Window.partitionBy("focus").orderBy(F.desc(F.round("score", 9)), "radius", "max_nodes")
        out = out.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
    return out.orderBy(F.desc(F.round("score", 9)), "focus", "radius", "max_nodes").limit(k)


def softmax(df: DataFrame, score: str = "score", alpha: float = V.ALPHA) -> DataFrame:
    """df with weight: the softmax of the score over all rows. df is a few models."""
    everything = Window.partitionBy(F.lit(0))
    e = df.withColumn("e", F.exp(F.lit(alpha) * (F.col(score) - F.max(score).over(everything))))
    return e.withColumn("weight", F.col("e") / F.sum("e").over(everything)).drop("e")


def landscape(scores: DataFrame, how: str = "mean") -> DataFrame:
    """(radius, a column a size): mean, median or max score, or the share of scores up to 0."""
    agg = {"mean": F.avg("score"), "median": F.median("score"), "max": F.max("score"), "bad": F.avg(F.when(F.col("score") <= 0, 1.0).otherwise(0.0))}[how]
    return scores.groupBy("radius").pivot("max_nodes").agg(agg)


def best_by_focus(scores: DataFrame, k: int) -> DataFrame:
    return scores.groupBy("focus").agg(F.max("score").alias("best")).orderBy(F.desc("best"), "focus").limit(k)


def gram(table: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means, and centred sums of products of all pairs of columns, in two passes over the
    table whose results are one row each."""
    ok = table.select(*[F.col(c).cast("double").alias(c) for c in columns])
    head = ok.agg(F.count("*"), *[F.avg(c) for c in columns]).first()
    n, means = int(head[0]), np.array([float(x or 0.0) for x in head[1:]])
    centred = ok.select(*[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(columns, means)])
    cells = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = centred.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"s{i}_{j}") for i, j in cells]).first()
    out = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(cells, sums):
        out[i, j] = out[j, i] = float(v or 0.0)
    return n, means, out


def linear_bic(table: DataFrame, parents: dict[str, list[str]]) -> dict[str, float]:
    """The Bayesian information criterion of each node's least squares regression on its parents,
    with an intercept; the rank counts as the number of coefficients."""
    columns = sorted({c for k, v in parents.items() for c in (k, *v)})
    missing = [c for c in columns if c not in table.columns]
    if missing:
        raise KeyError(f"no column for {missing}")
    n, _, s = gram(table, columns)
    at = {c: i for i, c in enumerate(columns)}
    out = {}
    for y, xs in parents.items():
        i, j = at[y], [at[x] for x in xs]
        rank, rss = 1, s[i, i]
        if j:
            inner = s[np.ix_(j, j)]
            rank += int(np.linalg.matrix_rank(inner, hermitian=True))
            rss -= float(s[i, j] @ np.linalg.pinv(inner, hermitian=True) @ s[j, i])
        llf = -n / 2 * (np.log(2 * np.pi) + np.log(max(rss, 1e-300) / n) + 1)
        out[y] = float(-2 * llf + rank * np.log(n))
    return out



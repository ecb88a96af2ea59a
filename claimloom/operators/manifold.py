"""The relational state (dense ids, edges, vectors), its refinement, and layouts of it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import values as V
from .lineage import cut


def encode(triples: DataFrame, columns: list[str]) -> DataFrame:
    """(id, value): dense ids in the order of first sight, by seq and then by column."""
    seen = triples.select("seq", F.posexplode(F.array(*columns)).alias("at", "value")).filter(F.coalesce("value", F.lit("")) != "")
    first = seen.groupBy("value").agg(F.min(F.struct("seq", "at")).alias("first"))
    return _numbered(first, "first", "value")


def _numbered(rows: DataFrame, order: str, keep: str) -> DataFrame:
    """Rows numbered from 0 in order. Ranges of the order are numbered apart, and start where the
    counts of those before end, so no task holds all rows."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged = cut(rows.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id()), "encode")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("n"))
    before = counts.select(F.col("_p").alias("_q"), F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    at = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return ranged.withColumn("r", at).join(F.broadcast(before), F.col("_p") == F.col("_q")).select((F.col("b") + F.col("r")).cast("long").alias("id"), keep)


def relational_state(triples: DataFrame) -> dict[str, DataFrame]:
    """Tables nodes, rel, dom (id, value), and edges (seq, i, j, rel_id, dom_id), one a triple."""
    ok = triples.filter((F.coalesce("subj", F.lit("")) != "") & (F.coalesce("obj", F.lit("")) != ""))
    ok = cut(ok.select("seq", "subj", "rel", "obj", "domain"), "state")  # read four times below
    nodes, rel, dom = encode(ok, ["subj", "obj"]), encode(ok, ["rel"]), encode(ok, ["domain"])
    named = lambda d, i, v: d.select(F.col("id").alias(i), F.col("value").alias(v))
    e = ok.join(named(nodes, "i", "subj"), "subj").join(named(nodes, "j", "obj"), "obj")
    e = e.join(named(rel, "rel_id", "rel"), "rel", "left").join(named(dom, "dom_id", "domain"), "domain", "left")
    return {"nodes": nodes, "rel": rel, "dom": dom, "edges": e.select("seq", "i", "j", "rel_id", "dom_id")}


def node_labels(nodes: DataFrame, edges: DataFrame, dim: DataFrame, column: str) -> DataFrame:
    """(id, label): the least domain or relation id at a node, by name; `var` without one."""
    ends = edges.filter(F.col(column).isNotNull()).select(F.explode(F.array("i", "j")).alias("id"), column)
    least = ends.groupBy("id").agg(F.min(column).alias("d"))
    named = least.join(dim.select(F.col("id").alias("d"), F.col("value").alias("label")), "d")
    return nodes.select("id").join(named.select("id", "label"), "id", "left").select("id", F.coalesce("label", F.lit("var")).alias("label"))


def hashed_vectors(c, dim: int = 64) -> Column:
    """Unit vectors of hashed words: a stand-in for a sentence model, from built-in functions."""
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  Spark would work x out at each use
    words = F.filter(F.split(F.lower(X._col(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    cells = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
    counts = lambda x: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(x, lambda y: y == i)).cast("double"))
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    unit = lambda x: once(norm(x), lambda n: F.transform(x, lambda y: F.when(n > 0, y / n).otherwise(F.lit(0.0))))
    return once(cells, lambda x: once(counts(x), unit))


def encoded(df: DataFrame, column: str, encoder: Callable) -> DataFrame:
    """df with h: the vectors that a sentence model gives the column's texts. encoder: makes the
    model in each task, a function from a list of texts to as many vectors."""

    def run(batches):
        model = encoder()
        for b in batches:
            got = model([x or "" for x in b[column].tolist()])
            yield b.assign(h=[[float(y) for y in v] for v in got])

    return df.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", h array<double>")


def activation(c) -> Column:
    """The length of a vector."""
    return F.sqrt(F.aggregate(X._col(c), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def scaled(df: DataFrame, column: str) -> DataFrame:
    """df with column between 0 and 1; a range under 1e-6 counts as that."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return df if low is None else df.withColumn(column, (F.col(column) - float(low)) / max(float(high) - float(low), 1e-6))


def _normed(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5)


def _layer(rng, *sizes) -> list:
    return [(rng.standard_normal((a, b)) / np.sqrt(a), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]


def _mlp(x: np.ndarray, layers: list) -> np.ndarray:
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i + 1 < len(layers):
            x = np.maximum(x, 0)
    return x


def message_pass(vectors: DataFrame, edges: DataFrame, n_rel: int, dim: int, depth: int = 2, seed: int = 0, norm: bool = True) -> DataFrame:
    """vectors (id, h) refined along edges (i, j, rel_id), from i to j: a message of both ends and
    the relation, summed at j, added to it, and normalised. Weights are random by seed."""
    for step in range(depth):
        net = _layer(np.random.default_rng([seed, step]), 2 * dim + n_rel, dim, dim)

        def messages(batches, net=net):
            for b in batches:
                if len(b):
                    rel = np.eye(n_rel)[b["rel_id"].fillna(0).astype(int).clip(0, n_rel - 1)]
                    m = _mlp(np.concatenate([np.stack(b["hi"]), np.stack(b["hj"]), rel], 1), net)
                    sums = pd.DataFrame(m).groupby(b["j"].to_numpy()).sum()  # partial sums of a batch
                    yield pd.DataFrame({"j": sums.index, "m": list(sums.to_numpy())})

        ends = edges.join(vectors.select(F.col("id").alias("i"), F.col("h").alias("hi")), "i").join(vectors.select(F.col("id").alias("j"), F.col("h").alias("hj")), "j")
        sent = ends.select("j", "rel_id", "hi", "hj").mapInPandas(messages, "j long, m array<double>")
        sums = sent.groupBy("j").agg(*[F.sum(F.col("m")[k]).alias(f"m{k}") for k in range(dim)]).select(F.col("j").alias("_j"), F.array(*[f"m{k}" for k in range(dim)]).alias("m"))
        new = vectors.join(sums, F.col("id") == F.col("_j"), "left")
        h = F.when(F.col("m").isNull(), F.col("h")).otherwise(F.zip_with("h", "m", lambda a, b: a + b))
        out = new.select("id", h.alias("h"))
        if norm:
            mean = F.aggregate("h", F.lit(0.0), lambda s, x: s + x) / dim
            out = out.withColumn("mu", mean)
            out = out.withColumn("sd", F.sqrt(F.aggregate("h", F.lit(0.0), lambda s, x: s + (x - F.col("mu")) * (x - F.col("mu"))) / dim + 1e-5))
            out = out.select("id", F.transform("h", lambda x: (x - F.col("mu")) / F.col("sd")).alias("h"))
        vectors = cut(out, "pass")
    return vectors


def triangle_pass(vectors: DataFrame, triangles: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """vectors refined by their triangles (a, b, c): a message of the mean of the three to each."""
    net = _layer(np.random.default_rng([seed, 99]), dim, dim, dim)
    own = [vectors.select(F.col("id").alias(k), F.col("h").alias(f"h{k}")) for k in "abc"]
    t = triangles.join(own[0], "a").join(own[1], "b").join(own[2], "c")

    def messages(batches):
        for b in batches:
            if len(b):
                m = _mlp((np.stack(b["ha"]) + np.stack(b["hb"]) + np.stack(b["hc"])) / 3, net)
                yield pd.DataFrame({"id": np.concatenate([b["a"], b["b"], b["c"]]), "m": list(np.concatenate([m, m, m]))})

    sent = t.select("a", "b", "c", "ha", "hb", "hc").mapInPandas(messages, "id long, m array<double>")
    sums = sent.groupBy("id").agg(*[F.sum(F.col("m")[k]).alias(f"m{k}") for k in range(dim)]).select(F.col("id").alias("_j"), F.array(*[f"m{k}" for k in range(dim)]).alias("m"))
    return vectors.join(sums, F.col("id") == F.col("_j"), "left").select("id", F.when(F.col("m").isNull(), F.col("h")).otherwise(F.zip_with("h", "m", lambda a, b: a + b)).alias("h"))


def triangle_sums(values: DataFrame, pairs: DataFrame, dim: int, most: int = 500_000) -> DataFrame:
    """(to, h): for each of graph.triangles(pairs (i, j)) the positive part of the sum of its nodes'
    values (id, h), sent to each of its nodes. pairs are distinct.

    There may be as many triangles as cubes of nodes, so none is a row. Nodes are dealt into
    buckets, and each three buckets are a task, which has the pairs among them, about `most`, and
    finds its triangles around each middle. A triangle with several middles is taken at the least."""
    n = max(4, int(np.ceil(np.sqrt(9 * pairs.count() / most))))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(n))
    whole = lambda x: F.aggregate(F.array_sort(x), F.lit(0).cast("long"), lambda s, y: s * n + y)
    every = F.sequence(F.lit(0), F.lit(n - 1))
    tasks = n * (n + 1) * (n + 2) // 6
    plain = pairs.filter("i <> j").select("i", "j", F.explode(F.transform(every, lambda x: whole(F.array(bucket("i"), bucket("j"), x.cast("long"))))).alias("t"))
    two = F.flatten(F.transform(every, lambda x: F.transform(F.sequence(x, F.lit(n - 1)), lambda y: whole(F.array(bucket("id"), x.cast("long"), y.cast("long"))))))
    held = values.select("id", "h", bucket("id").alias("b"), F.explode(two).alias("t"))

    def around(e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(e) or not len(v):
            return pd.DataFrame({"to": np.array([], int), "h": pd.Series([], dtype=object)})
        t = int(e["t"].iloc[0])
        buckets = [t // (n * n), t // n % n, t % n]
        v = v.sort_values("id")
        ids, own, g = v["id"].to_numpy(), v["b"].to_numpy(), np.stack(v["h"]).astype(float)
        e = e[e["i"].isin(ids) & e["j"].isin(ids)]
        size, src, dst = len(ids), np.searchsorted(ids, e["i"].to_numpy()), np.searchsorted(ids, e["j"].to_numpy())
        if size <= 8192:
            table = np.zeros((size, size), bool)
            table[src, dst] = True
            has = lambda x, y: table[np.ix_(x, y)]
        else:
            keys = np.sort(src * size + dst)

            def has(x, y):
                want = x[:, None] * size + y[None]
                return keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want

        ends = np.unique(np.concatenate([src * size + dst, dst * size + src]))
        at, ends = np.searchsorted(ends // size, np.arange(size + 1)), ends % size
        sums = np.zeros((size, dim))
        for m in range(size):
            near = ends[at[m] : at[m + 1]]
            if len(near) < 2 or own[m] not in buckets:
                continue
            rest = list(buckets)
            rest.remove(own[m])
            mid, ys = np.array([m]), near[own[near] == rest[1]]
            xs = near[own[near] == rest[0]]
            if not len(xs) or not len(ys):
                continue
            iy, oy = has(ys, mid)[:, 0][None], has(mid, ys)
            step = max(1, 2_000_000 // (len(ys) * dim))
            for k in range(0, len(xs), step):
                x = xs[k : k + step]
                ix, ox = has(x, mid), has(mid, x)[0][:, None]
                xy, yx = has(x, ys), has(ys, x).T
                ok = (ix & oy) | (iy & ox)
                ok &= ~((x < m)[:, None] & ((ox & xy) | (yx & ix))) & ~((ys < m)[None] & ((xy & iy) | (oy & yx)))
                if rest[0] == rest[1]:
                    ok &= x[:, None] < ys[None]
                r, c = np.nonzero(ok.any(1))[0], np.nonzero(ok.any(0))[0]
                if not len(r):
                    continue
                got = (g[x[r]] + g[m]).T[:, :, None] + g[ys[c]].T[:, None, :]
                np.maximum(got, 0, out=got)
                got *= ok[np.ix_(r, c)][None]
                to_x = got.sum(2).T
                sums[x[r]] += to_x
                sums[ys[c]] += got.sum(1).T
                sums[m] += to_x.sum(0)
        hit = np.nonzero(sums.any(1))[0]
        return pd.DataFrame({"to": ids[hit], "h": pd.Series(list(sums[hit]), dtype=object)})

    shape = "to long, h array<double>"
    whole_ones = plain.repartition(tasks, "t").groupBy("t").cogroup(held.repartition(tasks, "t").groupBy("t")).applyInPandas(around, shape)
    # a loop at u and a pair of u and w are the triangle (u, u, w)
    loops, beside = pairs.filter("i = j").select(F.col("i").alias("u")), pairs.filter("i <> j")
    beside = beside.select(F.col("i").alias("u"), F.col("j").alias("w")).unionByName(beside.select(F.col("j").alias("u"), F.col("i").alias("w"))).distinct().join(loops, "u")
    named = lambda c: values.select(F.col("id").alias(c), F.col("h").alias(f"h{c}"))
    m = F.zip_with("hu", "hw", lambda x, y: F.greatest(2 * x + y, F.lit(0.0)))
    flat = beside.join(named("u"), "u").join(named("w"), "w").withColumn("m", m)
    flat = flat.select(F.explode(F.array(F.struct(F.col("u").alias("to"), F.transform("m", lambda x: 2 * x).alias("h")), F.struct(F.col("w").alias("to"), F.col("m").alias("h")))).alias("x")).select("x.*")
    return whole_ones.unionByName(flat)


def simplicial_layer(vectors: DataFrame, edges: DataFrame, triangles: DataFrame | None, dim: int, seed: int = 0) -> DataFrame:
    """One layer with a residual update: messages of sources along edges (i, j), from i to j, and of
    triangles (a, b, c) to each of their nodes, are summed and go through a small network, whose
    answer is added. Without triangles, those of the edges. Weights are random by seed."""
    rng = np.random.default_rng([seed, 17])
    one, two, last = _layer(rng, dim, dim), _layer(rng, dim, dim), _layer(rng, dim, dim, dim)
    own = vectors.select("id", F.transform("h", lambda x: x.cast("double")).alias("h"))

    def through(net, relu: bool, part: int = 1):
        def run(batches):
            for b in batches:
                if len(b):
                    m = _mlp(np.stack(b["h"]) / part, net)
                    yield pd.DataFrame({"to": b["to"], "h": list(np.maximum(m, 0) if relu else m)})

        return run

    shape = "to long, h array<double>"
    mine = own.select(F.col("id").alias("to"), "h")
    # a source says the same along all of its edges, so edges carry how often it is said
    pairs = cut(edges.groupBy("i", "j").agg(F.count("*").alias("n")), "pairs")
    said = mine.mapInPandas(through(one, True), shape).withColumnRenamed("to", "i")
    along = pairs.join(said, "i").select(F.col("j").alias("to"), F.transform("h", lambda x: x * F.col("n")).alias("h"))
    if triangles is None:
        # a mean goes through one linear layer, so its nodes' thirds do apart, and are added
        thirds = cut(mine.mapInPandas(through(two, False, 3), shape).withColumnRenamed("to", "id"), "thirds")
        sent = triangle_sums(thirds, pairs.select("i", "j"), dim)
    else:
        corners = [own.select(F.col("id").alias(c), F.col("h").alias(f"h{c}")) for c in "abc"]
        t = triangles.select("a", "b", "c").join(corners[0], "a").join(corners[1], "b").join(corners[2], "c")
        mean = F.transform(F.arrays_zip("ha", "hb", "hc"), lambda x: (x["ha"] + x["hb"] + x["hc"]) / 3)
        sent = t.select(F.explode(F.array("a", "b", "c")).alias("to"), mean.alias("h")).mapInPandas(through(two, True), shape)
    sums = along.unionByName(sent).groupBy("to").agg(*[F.sum(F.col("h")[k]).alias(f"m{k}") for k in range(dim)])
    sums = own.select(F.col("id").alias("to")).join(sums, "to", "left").select("to", F.array(*[F.coalesce(f"m{k}", F.lit(0.0)) for k in range(dim)]).alias("h"))
    moved = sums.mapInPandas(through(last, False), shape).select(F.col("to").alias("id"), F.col("h").alias("m"))
    return own.join(moved, "id").select("id", F.zip_with("h", "m", lambda a, b: a + b).alias("h"))


def expert_block(vectors: DataFrame, dim: int, experts: int = 4, seed: int = 0) -> DataFrame:
    """vectors through a mixture of small networks, weighted by a softmax gate, added and normalised."""
    rng = np.random.default_rng([seed, 7])
    gate, nets = _layer(rng, dim, experts), [_layer(rng, dim, 2 * dim, dim) for _ in range(experts)]

    def run(batches):
        for b in batches:
            if len(b):
                x = np.stack(b["h"])
                g = _mlp(x, gate)
                g = np.exp(g - g.max(1, keepdims=True))
                g /= g.sum(1, keepdims=True)
                y = sum(g[:, [k]] * _mlp(x, net) for k, net in enumerate(nets))
                yield pd.DataFrame({"id": b["id"], "h": list(_normed(x + y))})

    return vectors.select("id", F.transform("h", lambda x: x.cast("double")).alias("h")).mapInPandas(run, "id long, h array<double>")


def mean_vector(vectors: DataFrame, dim: int) -> DataFrame:
    """One row: the mean of all vectors."""
    return vectors.agg(*[F.avg(F.col("h")[k]).alias(f"m{k}") for k in range(dim)]).select(F.array(*[f"m{k}" for k in range(dim)]).alias("h"))


def _nearest_of(ids: np.ndarray, q: np.ndarray, k: int, metric: str, cells: int, known: tuple | None = None):
    """A visit of batches (id, h) which yields the k nearest to each of q, nearest first: distances,
    infinite where there is none, and ids. It starts from those that are known, and holds as many
    products as `cells`. Products in single precision leave out what is farther than the k-th best
    by more than their error can be; distances of the rest are worked out in double."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    length = lambda x: np.linalg.norm(x, axis=1)
    best, who = known or (np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64))
    q = unit(q) if metric == "cosine" else q

    def distances(row, v, col):
        x, step = np.empty(len(row)), max(1, cells // q.shape[1])
        for lo in range(0, len(row), step):
            a, b = q[row[lo : lo + step]], v[col[lo : lo + step]]
            if metric == "cosine":
                x[lo : lo + step] = 1 - np.einsum("ij,ij->i", a, b)
            else:
                a -= b
                x[lo : lo + step] = np.sqrt(np.einsum("ij,ij->i", a, a))
        return x

    def visit(batches):
        for b in batches:
            v, own = np.asarray(b["h"]), np.asarray(b["id"])
            v = np.asarray(np.stack(v) if v.dtype == object else v, float)
            whole = np.isfinite(v).all(1)
            v, own = (v, own) if whole.all() else (v[whole], own[whole])
            if not len(v):
                continue
            v = unit(v) if metric == "cosine" else v
            mid = np.zeros(v.shape[1]) if metric == "cosine" else v.mean(0)
            left, right = q - mid, v - mid
            size, reach = length(left), length(right)
            if metric != "cosine":
                # |a - b|^2 = |a|^2 - 2 (a b - |b|^2 / 2); long ones stay together, as errors go by the longest
                order = np.argsort(reach, kind="stable")
                v, own, right, reach = v[order], own[order], right[order], reach[order]
                left, right = np.column_stack([left, np.ones(len(left))]), np.column_stack([right, -reach * reach / 2])
            single = 1e-15 < reach.max() < 1e15 and not (size > 1e15).any()
            kind = np.float32 if single else np.float64
            left, right = left.astype(kind), right.astype(kind)
            for at in range(0, len(own), 1024):
                part, top = np.ascontiguousarray(right[at : at + 1024].T), reach[at : at + 1024].max()
                n = part.shape[1]
                slack = (left.shape[1] + 8) * 2 * np.finfo(kind).eps * (size + top) * top
                step = max(1, min(512, cells // n))
                for lo in range(0, len(q), step):
                    near = left[lo : lo + step] @ part
                    far, s, z = best[lo : lo + step].max(1), slack[lo : lo + step], size[lo : lo + step]
                    new = np.isinf(far)
                    if new.any() and n > k:
                        # a first bound: the k-th (or, beside the own vector, one more) of this part
                        kth = np.partition(near[new], n - k - 1, axis=1)[:, n - k - 1] - s[new]
                        far[new] = 1 - kth if metric == "cosine" else np.sqrt(np.maximum(0, z[new] ** 2 - 2 * kth))
                    far += 1e-8  # ranks go by 9 digits
                    least = (1 - far if metric == "cosine" else (z * z - far * far) / 2) - s
                    least = np.nextafter(least.astype(kind), kind(-np.inf))
                    hit = np.flatnonzero(near.max(1) >= least)  # later on, few rows
                    if not len(hit):
                        continue
                    near, least = (near, least) if len(hit) == len(near) else (near[hit], least[hit])
                    row, col = np.divmod(np.flatnonzero(near >= least[:, None]), n)
                    row, col = hit[row], col + at
                    x = distances(lo + row, v, col)
                    ok = (x <= far[row]) & (ids[lo + row] != own[col])
                    row, col, x = row[ok], col[ok], x[ok]
                    if not len(row):
                        continue
                    some = np.unique(row)
                    r = np.concatenate([np.repeat(some, k), row])
                    x = np.concatenate([best[lo + some].ravel(), x])
                    w = np.concatenate([who[lo + some].ravel(), own[col]])
                    order = np.lexsort((w, np.round(x, 9), r))
                    first = np.searchsorted(r[order], some)
                    keep = order[(first[:, None] + np.arange(k)).ravel()].reshape(-1, k)
                    best[lo + some], who[lo + some] = x[keep], w[keep]
        yield best, who

    return visit


def _tasks(df: DataFrame) -> int:
    """Tasks that rows are dealt to evenly, whatever files they lie in."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def _neighbours(vectors: DataFrame, asked: DataFrame, k: int, metric: str, block: int, cells: int) -> DataFrame:
    """(id, h, other, distance): each asked row with arrays of its k nearest of vectors. All of
    vectors go out, in blocks of at most `block` rows and 64 MB, one a pass; a pass goes over the
    asked rows, dealt evenly, with what the passes before have found. Of equal vectors only the
    first k + 1 ids can be among anyone's k nearest."""
    spark = vectors.sparkSession
    plain = lambda df: df.select("id", F.transform("h", lambda x: x.cast("double")).alias("h")).filter("h is not null")
    equal = F.dense_rank().over(Window.partitionBy(F.xxhash64("h"), "h").orderBy("id"))
    held = cut(plain(vectors).withColumn("_e", equal).filter(F.col("_e") <= k + 1).drop("_e"), "held")
    n, dim = held.agg(F.count("*"), F.max(F.size("h"))).first()
    block = max(1, min(block, (1 << 23) // max(1, dim or 1)))
    tasks, passes = _tasks(vectors), -(-n // block)
    none = [F.lit(None).cast(f"array<{t}>").alias(c) for c, t in (("other", "long"), ("distance", "double"))]
    state, shape = plain(asked).select("id", "h", *none), "id long, h array<double>, other array<long>, distance array<double>"
    state = cut(state, "asked") if passes > 1 else state
    flat = lambda column, kind: column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    for at in range(passes):
        got = held.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == at).toArrow().combine_chunks()
        if not len(got):
            continue
        sent = spark.sparkContext.broadcast((got["id"].to_numpy(), flat(got["h"].combine_chunks(), float).reshape(len(got), -1)))
        del got

        def visit(batches, sent=sent):
            for b in batches:
                ids, h, old = b.column("id").to_numpy(), b.column("h"), b.column("other")
                if not len(ids):
                    continue
                best, who = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)
                has = np.arange(k)[None] < np.maximum(0, old.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[:, None]
                best[has], who[has] = flat(b.column("distance"), float), flat(old, np.int64)
                own, v = sent.value
                ((best, who),) = _nearest_of(ids, flat(h, float).reshape(len(ids), -1), k, metric, cells, (best, who))([{"id": own, "h": v}])
                has = np.isfinite(best)
                ends = pa.array(np.concatenate([[0], has.sum(1).cumsum()]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[has])) for x in (who, best)]
                yield pa.RecordBatch.from_arrays([b.column("id"), h, *lists], ["id", "h", "other", "distance"])

        state = state.repartition(tasks, "id").mapInArrow(visit, shape)
        if at < passes - 1:
            state = cut(state, "nearest")
            sent.unpersist()
    return state


def nearest(vectors: DataFrame, asked: DataFrame, k: int = 15, metric: str = "cosine", block: int = 1 << 17, cells: int = 2_000_000) -> DataFrame:
    """(id, rank, other, distance): the k nearest of vectors (id, h) to each asked one but itself;
    ties by id. Distances are to all vectors, in blocks: the driver and a task hold one block, and
    `cells` distances at once. Null vectors take no part."""
    found = _neighbours(vectors, asked, k, metric, block, cells).select("id", F.posexplode(F.arrays_zip("other", "distance")).alias("at", "x"))
    return found.select("id", (F.col("at") + 1).alias("rank"), "x.other", "x.distance")


def neighbour_layout(vectors: DataFrame, dim: int, k: int = 15, metric: str = "cosine", axes: int = 2, epochs: int = 20, seed: int = 42, nearness: float = 0.1, most: int = 1 << 20) -> DataFrame:
    """(id, xy): a layout that keeps neighbours together. The graph of k nearest neighbours has fuzzy
    weights, which fall off from the nearest one; points start at their principal axes, and each
    epoch pulls neighbours together and pushes each point from a few that a hash draws. An epoch
    is two joins and a sum, whatever the number of points; the same seed gives the same layout.
    Up to `most` points go to the edges, which stay where they are; more are joined by shuffles."""
    vectors = cut(vectors.select("id", F.transform("h", lambda x: x.cast("double")).alias("h")).repartition(_tasks(vectors), "id"), "vectors")
    start = layout(vectors, dim, axes)
    spread = start.agg(*[F.greatest(F.stddev(F.col("xy")[a]), F.lit(1e-9)) for a in range(axes)]).first()
    xy = [(F.col("xy")[a] / float(spread[a] or 1.0)).alias(f"x{a}") for a in range(axes)]
    placed = _numbered(start.select("id", F.struct("id", *xy).alias("_x")).withColumnRenamed("id", "_o"), "_o", "_x")
    points = cut(placed.select(F.col("id").alias("place"), "_x.*"), "layout")
    n = points.count()
    sent = F.broadcast if n <= most else lambda df: df
    place = lambda c, to: sent(points.select(F.col("id").alias(c), F.col("place").alias(to)))
    near = cut(_neighbours(vectors, vectors, k, metric, 1 << 17, 2_000_000).select("id", "other", "distance"), "nearest")
    mean = F.aggregate("distance", F.lit(0.0), lambda s, x: s + x) / F.size("distance")
    near = near.withColumn("low", F.array_min("distance")).withColumn("wide", F.greatest(mean - F.col("low"), F.lit(1e-6)))
    near = near.select("id", "low", "wide", F.explode(F.arrays_zip("other", "distance")).alias("x")).select("id", "x.other", F.exp(-(F.col("x.distance") - F.col("low")) / F.col("wide")).alias("p"))
    near = near.join(place("id", "i"), "id").join(place("other", "j"), "other").select("i", "j", "p")
    both = near.unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"), "p"))
    # of a pair that is in it twice: either or both, as fuzzy sets are joined; a point's edges lie together, so their sum is one row
    graph = cut(both.repartition("i").groupBy("i", "j").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))).alias("p")), "neighbours")
    for epoch in range(epochs if n > 1 else 0):
        rate = 0.5 * (1 - epoch / epochs)
        drawn = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.pmod(F.xxhash64("id", i, F.lit(seed), F.lit(epoch)), F.lit(n)))
        far = points.select(F.col("place").alias("i"), F.explode(drawn).alias("j"), F.lit(0.0).alias("p")).filter("i <> j")
        at = points.drop("id")
        pairs = graph.unionByName(far).join(sent(at.alias("a")), F.col("i") == F.col("a.place")).join(sent(at.alias("b")), F.col("j") == F.col("b.place"))
        v = [F.col(f"a.x{a}") - F.col(f"b.x{a}") for a in range(axes)]
        pairs = pairs.select("i", "p", *[x.alias(f"v{a}") for a, x in enumerate(v)])
        d2 = sum((F.col(f"v{a}") * F.col(f"v{a}") for a in range(axes)), F.lit(0.0))
        pull = -F.col("p") / (1 + d2)
        push = 1 / ((nearness + d2) * (1 + d2))
        pairs = pairs.withColumn("g", F.when(F.col("p") > 0, pull).otherwise(push))
        step = [F.sum(F.least(F.greatest(F.col("g") * F.col(f"v{a}"), F.lit(-1.0)), F.lit(1.0))).alias(f"m{a}") for a in range(axes)]
        moved = pairs.groupBy(F.col("i").alias("place")).agg(*step)
        points = cut(points.join(moved, "place", "left").select("place", "id", *[(F.col(f"x{a}") + rate * F.coalesce(f"m{a}", F.lit(0.0)) / (k / 4)).alias(f"x{a}") for a in range(axes)]), "layout")
    return points.select("id", F.array(*[f"x{a}" for a in range(axes)]).alias("xy"))


def layout(vectors: DataFrame, dim: int, axes: int = 2) -> DataFrame:
    """(id, xy): the principal axes of the vectors, by one pass for means and one for products.
    Signs are fixed by the largest coefficient."""
    cols = [F.col("h")[i].cast("double").alias(f"c{i}") for i in range(dim)]
    flat = vectors.select("id", *cols)
    means = np.array([float(x or 0.0) for x in flat.agg(*[F.avg(f"c{i}") for i in range(dim)]).first()])

    def products(batches):
        s = np.zeros((dim, dim))
        for b in batches:
            x = b.to_numpy(float) - means
            s += x.T @ x
        yield pd.DataFrame({"s": [s.ravel()]})

    parts = flat.drop("id").mapInPandas(products, "s array<double>")
    cov = np.zeros(dim * dim)
    for r in parts.select(F.posexplode("s").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():  # dim * dim rows
        cov[r["at"]] = r["x"]
    cov = cov.reshape(dim, dim)
    _, vec = np.linalg.eigh(cov)
    top = vec[:, ::-1][:, :axes]
    top = top * np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])
    coords = [sum((F.col(f"c{i}") - float(means[i])) * float(top[i, a]) for i in range(dim)) for a in range(top.shape[1])]
    return flat.select("id", F.array(*coords).alias("xy"))


def hover_clusters(points: DataFrame, labels: DataFrame, steps: int = 10) -> DataFrame:
    """Clusters of a 2-D layout: points (id, xy), labels (id, label). Lloyd's steps from evenly
    spaced points; size, centre, the 0.85-quantile of distances, and up to 4 labels near the centre."""
    p = cut(points.select("id", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y")), "points")
    head = p.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    n = head[0]
    shape = "cluster int, label string, sample_labels array<string>, point_count long, x_norm double, y_norm double, radius_norm double"
    if n < 2:
        return p.sparkSession.createDataFrame([], shape)
    k = min(n, max(3, min(8, int(round(np.sqrt(n / 18.0))) + 2)))
    at = [int(x) for x in np.linspace(0, n - 1, num=k, dtype=int)]
    order = _numbered(p.withColumn("_o", F.col("id")), "_o", "id")
    seeds = {r["id"]: (r["x"], r["y"]) for r in order.withColumnRenamed("id", "nn").toDF("nn", "id").join(p, "id").filter(F.col("nn").isin(*at)).select("nn", "x", "y").withColumnRenamed("nn", "id").collect()}
    centers = [seeds[i] for i in at]

    def near(c):
        return F.array_min(F.array(*[F.struct(((F.col("x") - float(x)) * (F.col("x") - float(x)) + (F.col("y") - float(y)) * (F.col("y") - float(y))).alias("d"), F.lit(i).alias("i")) for i, (x, y) in enumerate(c)]))

    for _ in range(steps):
        got = p.select(near(centers)["i"].alias("i"), "x", "y").groupBy("i").agg(F.avg("x"), F.avg("y")).collect()
        new = list(centers)
        for i, x, y in got:
            new[i] = (x, y)
        if np.allclose(new, centers, rtol=0, atol=1e-12):
            break
        centers = new
    own = p.withColumn("cluster", near(centers)["i"])
    c = own.groupBy("cluster").agg(F.count("*").alias("point_count"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = own.join(F.broadcast(c), "cluster").withColumn("d", F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2))
    radius = d.groupBy("cluster").agg(F.percentile("d", F.lit(V.HOVER_QUANTILE)).alias("r"))
    named = d.join(labels.select("id", X.hover_label("label").alias("l")), "id").filter("l <> ''").groupBy("cluster", "l").agg(F.min(F.struct("d", "id")).alias("f"))
    first = named.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy("f", "l"))).filter("k <= 4")
    four = first.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("k", "l"))).alias("s")).select("cluster", F.col("s.l").alias("sample_labels"))
    sx, sy = (head[2] - head[1]) or 1.0, (head[4] - head[3]) or 1.0
    out = c.join(radius, "cluster").join(four, "cluster")
    return out.select(
        (F.col("cluster") + 1).cast("int").alias("cluster"), F.array_join(F.slice("sample_labels", 1, 3), " / ").alias("label"), "sample_labels", "point_count",
        ((F.col("cx") - head[1]) / sx).alias("x_norm"), (1.0 - (F.col("cy") - head[3]) / sy).alias("y_norm"),
        F.least(F.lit(V.HOVER_MOST), F.greatest(F.lit(V.HOVER_LEAST), F.greatest(F.col("r") / max(sx, sy), F.lit(V.HOVER_FLOOR)) * V.HOVER_WIDER)).alias("radius_norm"),
    ).orderBy(F.desc("point_count"), "label")


def vector_column(df: DataFrame, names: tuple = ("emb_refined", "emb", "embedding", "h")) -> str:
    """The first of the names that df has, else its only column of numbers' arrays."""
    for n in names:
        if n in df.columns:
            return n
    arrays = [n for n, t in df.dtypes if t in ("array<float>", "array<double>")]
    if len(arrays) != 1:
        raise ValueError(f"no column of vectors among {df.columns}")
    return arrays[0]


def export_points(points: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, xy, label, domain): a layout with each node's clean name and its own domain."""
    named = nodes.select("id", X.clean_label("value").alias("label"))
    return points.join(named, "id").join(labels.select("id", F.col("label").alias("domain")), "id", "left")

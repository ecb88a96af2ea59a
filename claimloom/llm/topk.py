"""Exact top-k search by inner product over a pivot-distance index.

Vectors are rounded down to integers and lifted by one coordinate that gives all the same
length, so that the largest inner product is the least distance. The index keys each vector
by its nearest pivot and its distance to it; the distances around a pivot are cut into
annuli. For a query at distance d from a pivot, a vector at distance r from it is no nearer
than |d - r|, which bounds the inner products of a whole annulus from above. A task visits
the annuli of its part of the index in the order of that bound and leaves out, for each
query, those that cannot reach its k-th best score so far. All arithmetic on scores is
exact; bounds get a margin for rounding, so nothing that could count is left out.

Pivots and annuli are fitted on a bounded sample; every vector is in the index. Queries are
taken in blocks of about QUERIES, each one pass over the index. What a block has found is
written before the next one is read, so the driver holds one block, whatever their number.

Defined cases. Vectors that are null or hold a null or a component that is not finite take
no part. Shorter vectors count as padded with zeros. Equal rows are one; rows with the id of
the query are never its results. Ties go to the smaller id. Scores must fit a long. An empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash_sample, written

#: Rows of the sample, most pivots, vectors an annulus is meant to have, queries of a block,
#: vectors of one matrix product.
SAMPLE, PIVOTS, ANNULUS, QUERIES, CHUNK = 4096, 256, 400, 20_000, 512


def integers(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    ok = F.col(vector).isNotNull() & ~F.exists(vector, bad)
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix of dim columns, shorter rows padded with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def exact_kind(dim: int, largest: int):
    """A number type in which inner products of dim such components are exact."""
    most = dim * largest * largest
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    """v with the coordinate that brings its squared length to top."""
    f = v.astype(np.float64)
    return np.concatenate([f, np.sqrt(np.maximum(0, top - (f * f).sum(1)))[:, None]], 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


class Pivots:
    """Pivots by a few k-means steps over a sample, and the borders of the annuli around each."""

    def __init__(self, sample: np.ndarray, top: float, rows: int, seed: int = 1):
        s, r = lifted(sample, top), np.random.default_rng(seed)
        self.top, self.dim = top, sample.shape[1]
        n = int(max(1, min(PIVOTS, np.sqrt(rows) / 4, len(s))))
        p = s[r.choice(len(s), n, replace=False)]
        for _ in range(5):
            near = distances(s, p).argmin(1)
            for i in range(n):
                if (near == i).any():
                    p[i] = s[near == i].mean(0)
        self.p = p
        d = distances(s, p)
        near, least = d.argmin(1), d.min(1)
        rings = int(max(1, min(64, rows / n / ANNULUS)))
        cuts = [np.quantile(own, np.linspace(0, 1, rings + 1)[1:-1]) if len(own := least[near == i]) else np.zeros(rings - 1) for i in range(n)]
        self.rings, self.cuts = rings, np.array(cuts).reshape(n, rings - 1)

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The annulus of each vector, numbered pivot by pivot, and its distance to the pivot."""
        d = distances(lifted(v, self.top), self.p)
        near, least = d.argmin(1), d.min(1)
        ring = (least[:, None] > self.cuts[near]).sum(1)
        return near * self.rings + ring, least


def better(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by (score descending, id ascending)."""
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


_NONE = np.iinfo(np.int64).min + 1
_LAST = np.iinfo(np.int64).max


def search(cells, ids, dist, v, query_ids, queries, pivots: Pivots, known: np.ndarray, k: int, kind):
    """The k best among these vectors for each query: scores and ids. known: a score that a
    query's k-th best reaches for certain."""
    nq = len(queries)
    best, who = np.full((nq, k), _NONE), np.full((nq, k), _LAST)
    if not len(ids):
        return best, who
    order = np.lexsort((ids, cells))
    cells, ids, dist, v = cells[order], ids[order], dist[order], v[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    last = np.append(first[1:], len(cells))
    low, high = np.minimum.reduceat(dist, first), np.maximum.reduceat(dist, first)
    q = queries.astype(np.float64)
    to = distances(np.concatenate([q, np.zeros((nq, 1))], 1), pivots.p)[:, cells[first] // pivots.rings]
    gap = np.maximum(0, np.maximum(to - high, low - to))
    size = (q * q).sum(1)[:, None] + pivots.top
    bound = (size - gap * gap) / 2 + 1e-6 * (size + 1)
    exact, asked = v.astype(kind), queries.astype(kind)
    for c in np.argsort(-bound.max(0), kind="stable"):
        for a in range(first[c], last[c], CHUNK):
            b = min(a + CHUNK, last[c])
            use = np.flatnonzero(bound[:, c] >= np.maximum(known, best[:, -1]))
            if not len(use):
                break
            s = (asked[use] @ exact[a:b].T).astype(np.int64)
            s[query_ids[use][:, None] == ids[None, a:b]] = _NONE
            if b - a > k:
                # ids ascend, so the first of equal scores are the ones to keep
                if kind is np.float32:  # scores below 2^24: the place breaks ties within a long
                    s2 = np.maximum(s, -(1 << 25)) * (b - a) - np.arange(b - a)
                    at = np.argpartition(s2, b - a - k, axis=1)[:, -k:]
                else:
                    at = np.argsort(-s, axis=1, kind="stable")[:, :k]
                s, i = np.take_along_axis(s, at, 1), ids[a:b][at]
            else:
                i = np.broadcast_to(ids[a:b], s.shape)
            i = np.where(s == _NONE, _LAST, i)
            best[use], who[use] = better(np.concatenate([best[use], s], 1), np.concatenate([who[use], i], 1), k)
    return best, who


def top_k(table: DataFrame, ident: str, vector: str, asks: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows of table that `asks` picks, the k rows of
    table with the largest inner product."""
    spark = table.sparkSession
    rows = table.select(F.col(ident).cast("long").alias("id"), integers(vector, scale).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = written(rows.filter("id is not null and v is not null").distinct(), "topk-rows")
    facts = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)), F.count_if("asks")).first()
    shape = "query_id long, rank int, vec_id long, score long"
    if not facts[0] or not facts[4]:
        return spark.createDataFrame([], shape)
    dim, largest, top = max(1, facts[1]), int(facts[2] or 0), float(facts[3] or 0.0)
    kind = exact_kind(dim, largest)

    def arrays(got) -> tuple[np.ndarray, np.ndarray]:
        return np.array([r["id"] for r in got], np.int64), matrix(pa.array([r["v"] for r in got], pa.list_(pa.int64())), dim)

    sample_ids, sample = arrays(hash_sample(rows, SAMPLE, ["id", "v"], 3).collect())
    pivots = Pivots(sample, top, facts[0])

    def key(batches):
        for b in batches:
            cells, dist = pivots.cells(matrix(b.column("v"), dim))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), b.column("id"), pa.array(dist), b.column("v")], ["cell", "id", "dist", "v"])

    parts = max(1, min(facts[0] // 5000, 100_000) + 1)
    keyed = rows.select("id", "v").mapInArrow(key, "cell long, id long, dist double, v array<long>")
    # annuli of a pivot lie together; a range that one annulus fills is cut by id
    index = written(keyed.repartitionByRange(parts, "cell", "id"), "topk-index")

    def found(query_ids, queries):
        s = (queries.astype(kind) @ sample.astype(kind).T).astype(np.int64)
        s[query_ids[:, None] == sample_ids[None, :]] = _NONE
        s = np.concatenate([s, np.full((len(s), k), _NONE)], 1)
        known = np.partition(s, s.shape[1] - k, axis=1)[:, -k]

        def visit(batches):
            got = pa.Table.from_batches(batches).combine_chunks()
            if not got.num_rows:
                return
            v = got.column("v").combine_chunks()
            v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
            c, i, d = (got.column(x).to_numpy() for x in ("cell", "id", "dist"))
            best, who = search(c, i, d, matrix(v, dim), query_ids, queries, pivots, known, k, kind)
            at, _ = ok = np.nonzero(who != _LAST)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[at]), pa.array(at, pa.int64()), pa.array(who[ok]), pa.array(best[ok])], ["query_id", "n", "vec_id", "score"])

        return index.mapInArrow(visit, "query_id long, n long, vec_id long, score long")

    blocks = facts[4] // QUERIES + 1
    asked = written(rows.filter("asks").select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block")), "topk-queries")
    done = []
    for block in range(blocks):
        got = asked.filter(F.col("block") == block).orderBy("id", "v").collect()
        if got:
            one = best_of(found(*arrays(got)), k)
            done.append(written(one, "topk-found") if blocks > 1 else one)
    out = done[0]
    for one in done[1:]:
        out = out.unionByName(one)
    return out


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query (n) of a block, of what the parts of the index have found."""
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_report(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, "vec_id", "embedding", F.col("vec_id") % 50 == 0)

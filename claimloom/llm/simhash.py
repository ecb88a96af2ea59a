"""Near-duplicate documents by 64-bit SimHash and pigeonring filtering.

A text's fingerprint has a bit where more than half of its word shingles' XXH64 hashes
have it. Two fingerprints link if at most `k` bits differ. The 64 bits are cut into k + 1
consecutive segments that form a ring. If at most k bits differ, some segment starts a
chain along the ring in which the first j segments together differ in at most
j * k / (k + 1) bits, for every j. So candidates agree in a whole segment and differ in
one bit at most in the next, which is a join by equality with the one-bit neighbours of
that next segment; the longer chains are checked on each joined pair, and the full
distance last. Rows are dealt by key as packed arrays; a part works through its pairs in
blocks, and hands on stars of what it has joined, not the pairs.

first_of_each() goes by the similarity of 5-word shingles, for which fingerprints may differ in
far more bits than such keys can bear; near_copies brings its candidates together, filters
them on the ring of their fingerprints, and checks them exactly.

Defined cases. Null texts and texts without a word have fingerprint zero and link like
any other. Fewer words than a shingle make one shingle of all. Equal fingerprints are
folded to one before the join, so copies never meet as pairs; repeated rows are copies.
A null doc_id takes part, and names a component only where no other id is there. An empty
table gives an empty table.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, numbered, shuffle_partitions, small_batches, written
from .components import components
from .fingerprints import SEED, sketch
from .near_copies import SIMILAR, groups
from .near_copies import SHINGLE as WIDE
from .packing import PACKED, mixed, packed, packed_batch, unpacked

#: Words of a shingle, and differing bits of a link.
SHINGLE, DISTANCE = 4, 4


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text in UTF-8."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < n:
        hashes = [digest(joined, SEED)]
    else:
        ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
        starts = [0, *[e + 1 for e in ends]]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :])]
    return int.from_bytes(sketch(np.array(hashes, np.uint64)), "little")


def simhash(text: str | Column, n: int = SHINGLE) -> Column:
    """The fingerprint as a signed long with the same bits."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        out = [fingerprint(t, n) for t in texts.cast(pa.binary()).to_pylist()]
        return pa.array(np.array(out, dtype=np.uint64).view(np.int64))

    return run(text)


def segments(k: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the k + 1 segments, of 22 bits at most."""
    base, more = divmod(64, k + 1)
    sizes = [base + (i < more) for i in range(k + 1)]
    return list(zip([0, *accumulate(sizes)], sizes))


def _keys(prints: np.ndarray, k: int, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows: of each chain of two segments the number and both values. near:
    also the values that differ from the second one in a bit."""
    parts, m = segments(k), k + 1
    keys = []
    for i in range(m):
        (f1, b1), (f2, b2) = parts[i], parts[(i + 1) % m]
        one = (prints >> np.uint64(f1)) & np.uint64((1 << b1) - 1)
        two = (prints >> np.uint64(f2)) & np.uint64((1 << b2) - 1)
        for flip in (0, *[1 << b for b in range(b2)]) if near else (0,):
            # at most 22 bits of a segment below the chain's number
            keys.append(np.uint64(i << 50) | (one << np.uint64(25)) | (two ^ np.uint64(flip)))
    return np.concatenate(keys), np.tile(prints, len(keys))


def _masks(k: int) -> np.ndarray:
    """For each length of a chain from 3 on, and each start, the bits that it covers."""
    parts, m = segments(k), k + 1
    cover = lambda i, n: sum(((1 << parts[(i + j) % m][1]) - 1) << parts[(i + j) % m][0] for j in range(n))
    return np.array([[cover(i, n) for i in range(m)] for n in range(3, m)], np.uint64).reshape(-1, m)


def _linked(index: np.ndarray, probe: np.ndarray, k: int, block: int = 1 << 18):
    """Yields the pairs (u < v) of fingerprints that share a key and differ in k bits at most, some
    at a time. A pair whose chains' differences are over budget is dropped before it is counted."""
    index, masks, m = np.sort(index, order="key"), _masks(k), k + 1
    low = np.searchsorted(index["key"], probe["key"], "left")
    many = np.searchsorted(index["key"], probe["key"], "right") - low
    probe, low, many = probe[many > 0], low[many > 0], many[many > 0]
    sums, at = np.cumsum(many), 0
    while at < len(probe):
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + block, "right")))
        n = many[at:to]
        own = np.repeat(np.arange(at, to), n)
        other = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + low[own]
        u, v, chain = probe["fp"][own], index["fp"][other], (probe["key"][own] >> np.uint64(50)).astype(np.int64)
        ok = u < v
        for i, covered in enumerate(masks):
            u, v, chain = u[ok], v[ok], chain[ok]
            ok = np.bitwise_count((u ^ v) & covered[chain]) <= (i + 3) * k // m
        u, v = u[ok], v[ok]
        ok = np.bitwise_count(u ^ v) <= k
        yield u[ok], v[ok]
        at = to


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as edges u, v, each as a star around its smallest node."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[leaf]], nodes[leaf]


_KEYED = np.dtype([("key", "<u8"), ("fp", "<u8")])
#: Index and probe rows that make up a part; fingerprints that are dealt at once.
PART_ROWS, DEALT = 400_000, 4_000


def near_links(prints: DataFrame, k: int = DISTANCE, folded: bool = False) -> DataFrame:
    """prints (fp long, distinct) to the pairs (u, v) that differ in k bits at most. folded: what
    each part finds is folded to stars, which join the same fingerprints, though not all in one
    step; so a close group of n gives n - 1 rows a part, and its pairs are never written down."""
    if not 2 <= k <= 15:
        raise ValueError("k must be from 2 to 15")
    rows = (k + 1) * (2 + 64 // (k + 1))
    parts = max(shuffle_partitions(prints.sparkSession), prints.count() * rows // PART_ROWS + 1)

    def gathered(batches):
        held = []
        for b in batches:
            held.append(b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, held)) >= DEALT:
                yield np.concatenate(held)
                held = []
        if held:
            yield np.concatenate(held)

    def deal(batches):
        for fp in gathered(batches):
            out = []
            for kind in (0, 1):
                key, own = _keys(fp, k, bool(kind))
                r = np.empty(len(key), _KEYED)
                r["key"], r["fp"] = key, own
                out += packed(r, (mixed(key) % np.uint64(parts)).astype(np.int64), kind)
            if out:
                yield packed_batch(out)

    def join(batches):
        got = unpacked(batches, {0: _KEYED, 1: _KEYED})
        u = v = np.empty(0, np.uint64)
        for x, y in _linked(got[0], got[1], k):
            if folded:
                u, v = np.concatenate([u, x]), np.concatenate([v, y])
                if len(u) > 1 << 18:
                    u, v = stars(u, v)
            elif len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["u", "v"])
        if folded and len(u):
            u, v = stars(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    dealt = prints.select("fp").mapInArrow(deal, PACKED)
    return dealt.repartition(parts, "part").mapInArrow(join, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, n: int = SHINGLE, k: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs. component_id is the smallest doc_id that the
    row reaches over links."""
    small_batches(docs.sparkSession)
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), simhash("text", n).alias("fp")), "simhash")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-prints")
    roots = components(near_links(prints.select("fp"), k, True))
    linked = prints.join(roots, F.col("fp") == F.col("node")).select("fp", "least", "root")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select(F.col("fp").alias("f2"), F.col("component_id").alias("c2"))
    names = prints.join(named, F.col("fp") == F.col("f2"), "left").select("fp", F.coalesce("c2", "least").alias("component_id"))
    return rows.join(written(names, "simhash-names"), "fp").select("doc_id", "fp", "component_id")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, n: int = WIDE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """docs with one row of each group of near copies, by the similarity of their shingles: that
    of its smallest doc_id. Several rows with this id and text count as one document, of which
    the row with the smallest hash of its columns stays."""
    rows, again = numbered(docs)
    found = groups(rows.select(F.col("__doc").alias("doc"), "text").dropDuplicates(["doc"]) if again else rows.select(F.col("__doc").alias("doc"), "text"), n, similar)
    kept = rows.join(found.filter("doc = root").select(F.col("doc").alias("__first")), F.col("__doc") == F.col("__first"), "left_semi")
    if again:
        whole = F.struct(*columns(docs))
        kept = kept.groupBy("__doc").agg(F.min_by(whole.alias("x"), F.xxhash64(F.to_json(whole))).alias("x")).select("x.*")
    return kept.select(*columns(docs))

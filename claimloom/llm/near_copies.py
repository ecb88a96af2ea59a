"""The groups of near copies behind operator 3's stage: SimHash, pigeonring filtering, exact check.

Two texts link if their sets of word shingles have a Jaccard similarity of SIMILAR or more.
Fingerprints that far apart differ in many bits, and keys short enough to allow for them would
bring all texts together. So candidates share a shingle first: shingles are put in one order,
the first few of a text are its prefix, and the prefix is so long that two texts that link
have a shingle of it in common. Any one order will do for that: it goes by how many texts of
a sample hold a shingle, and then by hash, so that shingles of many texts are seldom in a prefix.

Texts that share a shingle of their prefixes make a run, in which 128-bit SimHash fingerprints
are compared. Their segments form a ring, and a pair stays only if from some segment on every
chain of consecutive segments is within its share of RADIUS, up to the whole ring, which is
the Hamming check. RADIUS is over five standard deviations above what texts at the limit
differ in; texts of few shingles, of which that does not hold, are not put to it. What stays
is compared by the sets themselves.

First all of a run are compared with its smallest member. What then still lies in different
components is compared in pairs, so a group of near copies is not compared pair by pair, and
no link that joins two components is left out.

Defined cases. Words are cut at ASCII white space, A-Z in lower case. Texts with the same
words are folded to one before the join, by 128 bits. Null texts and texts without a word
are copies of each other. Fewer words than a shingle make one shingle of all. A null doc_id
comes first. An empty table gives an empty table.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, release, shuffle_partitions, small_batches, written
from .components import components
from .fingerprints import SEED, sketch, within_ring
from .packing import PACKED, mixed, packed, packed_batch, unpacked

#: Words of a shingle; the similarity of a link as a fraction; differing bits of 128 that links may
#: have, and the shingles from which on they are asked for; the texts of the sample.
SHINGLE, SIMILAR, RADIUS, FEW, SAMPLE = 5, (4, 5), 42, 24, 20_000
#: Rows of prefixes that make up a part, and pairs that are made at once.
PART_ROWS, BLOCK = 250_000, 1 << 16
_FIELDS = [("key", "<u8"), ("unit", "<i8"), ("size", "<i4"), ("place", "<i4"), ("f0", "<u8"), ("f1", "<u8")]
_KEYED, _NAMED = np.dtype(_FIELDS), np.dtype([*_FIELDS, ("root", "<i8")])
_PAIR = np.dtype([("u", "<i8"), ("v", "<i8")])
_RUNS, _PAIRS = "key long, unit long, size int, place int, f0 long, f1 long", "u long, v long"


def shingles(text: bytes | None, n: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """The hash of a text's words, 16 bytes, and the distinct hashes of its shingles."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and ASCII white space only
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    unit = xxhash.xxh3_128_digest(joined, SEED)
    if not words:
        return unit, np.empty(0, np.uint64)
    if len(words) < n:
        return unit, np.array([digest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0, *[e + 1 for e in ends]]
    return unit, np.array(list({digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :])}), np.uint64)


def least_shared(a, b, similar: tuple[int, int] = SIMILAR):
    """The fewest shingles that sets of a and b shingles share if they link."""
    p, q = similar
    return (p * (a + b) + p + q - 1) // (p + q)


def prefix(size: int, similar: tuple[int, int] = SIMILAR) -> int:
    """How many of the first shingles of a set of this size hold one that a linked set has in its own."""
    p, q = similar
    return size - (p * size + q - 1) // q + 1 if size else 0


def linked(a: np.ndarray, b: np.ndarray, similar: tuple[int, int] = SIMILAR) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * similar[1] >= similar[0] * (len(a) + len(b) - shared)


def _common(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several texts of a sample hold, and how many do. About SAMPLE texts, by
    their hash, so their shingles bound what the driver gets and the tasks hold."""
    part, total = 1 << 30, max(1, docs.count())
    texts = docs.select("text").filter(F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(part)) < part * SAMPLE // total).distinct()

    def cut(batches):
        for b in batches:
            got = [shingles(t, n)[1] for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *got]).view(np.int64))], ["h"])

    found = texts.mapInArrow(cut, "h long").groupBy("h").count().filter("count > 2").toPandas()
    keys = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["count"].to_numpy(np.int64)[order]


def _rows(docs: DataFrame, n: int, similar: tuple[int, int]) -> DataFrame:
    """Of each document the hash of its words, its shingles' number and fingerprint, and the hashes
    of those in its prefix."""
    keys, counts = _common(docs, n)

    def run(batches):
        for b in batches:
            units, sizes, prints, firsts = [], [], [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                unit, h = shingles(t, n)
                held = np.zeros(len(h), np.int64)
                if len(keys):
                    at = np.searchsorted(keys, h).clip(max=len(keys) - 1)
                    held = np.where(keys[at] == h, counts[at], 0)
                own = mixed(h)
                units.append(unit)
                sizes.append(len(h))
                prints.append(sketch(h) + sketch(own))
                firsts.append(h[np.lexsort((own, held))[: prefix(len(h), similar)]].tobytes())
            got = [pa.array(x, t) for x, t in ((units, pa.binary()), (sizes, pa.int32()), (prints, pa.binary()), (firsts, pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column("doc"), *got], ["doc", "words", "size", "print", "prefix"])

    return written(docs.select("doc", "text").mapInArrow(run, "doc long, words binary, size int, print binary, prefix binary"), "copies-rows")


def _starts(runs: np.ndarray, *by: str) -> np.ndarray:
    """Where the rows, sorted, begin a new value of these fields."""
    new = np.zeros(len(runs), bool)
    new[:1] = True
    for c in by:
        new[1:] |= runs[c][1:] != runs[c][:-1]
    return np.flatnonzero(new)


def _ends(starts: np.ndarray, n: int) -> np.ndarray:
    """Of each of n rows the end of its group."""
    ends = np.append(starts, n)
    return np.repeat(ends[1:], np.diff(ends))


def candidates(x: np.ndarray, y: np.ndarray, similar: tuple[int, int] = SIMILAR, radius: int = RADIUS) -> np.ndarray:
    """Which pairs of rows of a run may link, if the shingle is the first that they share: by their
    sizes, and by their fingerprints on the ring."""
    left = np.minimum(x["size"] - x["place"], y["size"] - y["place"]).astype(np.int64)
    need = least_shared(x["size"].astype(np.int64), y["size"].astype(np.int64), similar)
    at = np.flatnonzero((x["unit"] != y["unit"]) & (left >= need))
    x, y = x[at], y[at]
    apart = np.stack([x["f0"] ^ y["f0"], x["f1"] ^ y["f1"]], 1)
    return at[(np.minimum(x["size"], y["size"]) < FEW) | within_ring(apart, radius)]


def _pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The pairs of units, the smaller first, each once."""
    out = np.empty(len(x), _PAIR)
    out["u"], out["v"] = np.minimum(x["unit"], y["unit"]), np.maximum(x["unit"], y["unit"])
    return np.unique(out)


def _deal(parts: int):
    def deal(batches):
        for b in batches:
            out = []
            for unit, size, print_, data in zip(*(b.column(c).to_pylist() for c in ("doc", "size", "print", "prefix"))):
                h = np.frombuffer(data, np.uint64)
                r = np.empty(len(h), _KEYED)
                r["key"], r["unit"], r["size"], r["place"] = h, unit, size, np.arange(len(h))
                r["f0"], r["f1"] = np.frombuffer(print_, np.uint64)
                out.append(r)
            r = np.concatenate([np.empty(0, _KEYED), *out])
            if len(r):
                yield packed_batch(packed(r, (mixed(r["key"]) % np.uint64(parts)).astype(np.int64), 0))

    return deal


def _gather(similar: tuple[int, int]):
    """Kind 0: the rows of each key that several texts have. Kind 1: candidates among the pairs of
    each of them and the smallest."""

    def gather(batches):
        r = unpacked(batches, {0: _KEYED})[0]
        r = r[np.lexsort((r["unit"], r["key"]))]
        many = np.diff(np.append(_starts(r, "key"), len(r)))
        r = r[np.repeat(many, many) > 1]
        starts = _starts(r, "key")
        first = np.repeat(starts, np.diff(np.append(starts, len(r))))
        for at in range(0, len(r), BLOCK):
            x, y = r[first[at : at + BLOCK]], r[at : at + BLOCK]
            ok = candidates(x, y, similar)
            out = [(0, 0, y.tobytes())] + ([(0, 1, _pairs(x[ok], y[ok]).tobytes())] if len(ok) else [])
            yield packed_batch(out)

    return gather


def _flat(rows: DataFrame, kind: int, dtype: np.dtype, shape: str) -> DataFrame:
    """The packed rows of a kind as rows."""

    def run(batches):
        for b in batches:
            for x in b.column("packed").to_pylist():
                r = np.frombuffer(x, dtype)
                cells = [np.ascontiguousarray(r[c]) for c in dtype.names]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cells], list(dtype.names))

    return rows.filter(F.col("kind") == kind).mapInArrow(run, shape)


def _crossing(similar: tuple[int, int]):
    """Candidates among the pairs of a run that lie in different components."""

    def crossing(batches):
        r = unpacked(batches, {0: _NAMED})[0]
        r = r[np.lexsort((r["unit"], r["root"], r["key"]))]
        n = len(r)
        low, high = _ends(_starts(r, "key", "root"), n), _ends(_starts(r, "key"), n)
        many = high - low
        own, low, many = np.flatnonzero(many), low[many > 0], many[many > 0]
        sums, at, held = np.cumsum(many), 0, np.empty(0, _PAIR)
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + BLOCK, "right")))
            k = many[at:to]
            x = np.repeat(own[at:to], k)
            y = np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[at:to], k)
            ok = candidates(r[x], r[y], similar)
            held = np.union1d(held, _pairs(r[x[ok]], r[y[ok]]))
            at = to
            if len(held) and (len(held) > BLOCK or at >= len(own)):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(held[c])) for c in ("u", "v")], ["u", "v"])
                held = np.empty(0, _PAIR)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(held[c])) for c in ("u", "v")], ["u", "v"])

    return crossing


def _name(parts: int):
    def name(batches):
        for b in batches:
            r = np.empty(b.num_rows, _NAMED)
            for c in _NAMED.names:
                r[c] = b.column(c).to_numpy(zero_copy_only=False).view(_NAMED[c])
            if len(r):
                yield packed_batch(packed(r, (mixed(r["key"]) % np.uint64(parts)).astype(np.int64), 0))

    return name


def _verified(pairs: DataFrame, docs: DataFrame, n: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs that link, by the sets."""

    def cut(batches):
        for b in batches:
            got = [np.sort(shingles(t, n)[1]).tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(got, pa.binary())], ["doc", "hashes"])

    @F.arrow_udf("boolean")
    def link(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similar) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())

    pairs = written(pairs.distinct(), "copies-pairs")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("doc")).distinct()
    sets = written(docs.select("doc", "text").join(ends, "doc", "left_semi").mapInArrow(cut, "doc long, hashes binary"), "copies-sets")
    both = pairs
    for end in ("u", "v"):
        both = both.join(sets.select(F.col("doc").alias(end), F.col("hashes").alias(f"{end}_hashes")), end)
    found = written(both.filter(link("u_hashes", "v_hashes")).select("u", "v"), "copies-links")
    drop_written(pairs)
    drop_written(sets)
    release(docs.sparkSession)
    return found


def groups(docs: DataFrame, n: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(doc, root) of every document of docs (doc long, distinct; text): the smallest document of
    those that links join it to."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _rows(docs, n, similar)
    units = written(rows.groupBy("words").agg(F.min("doc").alias("unit")), "copies-units")
    ones = rows.join(units.select(F.col("unit").alias("doc")), "doc", "left_semi").select("doc", "size", "print", "prefix")
    held = rows.select(F.sum(F.octet_length("prefix").cast("long")).alias("n")).first()["n"] or 0
    parts = max(shuffle_partitions(spark), held // 8 // PART_ROWS + 1)
    runs = written(ones.mapInArrow(_deal(parts), PACKED).repartition(parts, "part").mapInArrow(_gather(similar), PACKED), "copies-runs")
    release(spark)
    links = _verified(_flat(runs, 1, _PAIR, _PAIRS), docs, n, similar)
    flat = _flat(runs, 0, _KEYED, _RUNS)
    named = flat.join(components(links), F.col("unit") == F.col("node"), "left").select(*_KEYED.names, F.coalesce("root", "unit").alias("root"))
    more = named.mapInArrow(_name(parts), PACKED).repartition(parts, "part").mapInArrow(_crossing(similar), _PAIRS)
    more = _verified(more, docs, n, similar)
    names = components(links.unionByName(more))
    whole = units.join(names, F.col("unit") == F.col("node"), "left").select("words", F.coalesce("root", "unit").alias("root"))
    out = written(rows.select("doc", "words").join(whole, "words").select("doc", "root"), "copies-groups")
    for t in (rows, units, runs, links, more):
        drop_written(t)
    return out

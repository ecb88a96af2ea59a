"""Removal of byte strings that occur earlier in the corpus, by longest-previous-factor arrays.

A byte goes if it lies in a string of `length` bytes that also starts earlier: in a document
with a smaller id, or earlier in its own. For suffixes in sorted order, the longest previous
factor of one is the larger of its common prefixes with the nearest suffixes before and
behind it, in that order, that start earlier in the corpus. A string of `length` bytes has
an earlier copy if and only if that is `length` or more.

The suffix array of a corpus does not fit a machine, so it is made in parts that can be
sorted apart. Every window of `length` bytes has an anchor, the GRAM bytes in it with the
least hash, which equal windows share; windows are dealt by their anchor.

1. Of documents with the same text, by 128 bits, only the first goes on. The others are lost
   whole, if they have `length` bytes.
2. Texts are cut into runs of windows with the same anchor. Anchors are counted, and the
   documents told which of theirs other runs have too. Windows of other anchors have no copy.
3. The runs of shared anchors bring their bytes. In each part all suffixes that begin a window
   are sorted by their bytes, the common prefixes of neighbours are taken byte by byte, and
   the previous factors decide.
4. An anchor with over SPLIT runs is dealt to several parts. What has an earlier copy there
   goes; the windows that stay meet again by their own bytes, and are decided in the same way.
   So a string that comes a million times is in no part more often than there are parts.
5. What goes is merged by document and cut from the text.

Rows travel as packed arrays, and a task holds one part at a time. The number of parts follows
the number of bytes and of windows, so a task's memory does not grow with the corpus.

Defined cases. Null texts are empty; texts shorter than `length` lose nothing. Repeated
rows, equal in doc_id and text, are one document, and have equal results. Rows with the same
doc_id and different texts are documents in the order of their texts' hashes; a null doc_id
comes first. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, numbered, release, shuffle_partitions, small_batches, written
from .packing import PACKED, by_part, mixed, packed, packed_batch, unpacked

LENGTH, GRAM = 100, 32
#: Bytes of text, and windows, that make up a part; windows that are sorted at once, and kept to be
#: sent on; runs of an anchor in one part; bytes that are cut into runs at once.
PART_BYTES, PART_WINDOWS, SORTED, SPLIT, BLOCK = 8_000_000, 600_000, 150_000, 1_000, 1 << 19
_B = 0x9E3779B97F4A7C15
_COUNT = np.dtype([("anchor", "<u8"), ("part", "<i4"), ("runs", "<i4")])
_SHARED = np.dtype([("anchor", "<u8"), ("salts", "<i4")])
_SPAN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])
_EDGE = np.dtype([("doc", "<i8"), ("start", "<i4"), ("group", "<u4"), ("count", "u1"), ("again", "u1")])
_BYTES = "part long, kind int, packed binary, bytes binary"


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    if len(cache.get("p", ())) < n:
        size = max(n, 1 << 16)
        for k, base in (("p", _B), ("q", pow(_B, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            cache[k] = np.cumprod(x)
    return cache["p"][:n], cache["q"][:n]


def _prefixes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums whose differences, shifted, are hashes of the bytes between; and the shifts."""
    p, q = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=sums[1:])
    return sums, q


def pieces(docs: list[int], texts: list[bytes], length: int = LENGTH, block: int = BLOCK):
    """The texts in lists of about `block` bytes: (doc, offset, bytes). Every window of `length`
    bytes lies in one piece, and in one only."""
    out, size = [], 0
    for doc, text in zip(docs, texts):
        for at in range(0, len(text) - length + 1, block):
            out.append((doc, at, text[at : at + block + length - 1] if len(text) > block else text))
            size += len(out[-1][2])
            if size >= block:
                yield out
                out, size = [], 0
    if out:
        yield out


def runs(cut: list, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of pieces as runs with the same anchor: the bytes of all, and each run's anchor,
    its doc, start and count, and where it stands in the bytes."""
    data = np.frombuffer(b"".join(c[2] for c in cut), np.uint8)
    sizes = np.array([len(c[2]) for c in cut], np.int64)
    firsts = np.cumsum(sizes) - sizes
    sums, q = _prefixes(data)
    h = mixed((sums[gram:] - sums[:-gram]) * q[: len(data) - gram + 1])
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: size - width], low[width - size :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(cut)), sizes)[: len(place)]
    inside = np.flatnonzero(np.arange(len(place)) + length <= (firsts + sizes)[owner])
    place = place[inside]
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    at = inside[new]
    edges, own = np.zeros(len(new), _EDGE), owner[at]
    edges["doc"], edges["count"] = np.array([c[0] for c in cut], np.int64)[own], np.diff(np.append(new, len(place)))
    edges["start"] = at - firsts[own] + np.array([c[1] for c in cut], np.int64)[own]
    return data, h[place[new]], edges, at


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans of each document, sorted, with those that touch or overlap made one."""
    if not len(spans):
        return spans
    s = spans[np.lexsort((spans["start"], spans["doc"]))]
    # ends so far within a document, by lifting each document above the one before
    _, number = np.unique(s["doc"], return_inverse=True)
    lift = number.astype(np.int64) << 32
    end = np.maximum.accumulate(s["end"] + lift)
    new = np.ones(len(s), bool)
    new[1:] = s["start"][1:] + lift[1:] > end[:-1]
    first = np.flatnonzero(new)
    out = s[first].copy()
    last = np.append(first[1:], len(s)) - 1
    out["end"] = end[last] - lift[last]
    return out


def _doc_part(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _previous(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the nearest one before it, in sorted order, that has a
    smaller place. lcp[i]: of i - 1 and i. Every round jumps over what is known to be larger."""
    n = len(place)
    to, least = np.arange(n) - 1, lcp.copy()
    open_ = np.flatnonzero(to >= 0)
    open_ = open_[place[to[open_]] > place[open_]]
    while len(open_):
        over = to[open_]
        least[open_] = np.minimum(least[open_], least[over])
        to[open_] = to[over]
        open_ = open_[to[open_] >= 0]
        open_ = open_[place[to[open_]] > place[open_]]
    least[to < 0] = 0
    return least


def longest_previous_factors(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For suffixes in sorted order with distinct places in the corpus: the longest prefix that
    each shares with one that starts at a smaller place. lcp[0] is not used."""
    lcp = np.asarray(lcp).copy()
    if len(lcp):
        lcp[0] = 0
    after = _previous(place[::-1], np.append(lcp[1:], 0)[::-1])[::-1]
    return np.maximum(_previous(place, lcp), after)


def suffix_order(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of data that start at `at`, in the order of their first `length` bytes, and the
    common prefix of each, up to `length`, with the one before it."""
    rows = np.lib.stride_tricks.sliding_window_view(data, length)[at]
    order = np.argsort(rows.view(f"V{length}").ravel(), kind="stable")
    lcp = np.zeros(len(at), np.int16)
    for i in range(1, len(at), 1 << 14):
        a, b = rows[order[i - 1 : i - 1 + (1 << 14)]][: len(at) - i], rows[order[i : i + (1 << 14)]]
        differ = a != b
        to = differ.argmax(1)
        lcp[i : i + len(b)] = np.where(differ[np.arange(len(b)), to], to, length)
    return order, lcp


def repeated(edges: np.ndarray, data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """edges: runs of windows; data: their bytes, one run after the other. Gives of each window
    the run it is of, where it stands in data, and whether one before it in the corpus has
    the same bytes."""
    count = edges["count"].astype(np.int64)
    first = np.cumsum(count + length - 1) - (count + length - 1)
    owner = np.repeat(np.arange(len(edges), dtype=np.int32), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = first[owner] + within
    place = np.empty(len(at), np.int32)
    place[np.lexsort((edges["start"][owner] + within, edges["doc"][owner]))] = np.arange(len(at), dtype=np.int32)
    gone = np.zeros(len(at), bool)
    if len(at):
        order, lcp = suffix_order(data, at, length)
        gone[order] = longest_previous_factors(place[order], lcp) >= length
    return owner, at, gone


def _spans(edges: np.ndarray, owner: np.ndarray, gone: np.ndarray, length: int) -> np.ndarray:
    """The bytes of the windows that go, as merged spans."""
    count = edges["count"].astype(np.int64)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = np.flatnonzero(gone)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])
    first, last = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else at
    out = np.empty(len(first), _SPAN)
    start = edges["start"][owner[first]].astype(np.int64)
    out["doc"], out["start"], out["end"] = edges["doc"][owner[first]], start + within[first], start + within[last] + length
    return merged(out)


def _counted(length: int, gram: int, parts: int):
    """How many runs of each anchor a part of the texts has, for those that are no copies."""

    def run(batches):
        for part, rows in by_part(batches):
            copies, found = set(), []
            for kind, b in rows:
                if kind == 0:
                    copies.update(b.column("doc").to_pylist())
                    continue
                keep = [(d, t) for d, t in zip(b.column("doc").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()) if d not in copies]
                for cut in pieces([d for d, _ in keep], [t for _, t in keep], length):
                    found.append(np.unique(runs(cut, length, gram)[1], return_counts=True))
            if found:
                anchors, counts = (np.concatenate(x) for x in zip(*found))
                keys, back = np.unique(anchors, return_inverse=True)
                r = np.empty(len(keys), _COUNT)
                r["anchor"], r["part"], r["runs"] = keys, part, np.bincount(back, counts).astype(np.int32)
                yield packed_batch(packed(r, (keys % np.uint64(parts)).astype(np.int64), 0))

    return run


def _told(split: int):
    """To the parts of the texts: their anchors that have several runs, and to how many parts of
    windows those are dealt. runs: how many of the part's runs that are."""

    def run(batches):
        r = unpacked(batches, {0: _COUNT})[0]
        keys, back = np.unique(r["anchor"], return_inverse=True)
        total = np.bincount(back, r["runs"], len(keys)).astype(np.int64)[back]
        r, total = r[total > 1], total[total > 1]
        told = np.empty(len(r), _SHARED)
        told["anchor"], told["salts"] = r["anchor"], -(-total // split)
        many = np.bincount(r["part"], r["runs"]).astype(np.int64)
        out = packed(told, r["part"].astype(np.int64), 1)
        if out:
            cells = [pa.array([o[0] for o in out], pa.int64()), pa.array([int(many[o[0]]) for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["part", "runs", "packed"])

    return run


def _bytes_of(edges: np.ndarray, data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The bytes of runs, which start at `at` in data, one after the other."""
    size = edges["count"].astype(np.int64) + length - 1
    ends = np.cumsum(size)
    return data[np.arange(size.sum()) + np.repeat(at - ends + size, size)]


def _joined(edges: np.ndarray, text: np.ndarray, key: np.ndarray, parts: int, length: int, kind: int) -> pa.RecordBatch:
    """Runs, and their bytes, which text has one after the other, packed by part: the lower half of a
    run's key. The upper one is its group there."""
    size = edges["count"].astype(np.int64) + length - 1
    at, dest = np.cumsum(size) - size, (key % np.uint64(parts)).astype(np.int64)
    edges["group"] = key >> np.uint64(32)
    order = np.argsort(dest, kind="stable")
    edges, dest, size = edges[order], dest[order], size[order]
    text = _bytes_of(edges, text, at[order], length)
    cuts = np.append(np.flatnonzero(np.concatenate([[True], dest[1:] != dest[:-1]])), len(dest))
    column = lambda offsets, x: pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(x)])
    cells = [pa.array(dest[cuts[:-1]], pa.int64()), pa.array(np.full(len(cuts) - 1, kind, np.int32)), column(cuts * _EDGE.itemsize, edges.tobytes()), column(np.append(0, np.cumsum(size))[cuts], text)]
    return pa.RecordBatch.from_arrays(cells, ["part", "kind", "packed", "bytes"])


class _Kept:
    """Runs and their bytes, kept until there are enough to be sent on."""

    def __init__(self, most: int):
        self.most, self.rows, self.size = most, [], 0

    def add(self, edges, text, key) -> bool:
        self.rows.append((edges, text, key))
        self.size += len(text)
        return self.size >= self.most

    def take(self):
        out, self.rows, self.size = [np.concatenate(x) for x in zip(*self.rows)], [], 0
        return out


def _brought(length: int, gram: int, parts: int):
    """The runs of shared anchors, and their bytes, dealt by anchor."""

    def found(texts, copies, shared):
        """Of a batch of texts: the runs, their bytes, and the keys by which they are dealt."""
        keep = [(d, t) for d, t in zip(texts.column("doc").to_pylist(), texts.column("text").cast(pa.binary()).to_pylist()) if d not in copies]
        for cut in pieces([d for d, _ in keep], [t for _, t in keep], length) if len(shared) else ():
            data, anchor, edges, at = runs(cut, length, gram)
            to = np.searchsorted(shared["anchor"], anchor).clip(max=len(shared) - 1)
            some = np.flatnonzero(shared["anchor"][to] == anchor)
            if not len(some):
                continue
            edges, anchor, salts = edges[some], anchor[some], shared["salts"][to[some]].astype(np.uint64)
            edges["again"] = salts > 1
            own = mixed(edges["doc"].astype(np.uint64) * np.uint64(_B) + edges["start"].astype(np.uint64)) % salts
            yield edges, _bytes_of(edges, data, at[some], length), mixed(anchor + own * np.uint64(0xC2B2AE3D27D4EB4F))

    def run(batches):
        kept = _Kept(PART_BYTES)
        for _, rows in by_part(batches):
            copies, told, shared = set(), [np.empty(0, _SHARED)], None
            for kind, b in rows:
                if kind == 0:
                    copies.update(b.column("doc").to_pylist())
                elif kind == 1:
                    told += [np.frombuffer(x, _SHARED) for x in b.column("packed").to_pylist()]
                else:
                    shared = np.sort(np.concatenate(told), order="anchor") if shared is None else shared
                    for got in found(b, copies, shared):
                        if kept.add(*got):
                            yield _joined(*kept.take(), parts, length, 0)
        if kept.rows:
            yield _joined(*kept.take(), parts, length, 0)

    return run


def sortable(edges: np.ndarray, data: np.ndarray, length: int = LENGTH, most: int = SORTED):
    """The runs of a part, and their bytes, in lists of whole groups with about `most` windows."""
    size = edges["count"].astype(np.int64) + length - 1
    order = np.argsort(edges["group"], kind="stable")
    at, edges = (np.cumsum(size) - size)[order], edges[order]
    group = edges["group"]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(edges) else np.zeros(0, np.int64)
    windows = np.add.reduceat(edges["count"].astype(np.int64), first) if len(edges) else first
    a, held = 0, 0
    for z, n in zip([*first[1:].tolist(), len(edges)], windows.tolist()):
        held += n
        if held >= most or z == len(edges):
            yield edges[a:z], _bytes_of(edges[a:z], data, at[a:z], length)
            a, held = z, 0


def _decided(length: int, doc_parts: int, parts: int):
    """Kind 1: spans that go. Kind 3: windows that stay here, of anchors that are in several parts."""

    def run(batches):
        for _, rows in by_part(batches):
            got = [(x, y) for _, b in rows for x, y in zip(b.column("packed").to_pylist(), b.column("bytes").to_pylist())]
            edges, data = np.frombuffer(b"".join(x for x, _ in got), _EDGE), np.frombuffer(b"".join(y for _, y in got), np.uint8)
            del got
            spans, kept = [], _Kept(PART_BYTES)
            for some, text in sortable(edges, data, length):
                owner, at, gone = repeated(some, text, length)
                spans.append(_spans(some, owner, gone, length))
                left = np.flatnonzero(~gone & (some["again"][owner] > 0))
                if len(left):
                    count = some["count"].astype(np.int64)
                    own, at = owner[left], at[left]
                    alone = some[own]
                    alone["start"] += (left - (np.cumsum(count) - count)[own]).astype(np.int32)
                    alone["count"], alone["again"] = 1, 0
                    sums, q = _prefixes(text)
                    if kept.add(alone, _bytes_of(alone, text, at, length), mixed((sums[at + length] - sums[at]) * q[at])):
                        yield _joined(*kept.take(), parts, length, 3)
            if kept.rows:
                yield _joined(*kept.take(), parts, length, 3)
            gone = merged(np.concatenate(spans)) if spans else np.empty(0, _SPAN)
            if out := packed(gone, _doc_part(gone["doc"], doc_parts), 1):
                cells = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*cells, pa.nulls(len(out), pa.binary())], ["part", "kind", "packed", "bytes"])

    return run


def _merge_docs(batches):
    s = merged(unpacked(batches, {1: _SPAN})[1])
    if len(s):
        docs, first = np.unique(s["doc"], return_index=True)
        numbers = (s["start"].astype(np.int64) << 32) | s["end"]
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.ListArray.from_arrays(pa.array(np.append(first, len(s)), pa.int32()), pa.array(numbers))], ["doc", "spans"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, split: int = SPLIT) -> DataFrame:
    """(doc, spans): of each document that loses bytes, the merged spans, each as a number
    start * 2^32 + end. docs has __doc, which tells rows apart, and text."""
    if not 1 <= gram < length or length - gram > 254:
        raise ValueError("gram must be below length, by 254 at most")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("__doc").alias("doc"), "text").filter(F.octet_length("text") >= length)
    hashed = written(rows.select("doc", F.octet_length("text").cast("long").alias("size"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b")), "lpf-hashed")
    total = hashed.agg(F.sum("size")).first()[0] or 0
    parts = max(shuffle_partitions(spark), total // PART_BYTES + 1)
    firsts = hashed.groupBy("a", "b").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = written(hashed.join(firsts, ["a", "b"]).filter("doc <> first").select("doc", "size"), "lpf-copies")
    drop_written(hashed)

    def tagged(*more: DataFrame) -> DataFrame:
        """Rows by the part of their document: first which are copies, then more, then texts."""
        part, none = F.pmod(F.xxhash64("doc"), F.lit(parts)).alias("part"), F.lit(None).cast("binary").alias("packed")
        all_ = copies.select(part, F.lit(0).alias("kind"), "doc", F.lit(None).cast("string").alias("text"), none)
        for m in (*more, rows.select(part, F.lit(2).alias("kind"), "doc", "text", none)):
            all_ = all_.unionByName(m)
        return all_.repartition(parts, "part").sortWithinPartitions("part", "kind")

    counts = tagged().mapInArrow(_counted(length, gram, parts), PACKED)
    told = written(counts.repartition(parts, "part").mapInArrow(_told(split), "part long, runs long, packed binary"), "lpf-told")
    release(spark)
    n = (told.agg(F.sum("runs")).first()[0] or 0) * (length - gram + 2) // 2
    edge_parts = max(shuffle_partitions(spark), n // PART_WINDOWS + 1)
    replies = told.select("part", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("doc"), F.lit(None).cast("string").alias("text"), "packed")
    brought = tagged(replies).mapInArrow(_brought(length, gram, edge_parts), _BYTES)
    decided = brought.repartition(edge_parts, "part").sortWithinPartitions("part").mapInArrow(_decided(length, parts, edge_parts), _BYTES)
    found = written(decided, "lpf-found")
    release(spark)
    left = found.filter("kind = 3")
    n = (left.agg(F.sum(F.octet_length("packed").cast("long"))).first()[0] or 0) // _EDGE.itemsize
    last = left.repartition(max(shuffle_partitions(spark), n // PART_WINDOWS + 1), "part").sortWithinPartitions("part").mapInArrow(_decided(length, parts, edge_parts), _BYTES)
    spans = found.unionByName(last).filter("kind = 1").select("part", "kind", "packed")
    merged_ = spans.repartition(parts, "part").mapInArrow(_merge_docs, "doc long, spans array<long>")
    out = written(merged_.unionByName(copies.select("doc", F.array("size").alias("spans"))), "lpf-spans")
    for t in (copies, told, found):
        drop_written(t)
    release(spark)
    return out


def kept_bytes(text: bytes, spans: list[int] | None) -> bytes:
    """The text without its spans."""
    out, at = [], 0
    for x in spans or ():
        out.append(text[at : x >> 32])
        at = x & 0xFFFFFFFF
    return b"".join([*out, text[at:]])


def digest(text: str, spans: str) -> Column:
    """What is left of a text: (n_bytes, n_removed, n_spans, kept_sha256)."""

    @F.arrow_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string>")
    def run(texts: pa.Array, lost: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts.cast(pa.binary()).to_pylist(), lost.to_pylist()):
            kept = kept_bytes(t or b"", s)
            out.append({"n_bytes": len(t or b""), "n_removed": len(t or b"") - len(kept), "n_spans": len(s or ()), "kept_sha256": hashlib.sha256(kept).hexdigest()})
        return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    return run(text, spans)


def with_spans(docs: DataFrame, length: int = LENGTH, **params) -> DataFrame:
    """docs with __spans, what each row's text loses (null: nothing)."""
    rows, again = numbered(docs)
    spans = repeated_spans(rows.dropDuplicates(["__doc"]) if again else rows, length, **params).select(F.col("doc").alias("__d"), F.col("spans").alias("__spans"))
    return rows.join(spans, F.col("__doc") == F.col("__d"), "left").drop("__doc", "__d")


def suffix_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: its bytes, the bytes removed, the runs they form, and the SHA-256
    of what is left."""
    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length)
    return rows.select("doc_id", digest("text", "__spans").alias("x")).select("doc_id", "x.*")

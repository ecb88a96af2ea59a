"""Line de-duplication by a segment-partition edit join.

Two lines are one if they are equal, or if both have LEAST or more characters and their edit
distance is `k` at most; lines linked in this way, over any number of steps, are a class. Of
each class the first line of the corpus stays, by document and place in it.

A line is cut into k + 1 segments. If k edits make it another, one segment is untouched and
stands in the other at a shift that its number and the lines' lengths bound. So every line
puts its segments in an index under their length and number, and probes it with its own
substrings at the shifts allowed, for all lengths from its own down to k less.

First only hashes meet. The lines of keys that have an index and a probe row of different
lines bring their texts, and pairs are verified where they meet: they must agree in a
signature of their characters' parities up to two bits an edit, and then by an edit distance
whose band of 2 k + 1 diagonals is kept in the bits of a word, for many pairs at once. A pair
counts at the first segment at which it meets, so links are counted without being written
down; what a block of lines has joined is handed on as stars. A key of over SIDE lines is cut
into blocks of lines, each pair of which is a task's work.

Equal lines are folded within each batch and then by 128-bit hash before they are joined, so
a line that comes a million times is indexed once a batch. Rows travel as packed arrays. The
texts of lines that are to be verified are brought by a shuffle at every size.

Defined cases. Lines end at a line feed. Lines of white space only stay, and are not counted.
Null texts have no lines. Rows with the same doc_id are one document to the order, by the
hash of their texts. A null doc_id comes first. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, drop_written, numbered, release, shuffle_partitions, small_batches, written
from .components import components
from .packing import PACKED, mixed, packed, packed_batch, unpacked
from .simhash import stars
from .suffix_dedup import _prefixes

#: Edits of a link; least characters of a line that can have one; characters worked on at once.
EDITS, LEAST, BLOCK = 2, 20, 1 << 20
#: Bytes of text that make up a part; characters that are cut into lines at once; cells of the
#: matrices in which pairs are verified at once; lines of a key's block; rows, and pairs, met at once.
PART_BYTES, CUT, CELLS, SIDE, ROWS, PAIRS = 16_000_000, 1 << 22, 1 << 20, 2048, 8192, 1 << 18
_LINE = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("line", "<i4")])
#: A key, and 96 bits of a line's hash.
_KEY = np.dtype([("key", "<u8"), ("a", "<u8"), ("b", "<u4")])
_MET = np.dtype([("key", "<u8"), ("a", "<u8"), ("b", "<u4"), ("probes", "<i4"), ("block", "<i4"), ("other", "<i4")])


def segment(length: np.ndarray, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i (from 0) of lines of these lengths: the last ones are longer."""
    base, more = length // (k + 1), length % (k + 1)
    short = k + 1 - more
    return i * base + np.maximum(0, i - short), base + (i >= short)


def shifts(i: int, delta: int, k: int) -> range:
    """How far from its place in a line that is delta shorter segment i can stand."""
    return range(max(-i, delta - (k - i)), min(i, delta + (k - i)) + 1)


def signatures(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each line, a bit for each of 64 classes of characters: whether their number is odd.
    An edit changes two bits at most."""
    kind = ((codes.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(26)).astype(np.int64)
    odd = np.bincount(owner * 64 + kind, minlength=n * 64) & 1
    return np.packbits(odd.reshape(n, 64).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()


def line_keys(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of lines of more than k characters: a row's k + 1 index keys, and its probe keys, in
    the order of probes()."""
    length = np.array([len(x) for x in lines], np.int64)
    ends = np.cumsum(length)
    index, probe = np.empty((len(lines), k + 1), np.uint64), np.empty((len(lines), len(probes(k))), np.uint64)
    cuts = np.searchsorted(ends, np.arange(BLOCK, (ends[-1] if len(ends) else 0) + BLOCK, BLOCK), "right")
    for a, b in zip([0, *cuts], [*cuts, len(lines)]):
        if a >= b:
            continue
        size = length[a:b]
        codes = np.frombuffer("".join(lines[a:b]).encode("utf-32-le", "surrogatepass"), "<u4")
        first = np.cumsum(size) - size
        p, q = _prefixes(codes)

        def hashed(start, n, tag):
            return mixed((p[start + n] - p[start]) * q[start] + tag)

        for i in range(k + 1):
            start, n = segment(size, i, k)
            index[a:b, i] = hashed(first + start, n, (size * (k + 1) + i).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        for column, (delta, i, shift) in enumerate(probes(k)):
            start, n = segment(size - delta, i, k)
            tag = ((size - delta) * (k + 1) + i).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            probe[a:b, column] = hashed(first + start + shift, n, tag)
    return index, probe


def probes(k: int) -> list[tuple[int, int, int]]:
    """Of each probe key how much shorter the other line is, the segment, and the shift."""
    return [(delta, i, shift) for delta in range(k + 1) for i in range(k + 1) for shift in shifts(i, delta, k)]


def met(index: np.ndarray, probe: np.ndarray, side: int = SIDE) -> np.ndarray:
    """The rows of keys that an index row and a probe row of different lines have, in blocks of
    `side` lines: each block of the index beside each of the probes. An index row is a probe of
    its own key, too, which is not sent again."""
    rows = np.zeros(len(index) + len(probe), _MET)
    for c in _KEY.names:
        rows[c] = np.concatenate([index[c], probe[c]])
    rows["probes"][len(index) :] = 1
    if not len(rows):
        return rows
    rows = rows[np.argsort(rows["key"], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
    several = np.zeros(len(first), bool)  # most keys are of one line, which meets itself
    for c in ("a", "b"):
        several |= np.minimum.reduceat(rows[c], first) != np.maximum.reduceat(rows[c], first)
    rows = rows[np.repeat(several, np.diff(np.append(first, len(rows))))]
    also = rows[rows["probes"] == 0]
    also["probes"] = 1
    rows = np.unique(np.concatenate([rows, also]))
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows["b"], rows["a"], rows["probes"], rows["key"]))]
    first = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
    size = np.diff(np.append(first, len(rows)))
    asks = np.add.reduceat(rows["probes"], first)
    use = (asks > 0) & (asks < size)
    n_probe, n_index = np.repeat(asks, size), np.repeat(size - asks, size)
    place = np.arange(len(rows)) - np.repeat(first, size)
    rows["block"] = np.where(rows["probes"] == 1, place - n_index, place) // side
    others = -(-np.where(rows["probes"] == 1, n_index, n_probe) // side)
    keep = np.repeat(use, size)
    rows, others = rows[keep], others[keep]
    out = np.repeat(rows, others)
    out["other"] = np.arange(len(out)) - np.repeat(np.cumsum(others) - others, others)
    asking = out["probes"] == 1  # block: of the index; other: of the probes
    out["block"][asking], out["other"][asking] = out["other"][asking].copy(), out["block"][asking].copy()
    return out


def links(group: np.ndarray, key: np.ndarray, asks: np.ndarray, ids: np.ndarray, lines: list[str], k: int):
    """Yields the links (ids u, ids v) between lines of rows that met in a group, by its key and at no
    earlier segment. asks: which rows are probes; ids: of the lines."""
    one, first, at = np.unique(ids, return_index=True, return_inverse=True)
    texts = [lines[i] for i in first]
    size = np.array([len(x) for x in texts])
    index, probe = line_keys(texts, k)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sig = signatures(codes, np.repeat(np.arange(len(texts)), size), len(texts))
    order = np.argsort(group, kind="stable")
    group, key, asks, at = group[order], key[order], asks[order], at[order]
    own = np.flatnonzero(asks)
    have = np.flatnonzero(~asks)
    low = np.searchsorted(group[have], group[own], "left")
    many = np.searchsorted(group[have], group[own], "right") - low
    columns_, sums, done = probes(k), np.cumsum(many), 0
    while done < len(own):
        to = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + PAIRS, "right")))
        n = many[done:to]
        p = np.repeat(own[done:to], n)
        o = have[np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[done:to], n)]
        x, y = at[p], at[o]
        delta = size[x] - size[y]
        ok = (x != y) & (delta >= 0) & (delta <= k) & ((delta > 0) | (one[x] < one[y])) & (np.bitwise_count(sig[x] ^ sig[y]) <= 2 * k)
        x, y, delta, here = x[ok], y[ok], delta[ok], key[p[ok]]
        # the first segment at which these lines meet must be this one
        earliest = np.full(len(x), k + 1)
        for column, (d, i, _) in reversed(list(enumerate(columns_))):
            same = (delta == d) & (probe[x, column] == index[y, i])
            earliest[same] = np.minimum(earliest[same], i)
        ok = (earliest <= k) & (index[y, np.minimum(earliest, k)] == here)
        x, y = x[ok], y[ok]
        by_size = np.argsort(-size[x], kind="stable")
        x, y, i = x[by_size], y[by_size], 0
        while i < len(x):
            z = i + max(1, CELLS // (int(size[x[i]]) + k + 1))
            near = within([texts[j] for j in x[i:z]], [texts[j] for j in y[i:z]], k)
            yield one[x[i:z][near]], one[y[i:z][near]]
            i = z
        done = to


def within(a: list[str], b: list[str], k: int) -> np.ndarray:
    """Whether the edit distance of each pair is k at most. A column of the band is a word;
    bit t stands for the diagonal t - k. All pairs advance by a column at a time."""
    out = np.zeros(len(a), bool)
    todo = [i for i in range(len(a)) if abs(len(a[i]) - len(b[i])) <= k]
    if not todo:
        return out
    # the pattern is the longer line, so the band holds its end
    long = [a[i] if len(a[i]) >= len(b[i]) else b[i] for i in todo]
    short = [b[i] if len(a[i]) >= len(b[i]) else a[i] for i in todo]
    m, n = np.array([len(x) for x in long]), np.array([len(x) for x in short])
    width = int(m.max()) + 2 * k + 2
    s, t = np.full((len(todo), width + k), -1, np.int32), np.full((len(todo), int(n.max()) + 1), -2, np.int32)
    for r, (x, y) in enumerate(zip(long, short)):
        s[r, k : k + len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<i4")
        t[r, : len(y)] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), "<i4")
    one = np.uint64(1)
    full = np.uint64((1 << (2 * k + 1)) - 1)
    top = np.uint64(1 << (2 * k))
    # before the first column, cell (i, 0) is i: upper steps rise by one, and stay flat above row 0
    vp = np.full(len(todo), ((1 << (k + 1)) - 1) << k, np.uint64) & full
    vn = np.zeros(len(todo), np.uint64)
    score = np.full(len(todo), k, np.int64)
    for j in range(int(n.max())):
        live = j < n
        eq = np.zeros(len(todo), np.uint64)
        for d in range(2 * k + 1):
            eq |= (s[:, j + d] == t[:, j]).astype(np.uint64) << np.uint64(d)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        # the lowest diagonal rises unless its cell takes the value before it
        score += np.where(live, (d0 & top) == 0, 0)
        down = d0 >> one
        nvp, nvn = (hn | ~(down | hp)) & full, down & hp
        vp, vn = np.where(live, nvp, vp), np.where(live, nvn, vn)
    # the score stands k rows below the main diagonal, at row n + k; go up to row m
    for step in range(2 * k):
        go = n + k - step > m
        bit = np.uint64(2 * k - 1 - step)
        score -= np.where(go, ((vp >> bit) & one).astype(np.int64) - ((vn >> bit) & one).astype(np.int64), 0)
    out[todo] = score <= k
    return out


def _folded(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines by hash and place; which have an equal one before; and where each stood."""
    order = np.lexsort((r["line"], r["doc"], r["b"], r["a"]))
    r = r[order]
    same = np.zeros(len(r), bool)
    same[1:] = (r["a"][1:] == r["a"][:-1]) & (r["b"][1:] == r["b"][:-1])
    return r, same, order


def _cut_lines(k: int, least: int, parts: int):
    """Kind 0: lines, one of equal ones; 1: lines that go; 2 and 3: index and probe rows."""

    def cut(docs: list, texts: list):
        rows, lines = [], []
        for doc, text in zip(docs, texts):
            for i, line in enumerate(text.split("\n") if text else ()):
                if line and not line.isspace():
                    h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
                    rows.append((h >> 64, h & 0xFFFFFFFFFFFFFFFF, doc, i))
                    lines.append(line)
        r = np.array(rows, _LINE)
        r, same, order = _folded(r)
        some = [i for i, again in zip(order, same) if not again and len(lines[i]) >= least]
        out = packed(r[~same], (r["a"][~same] % np.uint64(parts)).astype(np.int64), 0) + packed(r[same], (mixed(r["doc"][same].astype(np.uint64)) % np.uint64(parts)).astype(np.int64), 1)
        own = r[~same & (np.array([len(lines[i]) for i in order], np.int64) >= least)]
        index, probe = line_keys([lines[i] for i in some], k)
        for kind, x in ((2, index), (3, probe[:, [delta > 0 or shift != 0 for delta, _, shift in probes(k)]])):
            rows_ = np.empty(x.size, _KEY)
            rows_["key"], rows_["a"] = x.ravel(), np.repeat(own["a"], x.shape[1])
            rows_["b"] = np.repeat(own["b"] & np.uint64(0xFFFFFFFF), x.shape[1])
            out += packed(rows_, (rows_["key"] % np.uint64(parts)).astype(np.int64), kind)
        return out

    def run(batches):
        for batch in batches:
            size = np.cumsum(batch.column("bytes").to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CUT, "right")))
                part = batch.slice(at, to - at)
                out = cut(part.column("doc").to_pylist(), part.column("text").to_pylist())
                if out:
                    yield packed_batch(out)
                at = to

    return run


def _join_part(batches):
    """Kind 0: first lines; 1: lines with an equal one before; 4: rows of keys to look at."""
    got = unpacked(batches, {0: _LINE, 1: _LINE, 2: _KEY, 3: _KEY})
    r, same, _ = _folded(got[0])
    out = [(0, kind, x.tobytes()) for kind, x in ((0, r[~same]), (1, np.concatenate([got[1], r[same]])), (4, met(got[2], got[3]))) if len(x)]
    if out:
        yield packed_batch(out)


def _rows(marks: DataFrame, kind: int, dtype: np.dtype, fields: dict[str, str]) -> DataFrame:
    def run(batches):
        for b in batches:
            for x in b.column("packed").to_pylist():
                r = np.frombuffer(x, dtype)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r[f]).view(np.int64) if r[f].dtype.itemsize == 8 else r[f].astype(np.int64 if r[f].dtype == np.uint32 else np.int32)) for f in fields], list(fields))

    return marks.filter(F.col("kind") == kind).mapInArrow(run, ", ".join(f"{f} {t}" for f, t in fields.items()))


def _some_lines(batches):
    """(a, b, doc, line, text) of the lines that are asked for, of documents brought with their numbers."""
    for batch in batches:
        rows = []
        for doc, text, want in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "want"))):
            cut = text.split("\n")
            rows += [(w["a"], w["b"], doc, w["line"], cut[w["line"]]) for w in want]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], ["a", "b", "doc", "line", "text"])


def _linked(k: int):
    """(u, v, n) of rows that met, sorted by key and block: stars of what links join, with n null, and
    how many links a line (u) has, with v null."""

    def groups(batches):
        """Rows of whole groups, some thousands at a time."""
        held, count, last = [], 0, None
        for b in batches:
            name = np.rec.fromarrays([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "other")])
            new = np.flatnonzero(name[1:] != name[:-1]) + 1
            for a, z in zip([0, *new.tolist()], [*new.tolist(), b.num_rows]):
                if z <= a:
                    continue
                if count >= ROWS and name[a] != last:
                    yield pa.Table.from_batches(held)
                    held, count = [], 0
                last = name[a]
                held.append(b.slice(a, z - a))
                count += z - a
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        for t in groups(batches):
            key, probes_, ids = (t.column(c).to_numpy() for c in ("key", "probes", "id"))
            name = np.rec.fromarrays([t.column(c).to_numpy() for c in ("key", "block", "other")])
            group = np.cumsum(np.concatenate([[0], name[1:] != name[:-1]]))
            u, v, n, seen = (np.empty(0, np.int64) for _ in range(4))
            for x, y in links(group, key.view(np.uint64), probes_ == 1, ids, t.column("text").to_pylist(), k):
                seen, back = np.unique(np.concatenate([seen, x, y]), return_inverse=True)
                n = np.bincount(back, np.concatenate([n, np.ones(2 * len(x), np.int64)])).astype(np.int64)
                u, v = stars(np.concatenate([u, x]), np.concatenate([v, y]))
            if len(seen):
                nulls = lambda m: pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), nulls(len(u))], ["u", "v", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(seen), nulls(len(seen)), pa.array(n)], ["u", "v", "n"])

    return run


def line_classes(docs: DataFrame, k: int = EDITS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """docs has __doc, which tells rows apart, and text. Gives the lines that go (doc, line), each with
    the first of its class (first_doc, first_line); and the links (doc, n_links) that the lines
    of documents have to different lines."""
    if not 1 <= k <= 15 or least < k + 1:
        raise ValueError("k must be from 1 to 15, and least above it")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("__doc").alias("doc"), "text").filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), total // PART_BYTES + 1)
    sized = rows.withColumn("bytes", F.octet_length("text").cast("long"))
    cut = sized.mapInArrow(_cut_lines(k, least, parts), PACKED)
    marks = written(cut.repartition(parts, "part").mapInArrow(_join_part, PACKED), "lines-marks")
    release(spark)
    shape = {"a": "long", "b": "long", "doc": "long", "line": "int"}
    firsts, again = _rows(marks, 0, _LINE, shape), _rows(marks, 1, _LINE, shape)
    looked = _rows(marks, 4, _MET, {"key": "long", "a": "long", "b": "long", "probes": "int", "block": "int", "other": "int"})
    looked = looked.withColumnRenamed("b", "b4")
    low = F.col("b").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b4")
    asked = firsts.select("*", low).join(looked.select("a", "b4").distinct(), ["a", "b4"])
    want = written(asked.groupBy("doc").agg(F.collect_list(F.struct("a", "b", "line")).alias("want")), "lines-want")
    brought = rows.join(want.hint("merge"), "doc").select("doc", "text", "want").mapInArrow(_some_lines, "a long, b long, doc long, line int, text string")
    texts = written(brought.withColumn("id", F.monotonically_increasing_id()), "lines-texts")
    beside = looked.join(texts.select("a", low, "id", "text"), ["a", "b4"]).select("key", "block", "other", "probes", "id", "text")
    dealt = beside.repartition("key", "block", "other").sortWithinPartitions("key", "block", "other")
    found = written(dealt.mapInArrow(_linked(k), "u long, v long, n long"), "lines-links")
    roots = components(found.filter("v is not null").select("u", "v"))
    nodes = written(texts.join(roots, F.col("id") == F.col("node")).select("a", "b", "doc", "line", "root"), "lines-nodes")
    least_of = nodes.groupBy("root").agg(F.min(F.struct("doc", "line")).alias("m"))
    named = nodes.join(least_of, "root").select("a", "b", "doc", "line", F.col("m.doc").alias("first_doc"), F.col("m.line").alias("first_line"))
    later = named.filter((F.col("doc") != F.col("first_doc")) | (F.col("line") != F.col("first_line"))).select("doc", "line", "first_doc", "first_line")
    whole = again.join(firsts.select("a", "b", F.col("doc").alias("d"), F.col("line").alias("l")), ["a", "b"])
    whole = whole.join(named.select("a", "b", "first_doc", "first_line"), ["a", "b"], "left")
    gone = whole.select("doc", "line", F.coalesce("first_doc", "d").alias("first_doc"), F.coalesce("first_line", "l").alias("first_line"))
    counts = found.filter("n is not null").groupBy("u").agg(F.sum("n").alias("n"))
    counts = texts.join(counts, F.col("id") == F.col("u")).select("a", "b", "n")
    n_links = firsts.unionByName(again).join(counts, ["a", "b"]).groupBy("doc").agg(F.sum("n").alias("n_links"))
    drop_written(want)
    return gone.unionByName(later), n_links


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document: its lines; how many go, which (from 0), and the documents and lines that
    are the first of their classes; and the links that its lines have to different lines."""
    rows, again = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    gone, n_links = line_classes(rows.dropDuplicates(["__doc"]) if again else rows)
    if again:
        ids = rows.select(F.col("__doc").alias("first_doc"), F.col("doc_id").alias("first_id")).distinct()
        gone = gone.join(ids, "first_doc")
    else:
        gone = gone.withColumn("first_id", F.col("first_doc"))
    lost = gone.groupBy(F.col("doc").alias("__d")).agg(F.array_sort(F.collect_list(F.struct("line", "first_id", "first_line"))).alias("gone"))
    linked = n_links.select(F.col("doc").alias("__e"), "n_links")
    count = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S")))
    out = rows.select("doc_id", "__doc", F.coalesce(F.when(F.col("text").isNotNull(), count), F.lit(0)).alias("n_lines"))
    out = out.join(lost, F.col("__doc") == F.col("__d"), "left").join(linked, F.col("__doc") == F.col("__e"), "left")
    removed = lambda field, kind: F.coalesce(F.col(f"gone.{field}"), F.array().cast(f"array<{kind}>"))
    return out.select(
        "doc_id", "n_lines", F.size(removed("line", "int")).alias("n_removed"), removed("line", "int").alias("removed_lines"),
        removed("first_id", "long").alias("class_docs"), removed("first_line", "int").alias("class_lines"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def without_repeated_lines(docs: DataFrame, k: int = EDITS, least: int = LEAST) -> DataFrame:
    """docs with the lines that go cut out of text."""
    rows, again = numbered(docs)
    gone, _ = line_classes(rows.dropDuplicates(["__doc"]) if again else rows, k, least)
    lost = gone.groupBy(F.col("doc").alias("__d")).agg(F.collect_list("line").alias("__gone"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.join(lost, F.col("__doc") == F.col("__d"), "left").withColumn("text", text).select(*columns(docs))

"""Benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

Word n-grams of the benchmark items are the seeds. One pass over the corpus joins every text
to the items by the seeds that it holds, and aligns the words around each seed with the
item. A passage whose alignment reaches `least` of the item's best possible score is a copy,
edited or not.

No seed is dropped for being common: a seed may be common just because its item leaked, in
one wording, into much of the corpus. What keeps common seeds cheap are bounds that no copy
fails. The words that an item shares with the whole text, and then those that it shares with
the passage, bound the score from above; only what cannot reach `least` is passed over.

The benchmark is read in blocks of about BLOCK words. One block is one index, which is sent to
the executors and searched in all texts; of several, what one has found is written before
the next one is made. So a benchmark of any size takes more passes, and driver and workers
hold one index at a time. Texts are not shuffled unless there are several blocks and texts
must be dropped.

A copy has a seed unless at least every third word is edited, which leaves a score of 0.5 at
most; of such, only those with three words on end unedited are found.

Defined cases. Words are runs of letters, digits and underscores in lower case. Items with
fewer words than a seed are found in texts that have the same words and no others. Items that
are null or have no word match nothing, nor do null and empty texts. An item or document that
comes twice is reported twice. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, numbered, small_batches, written

#: Words of a seed; least share of the best score.
SEED, LEAST = 3, 0.5
#: Alignment scores, words beside a seed's diagonal that an alignment may use, words of a block.
MATCH, MISMATCH, GAP, SLACK, BLOCK = 2, -1, -1, 8, 200_000
_WORD = re.compile(r"\w+")
HIT = "array<struct<item_id:long,score:double,start:int,end:int>>"


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: the best local score, and where it starts and ends in b.
    The row is one vector: gaps along it are a running maximum."""
    n = len(b)
    cost = -GAP * np.arange(n + 1)
    score, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for x in a:
        step = score[:-1] + np.where(b == x, MATCH, MISMATCH)
        new, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
        for value, came in ((step, start[:-1]), (score[1:] + GAP, start[1:])):
            better = value > new[1:]
            new[1:][better], origin[1:][better] = value[better], came[better]
        run = new + cost
        top = np.maximum.accumulate(run)
        since = np.maximum.accumulate(np.where(run == top, np.arange(n + 1), 0))
        along = top - cost > new
        new[along], origin[along] = (top - cost)[along], origin[since[along]]
        score, start = new, origin
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(start[at]), at)
    return best


class Index:
    """Seeds of a block of items, and the alignment of texts with them."""

    def __init__(self, items: list[tuple[int, str]], n: int = SEED):
        self.n, vocabulary = n, {}
        self.items = []
        codes, owners, places = [], [], []
        self.short: dict[tuple, list] = {}
        for item, text in items:
            w = words(text)
            ids = np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], np.int64)
            self.items.append((item, ids))
            if 0 < len(w) < n:
                self.short.setdefault(tuple(w), []).append(item)
        self.vocabulary, self.base = vocabulary, len(vocabulary) + 1
        if self.base**n >= 2**63:
            raise ValueError("the block has too many words for seeds of this length")
        for number, (_, ids) in enumerate(self.items):
            c = self.grams(ids)
            codes.append(c)
            owners.append(np.full(len(c), number))
            places.append(np.arange(len(c)))
        codes, owners, places = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (codes, owners, places))
        order = np.argsort(codes, kind="stable")
        self.codes, self.owners, self.places = codes[order], owners[order], places[order]
        self.distinct, self.first = np.unique(self.codes, return_index=True)
        self.last = np.append(self.first[1:], len(self.codes))

    def grams(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) < self.n:
            return np.zeros(0, np.int64)
        out = np.zeros(len(ids) - self.n + 1, np.int64)
        for i in range(self.n):
            part = ids[i : len(ids) - self.n + 1 + i]
            out = np.where((part < 0) | (out < 0), -1, out * self.base + part)
        return out

    def found(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text's words as numbers, the places of its grams that are seeds, and which."""
        w = words(text)
        ids = np.fromiter(map(self.vocabulary.get, w, repeat(-1)), np.int64, len(w))
        c = self.grams(ids)
        if not len(c) or not len(self.distinct):
            return ids, np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(c >= 0)
        to = np.searchsorted(self.distinct, c[at]).clip(max=len(self.distinct) - 1)
        hit = self.distinct[to] == c[at]
        return ids, at[hit], to[hit]

    def hits(self, text: str | None, least: float = LEAST) -> list[dict]:
        """The items of which the text has a copy: score, and the words from start to end."""
        ids, at, to = self.found(text)
        whole = self.short.get(tuple(words(text)), ()) if 0 < len(ids) < self.n else ()
        out = [{"item_id": item, "score": 1.0, "start": 0, "end": len(ids)} for item in whole]
        if not len(at):
            return out
        many = self.last[to] - self.first[to]
        entry = np.arange(many.sum()) + np.repeat(self.first[to] - np.cumsum(many) + many, many)
        owners, diagonals = self.owners[entry], np.repeat(at, many) - self.places[entry]
        order = np.lexsort((diagonals, owners))
        owners, diagonals = owners[order], diagonals[order]
        numbers, firsts = np.unique(owners, return_index=True)
        present = np.zeros(self.base, bool)
        present[ids] = True  # -1 is the last one, which no item has
        for number, first, last in zip(numbers.tolist(), firsts, np.append(firsts[1:], len(owners))):
            item, own = self.items[number]
            if present[own].sum() < least * len(own):
                continue
            best, spans = (0, 0, 0), []
            for d in np.unique(diagonals[first:last]).tolist():
                a, b = max(0, d - SLACK), min(len(ids), d + len(own) + SLACK)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            for a, b in spans:
                part = ids[a:b]
                if min(np.isin(part, own).sum(), np.isin(own, part).sum()) < least * len(own):
                    continue
                score, start, end = align(own, part)
                if score > best[0]:
                    best = (score, a + start, a + end)
            if best[0] >= least * MATCH * len(own):
                out.append({"item_id": item, "score": best[0] / (MATCH * len(own)), "start": best[1], "end": best[2]})
        return out


def _blocks(items: DataFrame, size: int):
    """The items with a seed at least, in order, in lists of about `size` words."""
    block, count = [], 0
    ordered = items.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    for item, text in ordered.toLocalIterator():
        block.append((item, text))
        count += len(words(text))
        if count >= size:
            yield block
            block, count = [], 0
    if block:
        yield block


def _searched(index: Index, least: float):
    """The UDF that gives the items of this index that a text holds."""

    @F.arrow_udf(HIT)
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([index.hits(t, least) for t in texts.to_pylist()], kind)

    return run


def hits(docs: DataFrame, benchmark: DataFrame, key: list[str], least: float = LEAST, n: int = SEED, block: int = BLOCK) -> tuple[DataFrame, bool]:
    """(key, hits): the rows of docs that hold items, and these; a row for each block of the benchmark
    that has some. And whether there were several blocks, whose rows are written by now."""
    small_batches(docs.sparkSession)
    search = lambda items: docs.select(*key, _searched(Index(items, n), least)("text").alias("hits")).filter(F.size("hits") > 0)
    blocks = _blocks(benchmark, block)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return search(first), False
    out = written(search(first), "decontam-hits")
    while second is not None:
        out, second = out.unionByName(written(search(second), "decontam-hits")), next(blocks, None)
    return out, True


def contamination_report(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, **params) -> DataFrame:
    """A row for each document and benchmark item that it holds a copy of: the score, from 0
    to 1, and the words of the copy."""
    found, _ = hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, ["doc_id"], least, **params)
    rows = found.select("doc_id", F.explode("hits").alias("h"))
    return rows.select("doc_id", F.col("h.item_id").alias("item_id"), F.col("h.score").alias("score"), F.col("h.start").alias("start_word"), F.col("h.end").alias("end_word"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, n: int = SEED, block: int = BLOCK) -> DataFrame:
    """The rows of docs that hold no copy of a benchmark item."""
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, block)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return docs.withColumn("__hits", _searched(Index(first, n), least)("text")).filter(F.size("__hits") == 0).select(*columns(docs))
    rows, _ = numbered(docs)
    found, _ = hits(rows, benchmark, ["__doc"], least, n, block)
    return rows.join(found.select("__doc").distinct(), "__doc", "left_anti").select(*columns(docs))

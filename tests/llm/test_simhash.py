"""SimHash links and components against all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from claimloom.llm import simhash
from claimloom.llm.components import components


def slow_print(text, n=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(prints, ids, k=4):
    up = list(range(len(prints)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= k:
                up[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [least.get(top(i)) for i in range(len(prints))]


def test_hash_is_sparks(spark):
    df = spark.createDataFrame([("Één TWO\tthree  four five",), ("a b",), ("",), (None,)], "t string")
    for r in df.select("t", simhash.simhash("t").alias("h")).collect():
        assert r["h"] % 2**64 == slow_print(r["t"])
    assert spark.sql("select xxhash64('één two')").first()[0] % 2**64 == xxhash.xxh64_intdigest("één two".encode(), 42)


@pytest.mark.parametrize("k", [2, 3, 4, 6])
def test_links_against_all_pairs(spark, k):
    r = random.Random(k)
    prints = set()
    for _ in range(25):
        x = r.getrandbits(64)
        for _ in range(8):
            y = x
            for b in r.sample(range(64), r.randint(0, k + 2)):
                y ^= 1 << b
            prints.add(y)
    signed = [p - 2**64 if p >> 63 else p for p in sorted(prints)]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= k}
    got = simhash.near_links(df, k).collect()
    assert len(got) == len(want) and {frozenset((r["u"], r["v"])) for r in got} == want
    full = {r["node"]: r["root"] for r in components(simhash.near_links(df, k)).collect()}
    stars = simhash.near_links(df, k, True)
    assert {r["node"]: r["root"] for r in components(stars).collect()} == full


def test_a_close_group_gives_few_rows(spark):
    import itertools

    prints = {sum(1 << b for b in bits) for n in range(4) for bits in itertools.combinations(range(0, 48, 3), n)}
    df = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(2)
    stars = simhash.near_links(df, 4, True)
    assert stars.count() < 16 * len(prints) < len(prints) ** 2 / 8
    assert components(stars).select("root").distinct().count() == 1 and components(stars).count() == len(prints)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (201, 200), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_report(docs, rows):
    prints = [slow_print(r[1]) for r in rows]
    want = sorted((str(r[0]), f"{p:016x}", str(c)) for r, p, c in zip(rows, prints, slow_components(prints, [r[0] for r in rows])))
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicate_report(docs).collect())
    assert got == want


def test_empty_and_clashing_tables(clashing, rows, no_docs):
    assert simhash.near_duplicate_report(clashing).count() == len(rows)
    assert simhash.near_duplicate_report(no_docs).count() == 0


def test_many_copies(spark):
    df = spark.createDataFrame([(i, "one two three four five six" if i % 3 else f"alone {i} a b c d {i}") for i in range(300)], "doc_id long, text string")
    got = simhash.near_duplicate_report(df).filter(F.col("doc_id") % 3 != 0)
    assert got.select("component_id").distinct().count() == 1

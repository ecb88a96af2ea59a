"""Near copies by shingles against all pairs."""

import random
from fractions import Fraction

import numpy as np

import corpus_pipeline as cp
from claimloom.llm import near_copies, simhash
from claimloom.llm.fingerprints import sketch, within_ring
from claimloom.llm.packing import mixed


def slow_set(text, n=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} or {" ".join(words)}


def slow_groups(texts):
    sets, up = [slow_set(t) for t in texts], list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= Fraction(4, 5):
                up[top(i)] = top(j)
    return [top(i) for i in range(len(texts))]


def edited():
    """Texts, and copies with a few words changed, on both sides of the limit, some in chains."""
    r = random.Random(3)
    words = [a + b for a in "ba ce di fo gu ha je".split() for b in "n r s t l".split()]
    texts = []
    for _ in range(25):
        t = [r.choice(words) for _ in range(r.randint(3, 160))]
        for _ in range(r.randint(1, 8)):
            texts.append(" ".join(t))
            if r.random() < 0.3:
                t = t + [r.choice(words) for _ in range(r.randint(1, 9))]
            else:
                t = list(t)
                for _ in range(r.randint(1, 3)):
                    t[r.randrange(len(t))] = r.choice(words)
    hot = [r.choice(words) for _ in range(120)]
    texts += [" ".join(hot[:at] + [f"x{at}"] + hot[at:]) for at in range(60)]
    return texts


def test_no_pair_within_the_radius_leaves_the_ring():
    r = np.random.default_rng(1)
    for radius in (4, 17, 42):
        x = np.zeros((4000, 2), np.uint64)
        for i in range(len(x)):
            for b in r.choice(128, r.integers(0, 2 * radius + 2), replace=False):
                x[i, b // 64] |= np.uint64(1 << int(b % 64))
        for bits in (8, 16):
            assert (within_ring(x, radius, bits) == (np.bitwise_count(x).sum(1) <= radius)).all()


def test_texts_at_the_limit_are_within_the_radius():
    r = np.random.default_rng(2)
    worst = 0
    for _ in range(3000):
        n = int(r.integers(near_copies.FEW, 400))
        h = r.integers(0, 2**63, 2 * n).astype(np.uint64) * np.uint64(2) + r.integers(0, 2, 2 * n).astype(np.uint64)
        shared = near_copies.least_shared(n, n)
        a, b = h[:n], np.concatenate([h[:shared], h[n : 2 * n - shared]])
        prints = [np.frombuffer(sketch(x) + sketch(mixed(x)), np.uint64) for x in (a, b)]
        worst = max(worst, int(np.bitwise_count(prints[0] ^ prints[1]).sum()))
    assert worst <= near_copies.RADIUS


def test_groups_against_all_pairs(spark):
    texts = edited()
    tops = slow_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    root = {r["doc"]: r["root"] for r in near_copies.groups(docs.withColumnRenamed("doc_id", "doc")).collect()}
    assert all(root[i] == min(j for j in root if root[j] == root[i]) for i in root)
    got = {}
    for i in range(len(texts)):
        got.setdefault(root[i], set()).add(i)
    want = {}
    for i, t in enumerate(tops):
        want.setdefault(t, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert 30 < len(want) < len(texts) - 60


def test_the_stage_drops_edited_copies(spark):
    r = random.Random(5)
    t = [f"word{r.randrange(500)}" for _ in range(200)]
    near = t[:60] + ["other"] + t[61:130] + ["another"] + t[131:]  # 10 of 196 shingles differ
    far = [w if i % 12 else "new" for i, w in enumerate(t)]
    docs = spark.createDataFrame([(3, " ".join(t)), (1, " ".join(near)), (2, " ".join(far))], "doc_id long, text string")
    assert sorted(x["doc_id"] for x in cp.near_duplicates(spark, docs, "").collect()) == [1, 2]


def test_ids_do_not_make_groups(spark):
    rows = [(1, "a text of six words here"), (1, "and one that is quite different"), (None, "b c d e f g"), (None, "B c d  e f g")]
    kept = simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(x["text"].lower().split()[0] for x in kept) == ["a", "and", "b"]


def test_edge_tables(no_docs, clashing, docs):
    assert simhash.first_of_each(no_docs).count() == 0
    assert simhash.first_of_each(clashing).columns == clashing.columns
    ids = [x["doc_id"] for x in simhash.first_of_each(docs).collect()]
    assert {62, 63, 64} & set(ids) == {62} and 60 not in ids and ids.count(3) == 1 and None in ids


def test_columns_of_any_kind_and_name(spark):
    """Also such as cannot be hashed, and names with dots; rows with the same id and text, too."""
    rows = [(1, "a b c d e f", {"k": 1}, 2), (1, "a b c d e f", {"k": 2}, 2), (2, "a b c d e f", {"k": 3}, 5), (3, None, None, 1), (4, "x", {}, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a map` map<string,int>, `dotted.name` int")
    for some in (docs, docs.filter("`dotted.name` = 5 or doc_id > 2")):
        kept = cp.near_duplicates(spark, some, "")
        assert kept.columns == docs.columns
        ids = sorted(r["doc_id"] for r in kept.collect())
        assert ids == sorted({min(r["doc_id"] for r in some.collect()), 3, 4})
    one = simhash.first_of_each(docs).filter("doc_id = 1").collect()
    assert one == simhash.first_of_each(docs.repartition(3)).filter("doc_id = 1").collect() and len(one) == 1

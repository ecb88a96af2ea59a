"""Alignment against a plain table; planted passages."""

import random

import numpy as np

from claimloom.llm import decontam


def slow_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontam.MATCH if a[i - 1] == b[j - 1] else decontam.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + decontam.GAP, h[i][j - 1] + decontam.GAP)
    return max(map(max, h))


def test_alignment():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randint(0, 3) for _ in range(r.randint(1, 12))] for _ in range(2))
        score, start, end = decontam.align(np.array(a), np.array(b))
        assert score == slow_align(a, b)
        assert 0 <= start <= end <= len(b)
        assert slow_align(a, b[start:end]) == score


def planted():
    r = random.Random(8)
    words = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "n r s t l x".split()]
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = [say(r.randint(14, 50)) for _ in range(12)]
    docs, want = [], set()
    for i in range(80):
        body = say(r.randint(0, 150))
        if i % 4 == 0:
            k = r.randrange(12)
            copy = list(items[k])
            if i % 8 == 0:  # an edited copy
                for j in range(2, len(copy), 7):
                    copy[j] = "edited"
                del copy[5]
            at = r.randint(0, len(body))
            body[at:at] = copy
            want.add((i, k))
        elif i % 4 == 1:
            body[3:3] = items[i % 12][:5]  # a short stretch is no copy
        docs.append((i, " ".join(body).capitalize() + "."))
    return docs, [(k, ", ".join(x)) for k, x in enumerate(items)], want


def test_planted_passages(spark):
    docs, items, want = planted()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination_report(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    for r in got:  # the score is that of a full alignment
        code = {}
        ids = lambda t: [code.setdefault(w, len(code)) for w in decontam.words(t)]  # noqa: E731, B023
        item, doc = ids(items[r["item_id"]][1]), ids(docs[r["doc_id"]][1])
        assert abs(r["score"] - slow_align(item, doc) / (decontam.MATCH * len(item))) < 1e-9
    assert {r["doc_id"] for r in decontam.decontaminated(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_one_block_of_the_benchmark_at_a_time(spark, monkeypatch):
    """Many blocks give what one gives, and no two of their indexes are held at once."""
    import gc
    import weakref

    docs, items, want = planted()
    made, most, whole = weakref.WeakSet(), [0], decontam.Index.__init__

    def init(self, *a):
        whole(self, *a)
        made.add(self)
        gc.collect()
        most[0] = max(most[0], len(made))

    monkeypatch.setattr(decontam.Index, "__init__", init)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontam._blocks(b, 30))) > 8
    got = decontam.contamination_report(d, b, block=30).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert {r["doc_id"] for r in decontam.decontaminated(d, b, block=30).collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert most[0] <= 2


def test_against_all_items_by_all_texts(spark):
    """Copies with words changed, dropped and put in, against full alignment of every pair."""
    r = random.Random(12)
    words = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "n r s t l x".split()]
    items = [[r.choice(words) for _ in range(r.randint(8, 30))] for _ in range(10)]
    docs = []
    for i in range(120):
        copy = list(items[r.randrange(10)])
        for _ in range(r.randint(0, len(copy) // 3)):
            at = r.randrange(len(copy))
            copy[at : at + r.randint(0, 1)] = r.choice([[], ["new"], [r.choice(words)]])
        body = [r.choice(words) for _ in range(r.randint(0, 60))]
        at = r.randint(0, len(body))
        docs.append((i, " ".join(body[:at] + copy + body[at:])))
    want = {}
    for i, t in docs:
        for k, item in enumerate(items):
            code = {}
            a, b = ([code.setdefault(w, len(code)) for w in x] for x in (item, decontam.words(t)))
            score = slow_align(a, b) / (decontam.MATCH * len(item))
            if score >= decontam.LEAST:
                want[i, k] = score
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contamination_report(d, b).collect()}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and len(want) > 60
    assert all(abs(got[x] - want[x]) < 1e-9 for x in got)


def test_an_item_that_leaked_everywhere(spark):
    text = "ban cer dis fot gul hax jen kir los mut ban dis gul jen los"
    d = spark.createDataFrame([(i, f"{i} {text} tail {i}") for i in range(40)], "doc_id long, text string")
    b = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert decontam.contamination_report(d, b).count() == 40


def test_verbatim_and_popular_edited_copies(spark):
    """A few hold the item word by word, most of the corpus holds it with every 4th word changed."""
    item = "ban cer dis fot gul hax jen kir los mut bar cen dir fol gun har jes kit lon mux".split()
    edited = " ".join(w if i % 4 < 3 else "other" for i, w in enumerate(item))
    texts = [" ".join(item)] * 2 + [f"some {i} {edited} tail {i}" for i in range(200)] + [f"clean {i} ban cer dis" for i in range(50)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontam.contamination_report(d, b).collect()}
    assert got == {0: 1.0, 1: 1.0} | {i: 0.65 for i in range(2, 202)}
    assert decontam.decontaminated(d, b).count() == 50


def test_edge_tables(spark, docs, no_docs, rows, clashing):
    b = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, "nothing that is in any text here")], "item_id long, text string")
    assert decontam.contamination_report(docs, b).count() == 0
    assert decontam.contamination_report(no_docs, b).count() == 0
    assert decontam.decontaminated(clashing, b).columns == clashing.columns
    assert decontam.decontaminated(docs, b.limit(0)).count() == len(rows)
    short = spark.createDataFrame([(7, "Two words"), (8, "words"), (9, "")], "item_id long, text string")
    some = spark.createDataFrame([(1, "two  words!"), (2, "words"), (3, "these two words"), (4, "")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in decontam.contamination_report(some, short).collect()} == {(1, 7, 1.0), (2, 8, 1.0)}
    twice = spark.createDataFrame([(1, rows[0][1]), (2, rows[0][1])], "item_id long, text string")
    assert decontam.contamination_report(docs, twice).filter("doc_id = 0").count() == 2

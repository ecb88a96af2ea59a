"""Text functions on vectors worked out by hand."""

import pytest
from pyspark.sql import functions as F

from claimloom.functions import text as X
from claimloom.functions import values as V


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "said,want",
    [
        ("Drought leads to crop loss.", ("drought", "leads_to", "crop loss")),
        ("Whole grains causes satiety.", None),
        ("x y affects ab", None),
        ("A reduces B but causes C loss", ("a reduces b but", "causes", "c loss")),
        ('"Rain" increases \'the flow\'...', ("rain", "increases", "the flow")),
        ("Note: rain causes floods.", None),
        ("However, rain causes floods.", None),
        ("rain causes floods.\nsecond line", ("rain", "causes", "floods.")),
        ("", None),
        (None, None),
    ],
)
def test_triple(spark, said, want):
    got = one(spark, said, X.triple)
    assert (tuple(got) if got else None) == want


def test_chunks(spark):
    assert one(spark, "a" * 1999 + "\n" + "b", X.chunks) == ["a" * 1999, "b"]
    assert one(spark, "c" * 5000, X.chunks) == ["c" * 5000]
    assert one(spark, " x \r\n\n y z\x0bw", lambda c: X.chunks(c, 6)) == ["x y z", "w"]
    assert one(spark, "", X.chunks) == []


def naive_chunks(text, most):
    out, now, n = [], [], 0
    for line in (x.strip() for x in text.split("\n")):
        if line:
            if now and n + len(line) + 1 > most:
                out.append(" ".join(now))
                now, n = [line], len(line)
            else:
                now.append(line)
                n += len(line) + 1
    return out + ([" ".join(now)] if now else [])


def test_chunks_against_a_loop(spark):
    import random

    r = random.Random(3)
    texts = ["\n".join("ab " * r.randint(0, 6) for _ in range(r.randint(0, 30))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    for row in df.select("i", "v", X.chunks("v", 25).alias("c")).collect():
        assert row["c"] == naive_chunks(row["v"], 25)


def test_lists_of_answers(spark):
    assert one(spark, "1. Alpha\n- alpha\nnote: x\nab\nBeta", X.subtopics) == ["Alpha", "Beta"]
    assert one(spark, "²² things\n" + "w " * 9, X.subtopics) == ["²² things"]
    assert one(spark, "• two words 12.\none\nfollow the guidelines strictly now", X.topic_lines) == ["two words"]
    assert one(spark, "Yield rose 3.5 percent today.", X.sentences) == ["Yield rose 3", "5 percent today"]


def test_claims(spark):
    assert one(spark, "The use of GLP-1RAs by patients", X.claim_surface) == "glp 1ras"
    assert one(spark, "Use of GLP1RAs in patients", X.claim_surface) == "glp1 receptor agonist in people"
    assert one(spark, "Use of GLP1RAs in patients", X.claim_signature) == ["agonist", "glp1", "people", "receptor"]
    assert one(spark, "our understanding of knowledge of rain", lambda c: X.claim_surface(c, True)) == "rain"
    assert one(spark, None, X.claim_signature) == []
    assert one(spark, " Leads  To", X.relation_family) == "causes"
    assert one(spark, "made-up", X.relation_family) == "made_up"
    assert one(spark, "x", lambda c: X.jaccard(F.array().cast("array<string>"), F.array(c))) == 0.0
    assert one(spark, "x", lambda c: X.jaccard(F.array(c, F.lit("y")), F.array(c))) == 0.5


def test_labels_and_slugs(spark):
    assert one(spark, "a" * 181, X.shortened) == "a" * 177 + "..."
    assert one(spark, "a" * 180, X.shortened) == "a" * 180
    assert one(spark, "***", X.run_slug) == "doc"
    assert one(spark, " My  Paper (v2).pdf ", X.run_slug) == "my_paper_v2pdf"
    assert one(spark, "Éa b/c", X.focus_slug) == "éa_bc"
    assert one(spark, "!!", X.focus_slug) == "focus"
    assert one(spark, "answer: x<|end|>", X.clean_label) == "x"
    assert one(spark, "a_b  c", X.hover_label) == "a b c"
    assert one(spark, "import this", X.is_code) is True
    assert one(spark, "important", X.is_code) is False


def test_values_are_distinct():
    for words in (V.STATEMENT_STOPWORDS, V.QUESTION_STOPWORDS, V.TOPIC_STOPWORDS, V.CLAIM_STOPWORDS):
        assert len(words) == len(set(words))
    heads = V.LEADING_PHRASES + V.META_OBJECTS
    assert not any(a != b and b.startswith(a) for a in V.LEADING_PHRASES for b in V.LEADING_PHRASES), heads

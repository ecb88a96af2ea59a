import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use themselves.
CLASH = "size long, target double, source_size long, shard string, slot string, fp string, component_id string, score string, node string, key string, doc string, line string, hits string, row string"


def make_docs(seed=1, n=60):
    r = random.Random(seed)
    words = {"en": "the of and river bread window stone letter winter morning".split(), "fr": "le des été français rivière fenêtre pierre où très déjà".split()}
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "fr"
        text = "\n".join(" ".join(r.choice(words[lang]) + r.choice(["", "s", "er"]) for _ in range(r.randint(4, 14))) for _ in range(r.randint(1, 6)))
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    rows.append((n, rows[5][1], "en", None, 1))  # an exact copy, and a null source
    rows.append((n + 1, rows[7][1] + " more", None, "s0", 1))
    rows += [(n + 2, None, None, "s1", None), (n + 3, "", "en", "s1", 0), (n + 4, " \t\n", "en", None, 3), (n + 5, "12 34 !!", "en", "s2", 8)]
    rows.append((n + 6, "long " * 40_000, "en", "s3", 200_000))
    rows += [rows[3], rows[3]]  # repeated rows
    rows.append((None, "a text without an id, which must not be lost", "en", "s2", 1))
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def some():
    return make_docs(2, 300)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark, rows):
    """docs with columns named like those that operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    for c in CLASH.split(", "):
        name, kind = c.split(" ")
        df = df.withColumn(name, F.lit("7").cast(kind))
    return df

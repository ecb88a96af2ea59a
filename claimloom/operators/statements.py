"""Questions, statements and triples from the answers of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import values as V


def _ranked(rows: DataFrame, key: list[str], n: int, anchor: Column, guide: str, stopwords: list[str], meta: list[str]) -> DataFrame:
    """The n best items of each key: most tokens shared with the anchor, then with the guide, the
    fewest of talk about research, the shortest, the first."""
    mine = X.tokens("item", stopwords)
    rows = rows.withColumn("_a", X.overlap(mine, anchor)).withColumn("_g", X.overlap(mine, X.tokens(F.lit(guide), stopwords)))
    rows = rows.withColumn("_m", X.overlap(mine, F.array(*[F.lit(m) for m in meta])))
    w = Window.partitionBy(*key).orderBy(F.desc("_a"), F.desc("_g"), "_m", F.length("item"), "pos")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("_a", "_g", "_m", "pos")


def questions(answers: DataFrame, key: str = "topic", guide: str = "", n: int = V.QUESTIONS) -> DataFrame:
    """answers (key, path, raw) to (key, path, rank, question)."""
    rows = answers.select(key, "path", F.posexplode(F.split(X.strip("raw"), "\n")).alias("pos", "line"))
    rows = rows.withColumn("item", F.regexp_replace("line", r"^[ \-•\t]+|[ \-•\t]+$", "")).drop("line")
    rows = rows.filter((F.length("item") >= 8) & ~F.lower("item").contains("note:"))
    anchor = X.tokens(F.array_join("path", " "), V.QUESTION_STOPWORDS)
    return _ranked(rows, [key], n, anchor, guide, V.QUESTION_STOPWORDS, V.QUESTION_META).withColumnRenamed("item", "question").select(key, "path", "rank", "question")


def statements(answers: DataFrame, key: str = "question", guide: str = "", n: int = V.STATEMENTS) -> DataFrame:
    """answers (key, path, question, raw) to (key, path, question, rank, statement). Sentences with
    words of cause go before all others."""
    keep = list(dict.fromkeys([key, "path", "question"]))
    rows = answers.select(*keep, F.posexplode(X.sentences("raw")).alias("pos", "s"))
    low = F.lower("s")
    rows = rows.filter(~X._any(low, V.BAD_PHRASES)).withColumn("causal", X._any(low, V.CAUSAL_WORDS))
    rows = rows.withColumn("item", F.when(F.col("s").endswith("."), F.col("s")).otherwise(F.concat("s", F.lit(".")))).drop("s")
    some = F.max("causal").over(Window.partitionBy(key))
    rows = rows.withColumn("some", some).filter("causal or not some").drop("causal", "some")
    anchor = F.array_union(X.tokens("question", V.STATEMENT_STOPWORDS), X.tokens(F.array_join("path", " "), V.STATEMENT_STOPWORDS))
    return _ranked(rows, [key], n, anchor, guide, V.STATEMENT_STOPWORDS, V.STATEMENT_META).withColumnRenamed("item", "statement").select(*keep, "rank", "statement")


def triples(rows: DataFrame) -> DataFrame:
    """rows (seq, topic, path, question, statement) to triples of those that state a relation."""
    got = rows.withColumn("t", X.triple("statement")).filter("t is not null")
    return got.select("seq", "topic", "path", "question", "statement", "t.subj", "t.rel", "t.obj", F.get("path", F.lit(0)).alias("domain"))

"""Topics of documents: named by a model, or mined from word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import values as V
from .lineage import cut


def document_chunks(docs: DataFrame, most: int = V.CHUNK_CHARS) -> DataFrame:
    """(doc_id, pos, chunk)."""
    return docs.select("doc_id", F.posexplode(X.chunks("text", most)).alias("pos", "chunk"))


def topic_counts(topics: DataFrame, k: int | None = V.ROOT_TOPICS) -> DataFrame:
    """(topic, n) of topics in lower case, the most frequent first; ties by name."""
    out = topics.groupBy(F.lower("topic").alias("topic")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic")
    return out.limit(k) if k is not None else out


def topic_words(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, word): words of four letters or more that are no stopwords."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"([A-Za-z][A-Za-z\-]{2,})"), F.lit(1))
    good = F.filter(found, lambda w: (F.length(w) >= 4) & ~w.isin(*V.TOPIC_STOPWORDS))
    return docs.select("doc_id", F.posexplode(good).alias("pos", "word"))


def frequent(rows: DataFrame, k: int, good, slots: int = 1 << 20, first: int = 4096) -> DataFrame:
    """Of rows (topic, g), at least all topics that may be among the k most frequent, ties included:
    (g, n, topic), each with its whole count, of what good leaves.

    Topics are counted in slots by hash first, of which a task sends a number each, whatever the
    text. A slot's count is no less than any of its topics', so topics of the `first` fullest slots
    give a k-th count, and only slots that reach it are counted word for word. All exact."""
    slot = F.pmod(F.xxhash64("topic"), F.lit(slots))
    counts = cut(rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("full")), "slots")

    def counted(least: int) -> DataFrame:
        some = rows.withColumn("slot", slot).join(F.broadcast(counts.filter(F.col("full") >= least).select("slot")), "slot", "left_semi")
        return good(cut(some.groupBy("topic", "g").agg(F.count("*").alias("n")), "phrases"))

    top = counts.orderBy(F.desc("full")).limit(first).agg(F.count("*"), F.min("full")).first()
    if top[0] < first:
        return counted(0)
    best = counted(top[1])
    kth = best.groupBy("topic").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(k).agg(F.count("*"), F.min("n")).first()
    least = kth[1] if kth[0] == k else 0
    return best if least >= top[1] else counted(least)


def mined_topics(docs: DataFrame, n: int = V.ROOT_TOPICS, slots: int = 1 << 20, first: int = 4096) -> DataFrame:
    """(rank, topic): frequent phrases of three and two adjacent words of all documents, topped up
    with frequent words, and two topics that every text gets.

    n-grams are built inside each document by array functions; only those that may come among the
    topics are shuffled. A phrase counts if each of its words comes twice or more in the corpus.
    """
    dropped = [*V.TOPIC_GENERIC, *V.TOPIC_LAYOUT]
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"([A-Za-z][A-Za-z\-]{2,})"), F.lit(1))
    good = F.filter(found, lambda w: (F.length(w) >= 4) & ~w.isin(*V.TOPIC_STOPWORDS))
    rows = cut(docs.select(good.alias("w")), "topic-words")  # read three times below
    freq = cut(rows.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    kept = rows.select(F.filter("w", lambda w: ~w.isin(*dropped)).alias("w"))

    def grams(size: int) -> Column:
        last = F.size("w") - size + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(size)), " ")))

    both = kept.select(F.explode(F.concat(F.coalesce(grams(3), F.array().cast("array<string>")), F.coalesce(grams(2), F.array().cast("array<string>")))).alias("g"))
    spaced = F.replace(F.col("g"), F.lit("-"), F.lit(" "))

    def good(counted: DataFrame) -> DataFrame:
        # a phrase with a word that comes once comes once
        once = counted.filter("n = 1").select("g", F.explode(F.array_distinct(F.split("g", " "))).alias("word"))
        bad = once.join(freq.filter("n < 2").select("word"), "word", "left_semi").select("g").distinct()
        return counted.join(bad, "g", "left_anti")

    want = max(0, n - len(V.TOPICS_ALWAYS))
    phrases = frequent(both.select(spaced.alias("topic"), "g"), max(1, want), good, slots, first).groupBy("topic").agg(F.sum("n").alias("n"))
    best = phrases.orderBy(F.desc("n"), F.desc(F.length("topic")), "topic").limit(want).select(F.lit(0).alias("kind"), "n", F.length("topic").alias("size"), "topic")
    words = freq.filter(~F.col("word").isin(*dropped)).orderBy(F.desc("n"), "word").limit(200)
    single = words.select(F.lit(1).alias("kind"), "n", F.lit(0).alias("size"), F.replace("word", F.lit("-"), F.lit(" ")).alias("topic"))
    some = best.unionByName(single).orderBy("kind", F.desc("n"), F.desc("size"), "topic").limit(want)
    w = Window.orderBy("kind", F.desc("n"), F.desc("size"), "topic")
    numbered = some.select(F.row_number().over(w).alias("rank"), "topic")
    always = docs.sparkSession.createDataFrame([(want + i + 1, t) for i, t in enumerate(V.TOPICS_ALWAYS)], "rank int, topic string")
    return numbered.unionByName(always).filter(F.col("rank") <= n)

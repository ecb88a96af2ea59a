"""Triples, statements and topics derived from the order tables, for tables without causal prose.

One row per order with lines: the part with the least number is the subject, that with the
largest the object, the order number picks the relation and the form of the statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statement(s: Column, verb: Column, o: Column, b: Column) -> Column:
    say = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    forms = [
        say("What ", s, " ", verb, " ", o, "?"), say("Note: ", s, " ", verb, " ", o, "."), say("Ax ", verb, " ", o, "."), say(s, " relates to ", o, "."),
        say(s, " increases ", o, " and reduces waste."), say(s, " reduces ", o, " but causes delay."), say('"', s, '" ', verb, " '", o, "'."),
        say(s, " ", verb, " ", o, "..."), F.upper(say(s, " ", verb, " ", o, ".")), say(s, " ", verb, " ", o, ".\nsecond line"), say("However, ", s, " ", verb, " ", o, "."),
    ]
    out = say(s, " ", verb, " ", o, ".")
    for i, form in enumerate(forms):
        out = F.when(b == i, form).otherwise(out)
    return out


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, topic, path, question, statement, subj, rel, obj, domain)."""
    t = lambda n: table(spark, sf_dir, n)
    ends = t("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p1"), F.max("l_partkey").alias("p2"))
    part = t("part").select("p_partkey", F.lower(F.concat("p_name", F.lit(" "), "p_brand")).alias("label"))
    a, b = part.select(F.col("p_partkey").alias("p1"), F.col("label").alias("subj")), part.select(F.col("p_partkey").alias("p2"), F.col("label").alias("obj"))
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.lower("n_name").alias("topic"), F.lower("r_name").alias("domain"))
    home = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "topic", "domain")
    rows = t("orders").select("o_orderkey", "o_custkey").join(ends, F.col("o_orderkey") == F.col("l_orderkey")).join(a, "p1").join(b, "p2").join(home, F.col("o_custkey") == F.col("c_custkey"))
    pick = (F.col("o_orderkey") % 10 + 1).cast("int")
    rel = F.element_at(F.array(*[F.lit(r) for r, _ in V.RELATIONS]), pick)
    verb = F.element_at(F.array(*[F.lit(w) for _, w in V.RELATIONS]), pick)
    return rows.select(
        F.col("o_orderkey").alias("seq"), "topic", F.array("domain", "topic").alias("path"), F.concat(F.lit("what follows from "), "subj").alias("question"),
        statement(F.col("subj"), verb, F.col("obj"), F.col("o_orderkey") % 29).alias("statement"), "subj", rel.alias("rel"), "obj", "domain",
    )


def topic_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, parent, depth, seq): regions, nations, and market segments within nations."""
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    tops = region.select(F.lower("r_name").alias("topic"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    mids = named.select(F.lower("n_name").alias("topic"), F.lower("r_name").alias("parent"), F.lit(1).alias("depth"))
    leaves = customer.join(named, F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "n_name").distinct()
    low = leaves.select(F.concat(F.lower("c_mktsegment"), F.lit(" in "), F.lower("n_name")).alias("topic"), F.lower("n_name").alias("parent"), F.lit(2).alias("depth"))
    return tops.unionByName(mids).unionByName(low)


#: The same triples in SQL, for checks.
TRIPLES_SQL = (
    "ends as (select l_orderkey, min(l_partkey) p1, max(l_partkey) p2 from lineitem group by 1), "
    "raw as (select o_orderkey as seq, lower(a.p_name || ' ' || a.p_brand) as subj, lower(b.p_name || ' ' || b.p_brand) as obj, lower(n_name) as topic, lower(r_name) as domain, "
    "list_extract([" + ", ".join(f"'{r}'" for r, _ in V.RELATIONS) + "], (o_orderkey % 10 + 1)::int) as rel, "
    "list_extract([" + ", ".join(f"'{w}'" for _, w in V.RELATIONS) + "], (o_orderkey % 10 + 1)::int) as verb, o_orderkey % 29 as b "
    "from orders join ends on o_orderkey = l_orderkey join part a on a.p_partkey = p1 join part b on b.p_partkey = p2 "
    "join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey), "
    "triples as (select seq, topic, [domain, topic] as path, 'what follows from ' || subj as question, case b "
    "when 0 then 'What ' || subj || ' ' || verb || ' ' || obj || '?' when 1 then 'Note: ' || subj || ' ' || verb || ' ' || obj || '.' "
    "when 2 then 'Ax ' || verb || ' ' || obj || '.' when 3 then subj || ' relates to ' || obj || '.' "
    "when 4 then subj || ' increases ' || obj || ' and reduces waste.' when 5 then subj || ' reduces ' || obj || ' but causes delay.' "
    "when 6 then '\"' || subj || '\" ' || verb || ' ''' || obj || '''.' when 7 then subj || ' ' || verb || ' ' || obj || '...' "
    "when 8 then upper(subj || ' ' || verb || ' ' || obj || '.') when 9 then subj || ' ' || verb || ' ' || obj || '.' || chr(10) || 'second line' "
    "when 10 then 'However, ' || subj || ' ' || verb || ' ' || obj || '.' else subj || ' ' || verb || ' ' || obj || '.' end as statement, subj, rel, obj, domain from raw)"
)

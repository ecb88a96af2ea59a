"""Ranked claims: edges of the best models, weighted, tiered, and folded where they say the same."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import values as V
from .graph import MODEL
from .lineage import cut

CLAIM = "credibility double, src string, rel string, dst string, support_count long, models_supporting string, example_1 string, example_2 string, example_3 string"


def claims(weighted: DataFrame, edges: DataFrame, evidence: DataFrame, told: DataFrame) -> DataFrame:
    """Claims of the weighted models: the weights of the models that hold an edge, summed; its
    support and first statements; the foci of those models."""
    held = edges.filter(~F.col("rel").isin(*V.ANCHORS)).join(weighted.select(*MODEL, "weight"), MODEL)
    c = held.groupBy("src", "rel", "dst").agg(F.sum("weight").alias("credibility"), F.array_join(F.array_sort(F.collect_set("focus")), "; ").alias("models_supporting"))
    named = lambda d, extra: d.select(F.col("subj").alias("src"), "rel", F.col("obj").alias("dst"), extra)
    out = c.join(named(evidence, "support"), ["src", "rel", "dst"], "left").join(named(told, "examples"), ["src", "rel", "dst"], "left")
    told_of = [F.coalesce(F.get("examples", F.lit(i)), F.lit("")).alias(f"example_{i + 1}") for i in range(3)]
    return out.select("credibility", "src", "rel", "dst", F.coalesce("support", F.lit(0)).cast("long").alias("support_count"), "models_supporting", *told_of)


def ranked(df: DataFrame, k: int | None = None) -> DataFrame:
    """By credibility, then support; ties by source, relation and destination."""
    out = df.orderBy(F.desc("credibility"), F.desc("support_count"), "src", "rel", "dst")
    return out.limit(k) if k is not None else out


def anchored(df: DataFrame, words: list[str], scope: str = "example") -> DataFrame:
    """Claims with one of the words: in the first example, or with scope `all` anywhere."""
    where = F.col("example_1") if scope == "example" else F.concat_ws(" ", "src", "rel", "dst", "example_1", "example_2", "example_3")
    return df.filter(X._any(F.lower(F.coalesce(where, F.lit(""))), [w.lower() for w in words])) if words else df


def tier(c="credibility", first: float = V.TIER_1, second: float = V.TIER_2) -> Column:
    x = F.col(c)
    return F.when(x >= first, 1).when(x >= second, 2).otherwise(3)


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def _groups(rows: pd.DataFrame) -> list[list[int]]:
    """Leaders in order of rank: a row joins the first leader it overlaps with enough."""
    leaders: list[tuple[set, set]] = []
    groups: list[list[int]] = []
    by_token: dict[str, list[int]] = {}
    for i, (s, d) in enumerate(zip(rows["_s"], rows["_d"])):
        s, d = set(s), set(d)
        # without a token in common there is no overlap, so only leaders with one are compared
        near = sorted({g for t in s for g in by_token.get(t, ())})
        for g in near:
            ls, ld = leaders[g]
            js, jd = _jaccard(s, ls), _jaccard(d, ld)
            if any(js >= a and jd >= b for a, b in V.CLAIM_OVERLAPS):
                groups[g].append(i)
                break
        else:
            for t in s:
                by_token.setdefault(t, []).append(len(groups))
            groups.append([i])
            leaders.append((s, d))
    return groups


def quotient(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Claims that say the same folded into their best one, with how many there are. Rows meet
    only within a tier and a relation family, so the choice of leaders, which goes by order, is a
    task for each such block, of what the best models hold. All else are aggregates by leader:
    the most support, the models together, and the first three different examples, by the
    column they stand in and then by rank."""
    by, names = by or [], df.columns
    rows = cut(df.withColumn("_id", F.monotonically_increasing_id()), "claims")
    told = rows.select(*by, "_id", "credibility", "support_count", "src", "rel", "dst", X.relation_family("rel").alias("_family"), X.claim_signature("src").alias("_s"), X.claim_signature("dst", True).alias("_d"))

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["credibility", "support_count", "src", "rel", "dst"], ascending=[False, False, True, True, True], kind="stable").reset_index(drop=True)
        out = pd.DataFrame({"_id": pdf["_id"], "_rank": range(len(pdf)), "_leader": 0})
        for g in _groups(pdf):
            out.loc[g, "_leader"] = pdf["_id"].iloc[g[0]]  # the rank is by credibility and support, so the first is the best
        return out

    member = rows.join(told.groupBy(*by, "_family").applyInPandas(lead, "_id long, _rank long, _leader long"), "_id")
    one = F.transform(F.split(F.coalesce("models_supporting", F.lit("")), ";"), lambda m: X.strip(m))
    sums = member.groupBy("_leader").agg(
        F.max("support_count").alias("support_count"), F.count("*").cast("int").alias("summary_variant_count"),
        F.array_join(F.array_sort(F.filter(F.array_distinct(F.flatten(F.collect_list(one))), lambda m: m != "")), "; ").alias("models_supporting"),
    )
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col("_rank").alias("r"), X.strip(F.coalesce(f"example_{i}", F.lit(""))).alias("x")) for i in (1, 2, 3)])
    said = member.select("_leader", F.explode(cells).alias("c")).filter("c.x <> ''").groupBy("_leader", "c.x").agg(F.min(F.struct("c.i", "c.r")).alias("at"))
    said = said.groupBy("_leader").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "x"))), 1, 3)["x"].alias("told"))
    kept = [c for c in names if c not in ("support_count", "models_supporting", "example_1", "example_2", "example_3")]
    out = rows.select(*[F.col(c) for c in kept], F.col("_id").alias("_leader"), *[F.col(f"example_{i}").alias(f"_e{i}") for i in (1, 2, 3)])
    out = out.join(sums, "_leader").join(said, "_leader", "left")
    out = out.withColumns({f"example_{i}": F.coalesce(F.get("told", F.lit(i - 1)), f"_e{i}") for i in (1, 2, 3)})
    return out.withColumn("summary_equivalence_size", F.col("summary_variant_count")).select(*names, "summary_variant_count", "summary_equivalence_size")


def hubs(edges: DataFrame, k: int = V.HUB_EDGES) -> DataFrame:
    """(model, hub, rank, src, rel, dst): each model's node of the most edges out, and its first k."""
    out = edges.groupBy(*MODEL, "src").agg(F.count("*").alias("n"))
    best = out.groupBy(*MODEL).agg(F.max("n").alias("n"))
    hub = out.join(best, [*MODEL, "n"]).groupBy(*MODEL).agg(F.min("src").alias("hub"))
    mine = edges.join(hub, MODEL).filter("src = hub")
    w = Window.partitionBy(*MODEL).orderBy("dst", "rel")
    return mine.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*MODEL, "hub", "rank", "src", "rel", "dst")

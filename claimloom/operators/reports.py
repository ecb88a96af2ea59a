"""Reports: tables of a bounded number of rows, and Markdown made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import values as V
from . import claims as C
from .graph import MODEL, lcm_file


def models_table(weighted: DataFrame) -> DataFrame:
    """The chosen models in order, with score and weight."""
    w = Window.orderBy(F.desc("score"), "focus", "radius", "max_nodes")  # a few models
    return weighted.select(F.row_number().over(w).alias("rank"), *MODEL, "n_nodes", "n_edges", "score", "weight", lcm_file().alias("file"))


def claims_table(claims: DataFrame, k: int = V.TOP_CLAIMS) -> DataFrame:
    top = C.ranked(claims, k)
    w = Window.orderBy(F.desc("credibility"), F.desc("support_count"), "src", "rel", "dst")  # k rows
    return top.select(F.row_number().over(w).alias("rank"), X.claim_text("src", "rel", "dst").alias("claim"), "credibility", "support_count", "models_supporting", X.shortened("example_1", 140).alias("evidence"))


def hub_table(weighted: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """The hub of each chosen model and its first edges, with their support."""
    h = C.hubs(edges.join(weighted.select(*MODEL), MODEL, "left_semi"))
    e = evidence.select(F.col("subj").alias("src"), F.col("rel"), F.col("obj").alias("dst"), "support")
    return h.join(e, ["src", "rel", "dst"], "left").select(*MODEL, "hub", "rank", "src", "rel", "dst", F.coalesce("support", F.lit(0)).alias("support"))


def tier_table(claims: DataFrame, per_tier: int = V.PER_TIER, folded: bool = True, first: float = V.TIER_1, second: float = V.TIER_2) -> DataFrame:
    """The best claims of each tier, folded where they say the same."""
    rows = claims.withColumn("tier", C.tier("credibility", first, second))
    rows = C.quotient(rows, ["tier"]) if folded else rows.withColumn("summary_variant_count", F.lit(1)).withColumn("summary_equivalence_size", F.lit(1))
    w = Window.partitionBy("tier").orderBy(F.desc("credibility"), F.desc("support_count"), "src", "rel", "dst")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_tier)


def _cells(*x) -> str:
    return "| " + " | ".join(str(v).replace("|", "\\|").replace("\n", " ") for v in x) + " |"


def credibility_report(weighted: DataFrame, claims: DataFrame, title: str = "Credibility report", k: int = V.TOP_CLAIMS) -> str:
    """Markdown of the models and the first k claims; both are collected, being that few."""
    out = [f"# {title}", "", "## Models", "", _cells("rank", "focus", "radius", "nodes", "edges", "score", "weight"), _cells(*["---"] * 7)]
    for r in models_table(weighted).orderBy("rank").collect():
        out.append(_cells(r["rank"], r["focus"], r["radius"], r["n_nodes"], r["n_edges"], f"{r['score']:.3f}", f"{r['weight']:.3f}"))
    out += ["", "## Claims", "", _cells("rank", "claim", "credibility", "support", "models", "evidence"), _cells(*["---"] * 6)]
    for r in claims_table(claims, k).orderBy("rank").collect():
        out.append(_cells(r["rank"], r["claim"], f"{r['credibility']:.3f}", r["support_count"], r["models_supporting"], r["evidence"]))
    return "\n".join(out) + "\n"


def executive_summary(claims: DataFrame, title: str = "Executive summary", per_tier: int = V.PER_TIER, folded: bool = True) -> str:
    names = {1: "Strong claims", 2: "Plausible claims", 3: "Weak claims"}
    out = [f"# {title}"]
    rows = tier_table(claims, per_tier, folded).orderBy("tier", "rank").collect()
    for t, name in names.items():
        own = [r for r in rows if r["tier"] == t]
        out += ["", f"## {name}", ""] + ([] if own else ["None."])
        for r in own:
            more = f", {r['summary_variant_count']} variants" if r["summary_variant_count"] > 1 else ""
            out.append(f"{r['rank']}. {r['src']} —{r['rel']}→ {r['dst']} (credibility {r['credibility']:.2f}, support {r['support_count']}{more})")
            out += [f"   - {e[:180]}" for e in (r["example_1"], r["example_2"], r["example_3"]) if e]
    return "\n".join(out) + "\n"


def deep_dive(weighted: DataFrame, edges: DataFrame, evidence: DataFrame, claims: DataFrame, n: int = 5) -> str:
    """Markdown of each chosen model's hub and of the first n claims with all their examples."""
    out = ["# Deep dive"]
    for r in hub_table(weighted, edges, evidence).orderBy(*MODEL, "rank").collect():
        if r["rank"] == 1:
            out += ["", f"## {r['focus']} (radius {r['radius']}, {r['max_nodes']} nodes): hub {r['hub']}", ""]
        out.append(f"- {r['src']} —{r['rel']}→ {r['dst']} ({r['support']})")
    out += ["", "## First claims", ""]
    for r in C.ranked(claims, n).collect():
        out.append(f"- {r['src']} —{r['rel']}→ {r['dst']}: {r['credibility']:.3f}")
        out += [f"  - {e}" for e in (r["example_1"], r["example_2"], r["example_3"]) if e]
    return "\n".join(out) + "\n"


def figure_nodes(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a drawing of models needs: nodes with degrees, and edges."""
    ends = edges.select(*MODEL, F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy(*MODEL, "node").agg(F.count("*").alias("degree")), edges

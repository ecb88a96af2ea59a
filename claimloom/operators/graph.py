"""The causal graph, and the local models around its nodes.

Edges are kept once for each ordered pair of nodes, with the relation that was added last: a
triple adds subject to object, then its topic to the subject and to the object (anchors).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import values as V
from .lineage import cut, small


def stated(triples: DataFrame) -> DataFrame:
    """triples (seq, topic, subj, rel, obj) to (src, dst, rel, step, n, last): what they add, how
    often, and last. Edges and support are read from it, so triples are read once for both. Rows
    without subject or object add nothing; those without a topic add no anchors."""
    ok = triples.filter((F.coalesce("subj", F.lit("")) != "") & (F.coalesce("obj", F.lit("")) != ""))
    e = lambda s, d, r, k: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), r.alias("rel"), F.lit(k).alias("step"))
    added = ok.select("seq", F.explode(F.array(e("subj", "obj", F.col("rel"), 0), e("topic", "subj", F.lit(V.ANCHORS[0]), 1), e("topic", "obj", F.lit(V.ANCHORS[1]), 2))).alias("e"))
    added = added.select("seq", "e.*").filter(F.coalesce("src", F.lit("")) != "")
    return added.groupBy("src", "dst", "rel", "step").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def stated_edges(found: DataFrame) -> DataFrame:
    """stated() to edges (src, dst, rel, anchor)."""
    last = found.groupBy("src", "dst").agg(F.max_by(F.coalesce("rel", F.lit("")), F.struct("last", "step")).alias("rel"))
    return last.withColumn("anchor", F.col("rel").isin(*V.ANCHORS))


def stated_support(found: DataFrame, with_relation: bool = False) -> DataFrame:
    """stated() to (subj, obj[, rel], support): how many triples state an edge."""
    keys = [F.col("src").alias("subj"), F.col("dst").alias("obj"), *([F.col("rel")] if with_relation else [])]
    return found.filter("step = 0").groupBy(*keys).agg(F.sum("n").alias("support"))


def graph_edges(triples: DataFrame) -> DataFrame:
    """triples (seq, topic, subj, rel, obj) to edges (src, dst, rel, anchor)."""
    return stated_edges(stated(triples))


def graph_nodes(triples: DataFrame) -> DataFrame:
    """Subjects, objects and topics."""
    return triples.select(F.explode(F.array("subj", "obj", "topic")).alias("node")).filter(F.coalesce("node", F.lit("")) != "").distinct()


def statement_star(statements: DataFrame) -> DataFrame:
    """(topic, statements) to edges topic -> statement, `describes`."""
    rows = statements.select("topic", F.explode("statements").alias("s"))
    rows = rows.select(F.col("topic").alias("src"), X.strip("s").alias("dst"), F.lit("describes").alias("rel"))
    return rows.filter((F.col("dst") != "") & (F.coalesce("src", F.lit("")) != "")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree), in and out; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def focus_nodes(edges: DataFrame, k: int = V.FOCI, skip_code: bool = False) -> DataFrame:
    """The k nodes of the largest degree, anchors included; ties by name."""
    d = degrees(edges)
    return (d.filter(~X.is_code("node")) if skip_code else d).orderBy(F.desc("degree"), "node").limit(k)


def any_focus(edges: DataFrame, curated: list[str], seed: int = 0) -> DataFrame:
    """One of the curated nodes that are there, else one with an edge out of it; by seed."""
    spread = F.xxhash64("node", F.lit(seed))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    good = nodes.filter(F.col("node").isin(*curated)).withColumn("p", F.lit(0))
    rest = edges.select(F.col("src").alias("node")).distinct().withColumn("p", F.lit(1))
    return good.unionByName(rest).orderBy("p", spread, "node").limit(1).select("node")


def _marks(edges: DataFrame, foci: DataFrame, radius: int) -> tuple[list[str], DataFrame]:
    """The foci, and (node, m{hop}_{word}): a bit for each focus that reaches a node in so many hops
    or less. A wave is one join of edges, whatever the number of foci. Foci are few, by a setting."""
    names = [r["node"] for r in foci.select("node").distinct().orderBy("node").collect()]
    words = range(len(names) // 64 + 1)
    at = {w: [((1 << i % 64) + (1 << 63)) % (1 << 64) - (1 << 63) if i // 64 == w else 0 for i in range(len(names))] for w in words}
    marks = foci.sparkSession.createDataFrame([(n, *[at[w][i] for w in words]) for i, n in enumerate(names)], ", ".join(["node string", *[f"m0_{w} long" for w in words]]))
    out = edges.select("src", "dst").filter("src <> dst")
    for step in range(1, radius + 1):
        old = [c for c in marks.columns if c != "node"]
        new = out.join(marks, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(*[F.bit_or(f"m{step - 1}_{w}").alias(f"_{w}") for w in words])
        both = marks.join(new, "node", "full").fillna(0, [*old, *[f"_{w}" for w in words]])
        marks = cut(both.select("node", *old, *[F.col(f"m{step - 1}_{w}").bitwiseOR(F.col(f"_{w}")).alias(f"m{step}_{w}") for w in words]), "marks")
    return names, marks


def _reached(names: list[str], marks: DataFrame, radius: int) -> DataFrame:
    """(focus, node, hop) of marks."""
    words = range(len(names) // 64 + 1)
    word = lambda h: F.array(*[F.col(f"m{h}_{w}") for w in words])
    bit = lambda h, i: F.bit_get(F.get(F.col(f"w{h}"), F.floor(i / 64).cast("int")), i % 64) == 1

    def hop(i):
        out = F.lit(None).cast("int")
        for h in range(radius, -1, -1):
            out = F.when(bit(h, i), h).otherwise(out)
        return out

    some = marks.select("node", *[word(h).alias(f"w{h}") for h in range(radius + 1)])
    cells = F.transform(F.array(*[F.lit(n) for n in names]), lambda n, i: F.struct(n.alias("focus"), hop(i).alias("hop"))) if names else F.array().cast("array<struct<focus:string,hop:int>>")
    return some.select("node", F.explode(F.filter(cells, lambda c: c["hop"].isNotNull())).alias("c")).select("c.focus", "node", "c.hop")


def hops(edges: DataFrame, foci: DataFrame, radius: int) -> DataFrame:
    """(focus, node, hop): what each focus reaches along edges, and in how many steps."""
    names, marks = _marks(edges, foci, radius)
    return _reached(names, marks, radius)


def _degrees_within(names: list[str], marks: DataFrame, edges: DataFrame, radii: list[int]) -> DataFrame:
    """(focus, radius, node, degree): edges of a node whose other end the focus reaches within the
    radius, a loop twice. Bits of the other ends are added up side by side, so an edge is a row of
    bits and not one for each focus. Nodes that the focus does not reach have rows too."""
    words = range(len(names) // 64 + 1)
    columns = [f"m{r}_{w}" for r in radii for w in words]
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e")).select("e.*")
    rows = ends.join(marks.select(F.col("node").alias("other"), *columns), "other").select("node", *columns)
    wide = 64 * len(words)

    def count(batches):
        for b in batches:
            for lo in range(0, len(b), 4096):
                part = b.iloc[lo : lo + 4096]
                node = part["node"].to_numpy()
                start = np.concatenate([[0], np.nonzero(node[1:] != node[:-1])[0] + 1])
                bits = np.unpackbits(np.ascontiguousarray(part[columns].to_numpy(np.int64)).astype("<i8").view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
                sums = np.add.reduceat(bits, start, axis=0, dtype=np.int64)
                r, c = np.nonzero(sums)
                yield pd.DataFrame({"node": node[start][r], "i": c, "n": sums[r, c]})

    found = rows.repartition("node").sortWithinPartitions("node").mapInPandas(count, "node string, i long, n long").groupBy("node", "i").agg(F.sum("n").alias("degree"))
    known = [(int(k * wide + i), n, r) for k, r in enumerate(radii) for i, n in enumerate(names)]
    keys = edges.sparkSession.createDataFrame(known, "i long, focus string, radius int")
    return found.join(F.broadcast(keys), "i").select("focus", "radius", "node", "degree")


def sweep(edges: DataFrame, foci: DataFrame, radii: list[int] | None = None, sizes: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Local models of all foci, radii and sizes: nodes (focus, radius, max_nodes, node) and causal
    edges (focus, radius, max_nodes, src, dst, rel).

    One search serves all foci and radii: a node is in the model of radius r if its hop is at most
    r, and an edge if both ends are. One ranking by degree within the model serves all sizes: a
    model with more than m nodes keeps the first m - 1, and the focus. Edges are looked up for pairs
    of the largest model's nodes, which are few, and shared by the smaller ones.
    """
    radii, sizes = radii or V.RADII, sizes or V.MAX_NODES
    names, marks = _marks(edges, foci, max(radii))
    rs = F.explode(F.array(*[F.lit(r) for r in radii]))
    degree = _degrees_within(names, marks, edges, sorted(set(radii)))
    members = _reached(names, marks, max(radii)).select("focus", "node", "hop", rs.alias("radius")).filter("hop <= radius").join(degree, ["focus", "radius", "node"], "left")
    members = members.withColumn("degree", F.coalesce("degree", F.lit(0)))
    w = Window.partitionBy("focus", "radius")
    ranked = members.withColumn("rank", F.row_number().over(w.orderBy(F.desc("degree"), "node"))).withColumn("n", F.count("*").over(w))
    # of a node: the sizes whose models have it
    inside = F.filter(F.array(*[F.lit(m) for m in sizes]), lambda m: (F.col("n") <= m) | (F.col("rank") <= m - 1) | (F.col("node") == F.col("focus")))
    kept = cut(ranked.select("focus", "radius", "node", inside.alias("sizes")).filter(F.size("sizes") > 0), "lcm-nodes")
    nodes = kept.select("focus", "radius", F.explode("sizes").alias("max_nodes"), "node")
    held = kept.select("node").distinct()
    causal = edges.filter("not anchor").select("src", "dst", "rel").join(held.select(F.col("node").alias("src")), "src", "left_semi").join(held.select(F.col("node").alias("dst")), "dst", "left_semi")
    a = kept.select("focus", "radius", F.col("node").alias("src"), F.col("sizes").alias("s1"))
    b = kept.select("focus", "radius", F.col("node").alias("dst"), F.col("sizes").alias("s2"))
    lcm = a.join(b, ["focus", "radius"]).join(causal, ["src", "dst"]).select("focus", "radius", F.explode(F.filter("s1", lambda m: F.array_contains("s2", m))).alias("max_nodes"), "src", "dst", "rel")
    return nodes, lcm


MODEL = ["focus", "radius", "max_nodes"]


def sweep_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(model, n_nodes, n_edges, focus_edges): a model is degenerate with less than 2 edges, or
    none at its focus."""
    n = nodes.groupBy(*MODEL).agg(F.count("*").alias("n_nodes"))
    at = F.count_if((F.col("src") == F.col("focus")) | (F.col("dst") == F.col("focus")))
    e = edges.groupBy(*MODEL).agg(F.count("*").alias("n_edges"), at.alias("focus_edges"))
    out = n.join(e, MODEL, "left").fillna(0, ["n_edges", "focus_edges"])
    return out.withColumn("degenerate", (F.col("n_edges") < 2) | (F.col("focus_edges") < 1))


def lcm_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One nested row a model, as it is written to a file."""
    n = nodes.groupBy(*MODEL).agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    e = edges.groupBy(*MODEL).agg(F.array_sort(F.collect_list(F.struct("src", "dst", "rel"))).alias("edges"))
    out = n.join(e, MODEL, "left")
    return out.withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<src:string,dst:string,rel:string>>")))


def lcm_file(focus="focus", radius="radius", max_nodes="max_nodes") -> Column:
    return F.concat(X.focus_slug(focus), F.lit("_r"), F.col(radius).cast("string"), F.lit("_m"), F.col(max_nodes).cast("string"), F.lit(".json"))


def documents_of(scores: DataFrame, documents: DataFrame) -> DataFrame:
    """The nested models of score rows. A row without its model is an error, which names some."""
    missing = scores.select(*MODEL).join(documents, MODEL, "left_anti").orderBy(*MODEL).take(3)
    if missing:
        raise ValueError(f"scores without a model: {[tuple(r) for r in missing]}")
    return documents.join(scores.select(*MODEL).distinct(), MODEL, "left_semi")


def model_graph(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and causal edges of nested models: endpoints and the focus are nodes, listed or not."""
    edges = documents.select(*MODEL, F.explode("edges").alias("e")).select(*MODEL, "e.*").filter(~F.col("rel").isin(*V.ANCHORS))
    listed = documents.select(*MODEL, F.explode(F.array_append(F.col("nodes"), F.col("focus"))).alias("node"))
    ends = edges.select(*MODEL, F.explode(F.array("src", "dst")).alias("node"))
    return listed.unionByName(ends).distinct(), edges


def simplex_counts(triples: DataFrame, chunk: int = 4096) -> DataFrame:
    """(i, j, k, domain, n) of chained triples of one domain, and how often they chain. Equal pairs
    are counted before they are joined, and the counts multiplied. What goes on from a node is a
    few arrays of about `chunk` in the join, and becomes rows only behind it."""
    pairs = cut(triples.groupBy("subj", "obj", "domain").agg(F.count("*").alias("n")), "pairs")
    a = pairs.select(F.col("subj").alias("i"), F.col("obj").alias("j"), "domain", F.col("n").alias("n1"))
    onward = pairs.select(F.col("subj").alias("j"), "domain", F.struct(F.col("obj").alias("k"), F.col("n").alias("n2")).alias("x"))
    much = onward.groupBy("j", "domain").agg(F.ceil(F.count("*") / chunk).alias("parts")).filter("parts > 1")
    part = F.pmod(F.xxhash64("x.k"), F.coalesce("parts", F.lit(1)))
    b = onward.join(much, ["j", "domain"], "left").groupBy("j", "domain", part.alias("part")).agg(F.collect_list("x").alias("x"))
    return a.join(b, ["j", "domain"]).select("i", "j", "domain", "n1", F.explode("x").alias("x")).select("i", "j", F.col("x.k").alias("k"), "domain", (F.col("n1") * F.col("x.n2")).alias("n"))


def simplices(triples: DataFrame) -> DataFrame:
    """simplex_counts(), each as often as it chains."""
    return simplex_counts(triples).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("i", "j", "k", "domain")


def triangles(edges: DataFrame) -> DataFrame:
    """Distinct (a, b, c), a <= b <= c, of two edges u -> v -> w with u <> w."""
    pairs = edges.select("src", "dst").distinct()
    one = pairs.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    two = pairs.select(F.col("src").alias("v"), F.col("dst").alias("w"))
    t = one.join(two, "v").filter("u <> w").select(F.array_sort(F.array("u", "v", "w")).alias("t"))
    return t.select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c")).distinct()


def simplicial_inputs(edges: DataFrame, domains: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a network over a small graph reads: nodes (node, degree, domain_id), edges (src, dst) and
    triangles (a, b, c). domains: (node, domain), `Unknown` where one is missing; their ids are
    dense, in their order."""
    pairs = edges.select("src", "dst").distinct()
    degree = pairs.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    named = degree.join(domains.groupBy("node").agg(F.min("domain").alias("domain")), "node", "left").withColumn("domain", F.coalesce("domain", F.lit("Unknown")))
    ids = named.select("domain").distinct().withColumn("domain_id", F.row_number().over(Window.orderBy("domain")) - 1)  # a row a domain
    return named.join(ids, "domain").select("node", "degree", "domain_id"), pairs, triangles(pairs)


def paths(topics: DataFrame) -> DataFrame:
    """(topic, path) from the root. Of topics that come twice the last by seq counts, if there is
    one. One join a level, on what is not yet at its root; cycles and missing parents give none."""
    if "seq" in topics.columns:
        topics = topics.groupBy("topic").agg(F.max_by("parent", "seq").alias("parent"))
    links = cut(topics.select("topic", "parent").distinct(), "paths")
    todo = links.select("topic", F.array("topic").alias("path"), "parent")
    done = todo.filter("parent is null").select("topic", "path")
    todo = todo.filter("parent is not null")
    up = links.select(F.col("topic").alias("t2"), F.col("parent").alias("p2"))
    while True:
        todo = todo.filter(~F.array_contains("path", F.col("parent")))  # a cycle has no root
        todo = cut(todo.join(up, F.col("parent") == F.col("t2")).select("topic", F.array_prepend("path", F.col("t2")).alias("path"), F.col("p2").alias("parent")), "paths")
        done = done.unionByName(todo.filter("parent is null").select("topic", "path"))
        todo = todo.filter("parent is not null")
        if small(todo, 1):
            break
    return done


def discovering_edges(found: DataFrame) -> DataFrame:
    """(seq, parent, child) to each child's first parent."""
    return found.groupBy(F.col("child").alias("topic")).agg(F.min_by("parent", "seq").alias("parent"))


def parents(edges: DataFrame, nodes: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(node, parents): sorted distinct sources of causal edges between nodes, under their column
    names. names: node to column."""
    to = F.create_map(*[F.lit(x) for kv in (names or {}).items() for x in kv]) if names else None
    named = lambda c: F.coalesce(to[F.col(c)], F.col(c)) if to is not None else F.col(c)
    n = nodes.select(named("node").alias("node")).distinct()
    e = edges.filter(~F.col("rel").isin(*V.ANCHORS)).select(named("src").alias("src"), named("dst").alias("dst")).filter("src <> dst")
    e = e.join(n.select(F.col("node").alias("src")), "src", "left_semi").join(n.select(F.col("node").alias("dst")), "dst", "left_semi")
    p = e.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("parents"))
    return n.join(p, "node", "left").select("node", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))

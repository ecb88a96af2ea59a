"""One query for each operator, over whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import claims as C
from ..operators import generate as L
from ..operators import graph as G
from ..operators import manifold as M
from ..operators import reports as R
from ..operators import scoring as S
from ..operators import statements as T
from ..operators import topics as P
from ..operators.lineage import cut, scratch
from ..sources import fixtures, readers, writers
from ..sources.fixtures import TRIPLES_SQL, table
from ..streaming.slices import latest_support, merge_slices, merge_support, triple_stream
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: The pipeline's defaults: 3,000 local models.
DEFAULTS = pipeline.Settings()
FOCI, RADII, SIZES, MODELS = DEFAULTS.foci, DEFAULTS.radii, DEFAULTS.max_nodes, DEFAULTS.models
GUIDE = "large red widgets and what follows from brand"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.strip()
        return f

    return add


def _triples(spark, d) -> DataFrame:
    return fixtures.triples(spark, d)


def _edges(spark, d) -> DataFrame:
    return G.graph_edges(_triples(spark, d))


def _stated_sweep(spark, d):
    found = cut(G.stated(_triples(spark, d)), "stated")
    edges = cut(G.stated_edges(found), "edges")
    nodes, lcm = G.sweep(edges, G.focus_nodes(edges, FOCI), RADII, SIZES)
    return found, nodes, cut(lcm, "lcm")


def _sweep(spark, d):
    return _stated_sweep(spark, d)[1:]


def _scores(spark, d, local_only: bool = False):
    found, nodes, lcm = _stated_sweep(spark, d)
    return S.text_scores(nodes, lcm, G.stated_support(found), local_only=local_only), nodes, lcm


def _claims(spark, d) -> DataFrame:
    s = pipeline.Settings(foci=FOCI, radii=RADII, max_nodes=SIZES, models=MODELS)
    return pipeline.phase_two(_triples(spark, d), s)["claims"]


# SQL pieces
def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _squeezed(x: str) -> str:
    return _strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def _tokens(x: str, stop) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+(?:-[a-z0-9]+)*'), lambda t: length(t) > 2 and not list_contains({_list(stop)}, t)))"


def _has(x: str, phrases) -> str:
    return "(" + " or ".join(f"contains({x}, '" + p.replace("'", "''") + "')" for p in phrases) + ")"


EDGES_SQL = (
    TRIPLES_SQL + ", added as (select subj as src, obj as dst, rel, seq, 0 as step from triples union all select topic, subj, 'has_subj', seq, 1 from triples "
    "union all select topic, obj, 'has_obj', seq, 2 from triples), "
    "edges as materialized (select src, dst, arg_max(rel, seq * 3 + step) as rel from added group by 1, 2), "
    "degrees as (select node, count(*) as degree from (select src as node from edges union all select dst from edges) group by 1), "
    f"foci as (select node from degrees order by degree desc, node limit {FOCI})"
)
SWEEP_SQL = (
    EDGES_SQL
    + ", reach0 as materialized (select node as focus, node, 0 as hop from foci), "
    + "".join(
        f"reach{h} as materialized (select focus, node, min(hop) as hop from (select * from reach{h - 1} union all select r.focus, e.dst, {h} from reach{h - 1} r join edges e on e.src = r.node where r.hop = {h - 1}) group by 1, 2), "
        for h in range(1, max(RADII) + 1)
    )
    + f"reach as (select * from reach{max(RADII)}), "
    "inner_edges as materialized (select a.focus, e.src, e.dst, e.rel, greatest(a.hop, b.hop) as enter from edges e join reach a on a.node = e.src join reach b on b.focus = a.focus and b.node = e.dst), "
    f"radii as (select unnest({RADII}) as radius), sizes as (select unnest({SIZES}) as max_nodes), "
    "inner_degrees as (select focus, radius, node, count(*) as degree from (select focus, src as node, enter from inner_edges union all select focus, dst, enter from inner_edges) join radii on enter <= radius group by 1, 2, 3), "
    "members as (select r.focus, x.radius, r.node, coalesce(degree, 0) as degree from reach r join radii x on r.hop <= x.radius left join inner_degrees i on i.focus = r.focus and i.radius = x.radius and i.node = r.node), "
    "ordered as (select *, row_number() over (partition by focus, radius order by degree desc, node) as rank, count(*) over (partition by focus, radius) as n from members), "
    "nodes as materialized (select focus, radius, max_nodes, node from ordered cross join sizes where n <= max_nodes or rank <= max_nodes - 1 or node = focus), "
    "lcm as materialized (select a.focus, a.radius, a.max_nodes, e.src, e.dst, e.rel from inner_edges e join nodes a on a.focus = e.focus and a.node = e.src "
    "join nodes b on b.focus = a.focus and b.radius = a.radius and b.max_nodes = a.max_nodes and b.node = e.dst where e.rel not in ('has_subj', 'has_obj')), "
    "n_nodes as (select focus, radius, max_nodes, count(*) as n_nodes from nodes group by all), "
    "support as (select subj, obj, count(*) as support from triples group by all), "
    "n_edges as (select focus, radius, max_nodes, count(*) as n_edges, count(*) filter (src = focus or dst = focus) as focus_edges, sum(ln(1 + coalesce(support, 0))) - 0.25 * count(*) as score "
    "from lcm left join support on subj = src and obj = dst group by 1, 2, 3), "
    "scores as (select n.focus, n.radius, n.max_nodes, n.n_nodes, coalesce(e.n_edges, 0) as n_edges, coalesce(e.focus_edges, 0) as focus_edges, coalesce(e.score, 0.0) as score "
    "from n_nodes n left join n_edges e on e.focus = n.focus and e.radius = n.radius and e.max_nodes = n.max_nodes)"
)
CLAIMS_SQL = (
    SWEEP_SQL + f", best as (select * from scores order by round(score, 9) desc, focus, radius, max_nodes limit {MODELS}), "
    "weighted as (select *, exp(score - max(score) over ()) / sum(exp(score - (select max(score) from best))) over () as weight from best), "
    "held as (select l.*, w.weight from lcm l join weighted w on w.focus = l.focus and w.radius = l.radius and w.max_nodes = l.max_nodes), "
    "full_support as (select subj, obj, rel, count(*) as support from triples group by all), "
    "told as (select subj, obj, rel, list(statement order by seq)[1:3] as examples from triples where statement <> '' group by 1, 2, 3), "
    "claims as (select sum(weight) as credibility, h.src, h.rel, h.dst, any_value(coalesce(support, 0)) as support_count, array_to_string(list_sort(list(distinct focus)), '; ') as models_supporting, "
    "coalesce(any_value(examples)[1], '') as example_1, coalesce(any_value(examples)[2], '') as example_2, coalesce(any_value(examples)[3], '') as example_3 "
    "from held h left join full_support f on f.subj = h.src and f.obj = h.dst and f.rel = h.rel left join told t on t.subj = h.src and t.obj = h.dst and t.rel = h.rel group by h.src, h.rel, h.dst)"
)


# sources and text
@query("select lower(n_name) as topic from nation where trim(n_name) <> '' and not starts_with(trim(n_name), '#')")
def s3_root_topics(spark, d):
    rows = table(spark, d, "nation").select(F.lower("n_name").alias("topic"))
    noise = rows.select(F.concat(F.lit("# "), "topic").alias("topic")).unionByName(rows.select(F.lit("  ").alias("topic")))
    return readers.root_topic_rows(rows.select(F.concat(F.lit(" "), "topic", F.lit("\t")).alias("topic")).unionByName(noise)).select("topic")


@query("select doc_id, substr(text, 1, 12000) as text from documents")
def s2_first_characters(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 12000).alias("text"))


@query(f"with {TRIPLES_SQL} select topic, path, question from triples union all select topic, path, 'why ' || subj from triples")
def s5_question_file(spark, d):
    folder = scratch(spark, "questions")
    writers.json_lines(_triples(spark, d).select("topic", "path", F.array("question", F.concat(F.lit("why "), "subj")).alias("questions")), folder)
    return readers.questions(spark, folder).select("topic", "path", "question")


@query(f"with {TRIPLES_SQL} select topic, question, 0 as pos, statement from triples union all select topic, question, 1, 'and ' || subj from triples")
def s6_statement_file(spark, d):
    folder = scratch(spark, "statements")
    writers.json_lines(_triples(spark, d).select("topic", "path", "question", F.array("statement", F.concat(F.lit("and "), "subj")).alias("statements")), folder)
    return readers.statements(spark, folder).select("topic", "question", "pos", "statement")


@query("select p_name as file, round(p_retailprice, 2) as score from part")
def s9_score_file(spark, d):
    folder = scratch(spark, "scores")
    writers.report_table(table(spark, d, "part").select(F.col("p_name").alias("file"), F.col("p_retailprice").alias("score")), folder)
    return readers.table(spark, folder, "score double", ["file", "score"]).withColumn("score", F.round("score", 2))


@query(f"with {TRIPLES_SQL} select seq, subj, obj, rel from triples where seq % 7 <> 0")
def s7_triple_aliases(spark, d):
    t = _triples(spark, d)
    even = F.col("seq") % 2 == 0
    rows = t.select("seq", F.when(even, F.col("subj")).otherwise("").alias("subj"), F.when(~even, F.col("subj")).alias("source"), F.when(F.col("seq") % 7 != 0, F.col("obj")).alias("tail"), F.col("rel").alias("predicate"))
    return readers.normalised_triples(rows).select("seq", "subj", "obj", "rel")


@query()
def p1_chunks(spark, d):
    return P.document_chunks(table(spark, d, "documents")).select("doc_id", "pos", "chunk")


ORACLE["p1_chunks"] = f"""
with recursive n as (
  select doc_id, list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c]'), lambda x: {_strip("x")}), lambda x: x <> '') as lines from documents
), fold as (
  select doc_id, lines, 1 as i, 0 as pos, lines[1] as chunk, length(lines[1]) + 1 as len from n where len(lines) > 0
  union all
  select doc_id, lines, i + 1,
    case when len + length(lines[i + 1]) + 1 > {V.CHUNK_CHARS} then pos + 1 else pos end,
    case when len + length(lines[i + 1]) + 1 > {V.CHUNK_CHARS} then lines[i + 1] else chunk || ' ' || lines[i + 1] end,
    case when len + length(lines[i + 1]) + 1 > {V.CHUNK_CHARS} then length(lines[i + 1]) else len + length(lines[i + 1]) + 1 end
  from fold where i < len(lines)
)
select doc_id, pos, arg_max(chunk, i) as chunk from fold group by doc_id, pos
"""


def _topic_answers(spark, d) -> DataFrame:
    """Messy answers made of subjects: bullets, numbers, notes, repeats and short lines."""
    t = _triples(spark, d)
    line = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("- "), "subj")).when(F.col("seq") % 5 == 1, F.concat(F.lit("2. "), F.upper("subj"))).when(F.col("seq") % 5 == 2, F.concat(F.lit("Note: "), "subj")).when(F.col("seq") % 5 == 3, F.lit("* ab")).otherwise(F.concat("subj", F.lit(" "), "obj"))
    g = t.select("topic", F.floor(F.col("seq") / 100).alias("part"), F.struct("seq", line.alias("line")).alias("x")).groupBy("topic", "part").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return g.select("topic", "part", F.array_join("x.line", "\n").alias("raw"))


_ANSWERS_SQL = (
    "answers as (select topic, (seq // 100)::bigint as part, string_agg(case seq % 5 when 0 then '- ' || subj when 1 then '2. ' || upper(subj) when 2 then 'Note: ' || subj when 3 then '* ab' else subj || ' ' || obj end, chr(10) order by seq) as raw from triples group by 1, 2)"
)


@query(f"""with {TRIPLES_SQL}, {_ANSWERS_SQL}, l as (select topic, part, {_strip("trim(unnest(string_split(raw, chr(10))), ' •-*0123456789.')")} as item from answers)
select topic, part, item from l where item <> '' and not {_has("lower(item)", V.TOPIC_JUNK)} and len(string_split_regex(item, '\\s+')) between 2 and 8""")
def p2_topics(spark, d):
    return _topic_answers(spark, d).select("topic", "part", F.explode(X.topic_lines("raw")).alias("item"))


@query(f"""with {TRIPLES_SQL}, {_ANSWERS_SQL}, l as (select topic, part, {_strip("unnest(string_split(raw, chr(10)))")} as line, generate_subscripts(string_split(raw, chr(10)), 1) as i from answers),
n as (select topic, part, i, {_strip("ltrim(line, '-•*0123456789. ')")} as item from l where line <> '' and not contains(lower(line), 'note:'))
select topic, part, item from (select *, row_number() over (partition by topic, part, lower(item) order by i) as k from n where length(item) >= 3 and len(string_split_regex(item, '\\s+')) <= 8) where k = 1""")
def p3_subtopics(spark, d):
    return _topic_answers(spark, d).select("topic", "part", F.explode(X.subtopics("raw")).alias("item"))


def _question_answers(spark, d) -> DataFrame:
    t = _triples(spark, d)
    line = F.when(F.col("seq") % 6 == 0, F.lit("short")).when(F.col("seq") % 6 == 1, F.concat(F.lit("note: "), "question")).when(F.col("seq") % 6 == 2, F.concat(F.lit("What evidence is there in "), "topic", F.lit(" of "), "subj")).otherwise(F.concat(F.lit(" - "), "question"))
    g = t.select("topic", "path", F.floor(F.col("seq") / 100).alias("part"), F.struct("seq", line.alias("line")).alias("x")).groupBy("topic", "path", "part").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return g.select(F.concat("topic", F.lit("/"), F.col("part").cast("string")).alias("key"), "path", F.array_join("x.line", "\n").alias("raw"))


def _rank_sql(anchor: str, stop, meta) -> str:
    own = _tokens("item", stop)
    return f"len(list_intersect({own}, {anchor})) desc, len(list_intersect({own}, {_tokens("'" + GUIDE + "'", stop)})) desc, len(list_intersect({own}, {_list(meta)})), length(item), i"


@query(f"""with {TRIPLES_SQL}, answers as (select topic || '/' || (seq // 100)::bigint as key, path, string_agg(case seq % 6 when 0 then 'short' when 1 then 'note: ' || question when 2 then 'What evidence is there in ' || topic || ' of ' || subj else ' - ' || question end, chr(10) order by seq) as raw from triples group by 1, 2),
l as (select key, path, trim(unnest(string_split({_strip("raw")}, chr(10))), ' -•' || chr(9)) as item, generate_subscripts(string_split({_strip("raw")}, chr(10)), 1) as i from answers),
r as (select key, item, row_number() over (partition by key order by {_rank_sql(_tokens("array_to_string(path, ' ')", V.QUESTION_STOPWORDS), V.QUESTION_STOPWORDS, V.QUESTION_META)}) as rank from l where length(item) >= 8 and not contains(lower(item), 'note:'))
select key, rank::int as rank, item as question from r where rank <= 2""")
def p4_questions(spark, d):
    return T.questions(_question_answers(spark, d), "key", GUIDE).select("key", "rank", "question")


@query(f"""with l as (select doc_id, {_strip("unnest(string_split_regex(replace(text, chr(10), ' '), '[.?!]'))")} as sentence from documents)
select doc_id, sentence from l where length(sentence) >= 10""")
def p5_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.sentences("text")).alias("sentence"))


def _statement_answers(spark, d) -> DataFrame:
    t = _triples(spark, d).select("topic", "path", F.floor(F.col("seq") / 40).alias("part"), F.struct("seq", "question", "statement").alias("x"))
    g = t.groupBy("topic", "path", "part").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return g.select(F.concat("topic", F.lit("/"), F.col("part").cast("string")).alias("key"), "path", F.col("x.question")[0].alias("question"), F.array_join("x.statement", " ").alias("raw"))


@query(f"""with {TRIPLES_SQL}, answers as (select topic || '/' || (seq // 40)::bigint as key, path, arg_min(question, seq) as question, string_agg(statement, ' ' order by seq) as raw from triples group by 1, 2),
l as (select key, path, question, {_strip("unnest(string_split_regex(replace(raw, chr(10), ' '), '[.?!]'))")} as s, generate_subscripts(string_split_regex(replace(raw, chr(10), ' '), '[.?!]'), 1) as i from answers),
c as (select *, s || case when s like '%.' then '' else '.' end as item, {_has("lower(s)", V.CAUSAL_WORDS)} as causal from l where length(s) >= 10 and not {_has("lower(s)", V.BAD_PHRASES)}),
k as (select *, bool_or(causal) over (partition by key) as any_causal from c),
r as (select key, question, item, row_number() over (partition by key order by {_rank_sql(f"list_distinct(list_concat({_tokens('question', V.STATEMENT_STOPWORDS)}, {_tokens('array_to_string(path, chr(32))', V.STATEMENT_STOPWORDS)}))", V.STATEMENT_STOPWORDS, V.STATEMENT_META)}) as rank from k where causal or not any_causal)
select key, question, rank::int as rank, item as statement from r where rank <= 2""")
def p6_statements(spark, d):
    return T.statements(_statement_answers(spark, d), "key", GUIDE).select("key", "question", "rank", "statement")


@query(f"select item_id, list_sort({_tokens('text', V.STATEMENT_STOPWORDS)}) as tokens from benchmark")
def p7_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_sort(X.tokens("text", V.STATEMENT_STOPWORDS)).alias("tokens"))


def _triple_sql() -> str:
    bare = f"regexp_replace(lower({_strip('statement')}), '\\.+$', '')"
    q = "[" + V.QUOTES.replace("'", "''") + "]"
    clean = lambda x: _strip(f"regexp_replace({_strip(x)}, '^{q}+|{q}+$', '', 'g')")
    pats = [(r, f"(.+?)\\s+{w}\\s+(.+)") for r, w in V.RELATIONS]
    pick = lambda g: "case " + " ".join(f"when regexp_matches(bare, '{p}') then regexp_extract(bare, '{p}', {g})" for _, p in pats) + " end"
    rel = "case " + " ".join(f"when regexp_matches(bare, '{p}') then '{r}'" for r, p in pats) + " end"
    starts = "|".join(V.QUESTION_STARTS)
    return (
        f"said as (select *, {bare} as bare from triples), raw_triples as (select seq, statement, {rel} as r, {pick(1)} as s0, {pick(2)} as o0 from said), "
        f"clean as (select seq, statement, r, {clean('s0')} as s, {clean('o0')} as o from raw_triples where r is not null), "
        f"extracted as (select seq, s as subj, r as rel, o as obj from clean where length(s) >= 3 and length(o) >= 3 and not regexp_matches(s, '^(?:{starts})') and not {_has('lower(statement)', V.INSTRUCTIONS)})"
    )


@query(f"with {TRIPLES_SQL}, {_triple_sql()} select seq, subj, rel, obj from extracted")
def p9_triples(spark, d):
    return T.triples(_triples(spark, d)).select("seq", "subj", "rel", "obj")


@query(f"with {TRIPLES_SQL}, {_triple_sql()} select subj, rel, obj, count(*) as support from extracted group by 1, 2, 3 order by support desc, subj, rel, obj limit 20")
def flagship_support(spark, d):
    s = S.support(T.triples(_triples(spark, d)), True)
    return s.orderBy(F.desc("support"), "subj", "rel", "obj").limit(20).select("subj", "rel", "obj", "support")


_FAMILY = "coalesce(map_extract(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in V.RELATION_FAMILIES.items()) + "}, x)[1], x)"


@query(f"with {TRIPLES_SQL}, n as (select rel, replace({_squeezed('lower(rel)')}, '-', '_') as x, count(*) as n from triples group by 1) select rel, {_FAMILY} as family, n from n")
def p12_relation_family(spark, d):
    return _triples(spark, d).groupBy("rel").agg(F.count("*").alias("n")).select("rel", X.relation_family("rel").alias("family"), "n")


def _claim_text(spark, d) -> DataFrame:
    t = _triples(spark, d)
    b = F.col("seq") % 6
    s = F.when(b == 0, F.concat(F.lit("The use of "), "subj", F.lit(" by patients"))).when(b == 1, F.concat(F.lit("GLP-1RAs, which "), "subj")).when(b == 2, F.concat(F.lit("Use of GLP1RAs in patients/"), "subj")).when(b == 3, F.concat(F.lit("knowledge of the_"), "obj")).when(b == 4, F.concat(F.lit("an increase in loss of "), "subj", F.lit("!"))).otherwise(F.col("subj"))
    return t.select("seq", s.alias("value"))


def _surface_sql(x: str, is_object: bool) -> str:
    lead, meta = "|".join(V.LEADING_PHRASES), "|".join(V.META_OBJECTS)
    cut_ = "case " + " ".join(f"when contains({x}, '{m}') and trim(string_split({x}, '{m}')[1]) <> '' then trim(string_split({x}, '{m}')[1])" for m in V.CLAUSE_MARKERS) + f" else {x} end"
    out = f"regexp_replace(regexp_replace(replace({cut_}, '_', ' '), '[-/]+', ' ', 'g'), '[^\\w\\s]', ' ', 'g')"
    for p, new in V.REWRITES:
        out = f"regexp_replace({out}, '{p}', '{new}', 'g')"
    out = f"regexp_replace({_squeezed(out)}, '^(?:{lead})+', '')"
    out = _strip(f"regexp_replace({out}, '^(?:the|a|an)\\s+', '')")
    return _squeezed(f"regexp_replace({out}, '^(?:{meta})+', '')" if is_object else out)


_CLAIM_TEXT_SQL = "said as (select seq, case seq % 6 when 0 then 'The use of ' || subj || ' by patients' when 1 then 'GLP-1RAs, which ' || subj when 2 then 'Use of GLP1RAs in patients/' || subj when 3 then 'knowledge of the_' || obj when 4 then 'an increase in loss of ' || subj || '!' else subj end as value from triples), low as (select seq, trim(lower(value)) as v from said)"
_SIGN = "list_sort(list_distinct(list_filter(string_split({}, ' '), lambda t: t <> '' and not list_contains(" + _list(V.CLAIM_STOPWORDS) + ", t))))"


@query(f"with {TRIPLES_SQL}, {_CLAIM_TEXT_SQL} select seq, {_surface_sql('v', False)} as subject, {_surface_sql('v', True)} as object from low")
def p13_claim_surface(spark, d):
    return _claim_text(spark, d).select("seq", X.claim_surface("value").alias("subject"), X.claim_surface("value", True).alias("object"))


@query(f"with {TRIPLES_SQL}, {_CLAIM_TEXT_SQL}, n as (select seq, {_surface_sql('v', True)} as x from low) select seq, {_SIGN.format('x')} as signature from n")
def p14_signature(spark, d):
    return _claim_text(spark, d).select("seq", X.claim_signature("value", True).alias("signature"))


@query(f"""with {TRIPLES_SQL}, n as (select seq, {_SIGN.format(_surface_sql('subj', False))} as a, {_SIGN.format(_surface_sql('obj', True))} as b from triples)
select seq, round(case when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) as overlap from n""")
def p15_jaccard(spark, d):
    return _triples(spark, d).select("seq", F.round(X.jaccard(X.claim_signature("subj"), X.claim_signature("obj", True)), 6).alias("overlap"))


@query(f"""with s as (select doc_id, {_squeezed('text')} as x from documents) select doc_id, case when length(x) > 180 then substr(x, 1, 177) || '...' else x end as short,
coalesce(nullif(substr(replace(trim(regexp_replace(lower(x), '[^a-z0-9 _-]+', '', 'g')), ' ', '_'), 1, 60), ''), 'doc') as run,
coalesce(nullif(substr(replace(trim(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}} _-]', '', 'g')), ' ', '_'), 1, 80), ''), 'focus') as focus from s""")
def p16_short_and_slugs(spark, d):
    x = X.squeezed("text")
    return table(spark, d, "documents").select("doc_id", X.shortened("text").alias("short"), X.run_slug(x).alias("run"), X.focus_slug(x).alias("focus"))


@query("""select page_id, trim(replace(replace(replace('answer:' || html || '<|end|>', '<|end|>', ''), '<|assistant|>', ''), 'answer:', '')) as label, substr(sha256(html), 1, 12) as sha,
regexp_matches(lower(url), '\\b(def|class|import|return|print)\\b|get_gpt_response|prompt\\):|\\bno other text\\b|#|\\{|\\}|\\[|\\]|::|;|=\\s*') as code from pages""")
def p19_labels(spark, d):
    raw = F.concat(F.lit("answer:"), "html", F.lit("<|end|>"))
    return table(spark, d, "pages").select("page_id", X.clean_label(raw).alias("label"), X.content_id("html").alias("sha"), X.is_code("url").alias("code"))


@query(f"with {TRIPLES_SQL} select seq, array_to_string(path, ' → ') as path_text, subj || ' —' || rel || '→ ' || obj as claim, seq % 4 = 1 as mine from triples")
def p23_rendering(spark, d):
    return _triples(spark, d).select("seq", X.path_text("path").alias("path_text"), X.claim_text("subj", "rel", "obj").alias("claim"), (F.col("seq") % 4 == 1).alias("mine"))


# topics
@query(f"with {TRIPLES_SQL}, {_ANSWERS_SQL}, l as (select {_strip("trim(unnest(string_split(raw, chr(10))), ' •-*0123456789.')")} as item from answers) select lower(item) as topic, count(*) as n from l where item <> '' and not {_has('lower(item)', V.TOPIC_JUNK)} and len(string_split_regex(item, '\\s+')) between 2 and 8 group by 1 order by n desc, topic limit 18")
def a1_topic_counts(spark, d):
    return P.topic_counts(_topic_answers(spark, d).select(F.explode(X.topic_lines("raw")).alias("topic")))


@query(f"""with w as (select doc_id, list_filter(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z\\-]{{2,}}'), lambda x: length(x) >= 4 and not list_contains({_list(V.TOPIC_STOPWORDS)}, x)) as w from documents),
freq as (select word, count(*) as n from (select unnest(w) as word from w) group by 1),
k as (select list_filter(w, lambda x: not list_contains({_list([*V.TOPIC_GENERIC, *V.TOPIC_LAYOUT])}, x)) as w from w),
g as (select unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i+2])) as g from k where len(w) >= 3 union all select unnest(list_transform(range(1, len(w)), lambda i: w[i:i+1])) from k where len(w) >= 2),
c as (select g, count(*) as n from g group by 1),
bad as (select distinct g from (select g, unnest(g) as word from c) join freq using (word) where n < 2),
p as (select replace(array_to_string(g, ' '), '-', ' ') as topic, sum(n)::bigint as n from c anti join bad using (g) group by 1),
f as (select 0 as kind, n, length(topic) as size, topic from p order by n desc, size desc, topic limit 16),
s as (select 1 as kind, n, 0 as size, replace(word, '-', ' ') as topic from freq where not list_contains({_list([*V.TOPIC_GENERIC, *V.TOPIC_LAYOUT])}, word) order by n desc, word limit 200),
m as (select * from (select * from f union all select * from s) order by kind, n desc, size desc, topic limit 16)
select row_number() over (order by kind, n desc, size desc, topic)::int as rank, topic from m union all select 17, 'association versus causation' union all select 18, 'key mechanisms and mediators'""")
def a2_mined_topics(spark, d):
    return P.mined_topics(table(spark, d, "documents"))


# evidence and graph
@query(f"with {TRIPLES_SQL} select subj, obj, count(*) as support from triples group by 1, 2")
def a3_support(spark, d):
    return S.support(_triples(spark, d))


@query(f"with {TRIPLES_SQL} select subj, obj, rel, count(*) as support from triples group by 1, 2, 3")
def a4_support_rel(spark, d):
    return S.support(_triples(spark, d), True)


@query(f"with {TRIPLES_SQL} select subj, obj, rel, list(statement order by seq)[1:3] as examples from triples where statement <> '' group by 1, 2, 3")
def a5_examples(spark, d):
    return S.examples(_triples(spark, d))


@query(f"with {EDGES_SQL} select node, degree from degrees")
def a6_degree(spark, d):
    return G.degrees(_edges(spark, d))


@query(f"with {TRIPLES_SQL} select node, count(*) as support from (select subj as node from triples union all select obj from triples) group by 1")
def a7_node_support(spark, d):
    return S.node_support(_triples(spark, d))


@query(f"with {EDGES_SQL} select node, degree from degrees order by degree desc, node limit 40")
def o1_focus(spark, d):
    return G.focus_nodes(_edges(spark, d), 40)


@query(f"with {EDGES_SQL} select src, dst, rel, rel in ('has_subj', 'has_obj') as anchor from edges")
def g1_edges(spark, d):
    return _edges(spark, d)


@query(f"with {TRIPLES_SQL} select distinct node from (select subj as node from triples union all select obj from triples union all select topic from triples)")
def u2_nodes(spark, d):
    return G.graph_nodes(_triples(spark, d))


@query(f"with {TRIPLES_SQL}, s as (select topic as src, {_strip('statement')} as dst from triples) select distinct src, dst, 'describes' as rel from s where dst <> ''")
def s14_statement_star(spark, d):
    return G.statement_star(_triples(spark, d).groupBy("topic").agg(F.collect_list("statement").alias("statements")))


@query(f"with {SWEEP_SQL} select focus, node, hop from reach")
def g2_reach(spark, d):
    edges = cut(_edges(spark, d), "edges")
    return G.hops(edges, G.focus_nodes(edges, FOCI), max(RADII))


@query(f"with {SWEEP_SQL} select * from nodes")
def g2_lcm_nodes(spark, d):
    return _sweep(spark, d)[0]


@query(f"with {SWEEP_SQL} select * from lcm")
def g4_lcm_edges(spark, d):
    return _sweep(spark, d)[1]


@query(f"with {SWEEP_SQL} select focus, radius, max_nodes, n_nodes, n_edges, focus_edges, n_edges < 2 or focus_edges < 1 as degenerate from scores")
def g5_sweep_index(spark, d):
    return G.sweep_index(*_sweep(spark, d))


@query(f"with {SWEEP_SQL} select focus, radius, max_nodes, n_nodes, n_edges from scores where not (n_edges < 2 or focus_edges < 1)")
def f6_sound_models(spark, d):
    return G.sweep_index(*_sweep(spark, d)).filter("not degenerate").select("focus", "radius", "max_nodes", "n_nodes", "n_edges")


@query(f"with {SWEEP_SQL} select focus, radius, max_nodes, n_nodes, n_edges, round(score, 6) as score from scores")
def a8_scores(spark, d):
    return _scores(spark, d)[0].withColumn("score", F.round("score", 6))


@query(f"with {SWEEP_SQL}, k as (select *, row_number() over (partition by focus order by round(score, 9) desc, radius, max_nodes) as k from scores where not regexp_matches(lower(focus), 'europe|asia')) select focus, radius, max_nodes, round(score, 6) as score from k where k = 1 order by round(score, 9) desc, focus, radius, max_nodes limit 10")
def w3_best_models(spark, d):
    return S.top_models(_scores(spark, d)[0], 10, 0, True, "europe|asia").select("focus", "radius", "max_nodes", F.round("score", 6).alias("score"))


@query(f"with {CLAIMS_SQL} select focus, radius, max_nodes, round(score, 6) as score, round(weight, 6) as weight from weighted")
def a9_weights(spark, d):
    return S.softmax(S.top_models(_scores(spark, d)[0], MODELS)).select("focus", "radius", "max_nodes", F.round("score", 6).alias("score"), F.round("weight", 6).alias("weight"))


@query(f"with {CLAIMS_SQL} select round(credibility, 6) as credibility, src, rel, dst, support_count, models_supporting, example_1, example_2, example_3 from claims")
def a10_claims(spark, d):
    return _claims(spark, d).withColumn("credibility", F.round("credibility", 6))


@query(f"with {CLAIMS_SQL} select src, rel, dst, round(credibility, 6) as credibility, support_count from claims order by round(credibility, 9) desc, support_count desc, src, rel, dst limit 30")
def o4_top_claims(spark, d):
    c = _claims(spark, d).withColumn("credibility", F.round("credibility", 9))
    return C.ranked(c, 30).select("src", "rel", "dst", F.round("credibility", 6).alias("credibility"), "support_count")


@query(f"with {CLAIMS_SQL} select src, rel, dst from claims where regexp_matches(lower(example_1), 'red|bolt')")
def f4_anchored(spark, d):
    return C.anchored(_claims(spark, d), ["Red", "bolt"]).select("src", "rel", "dst")


@query(f"with {CLAIMS_SQL} select case when round(credibility, 9) >= 0.6 then 1 when round(credibility, 9) >= 0.3 then 2 else 3 end as tier, count(*) as n from claims group by 1")
def f8_tiers(spark, d):
    c = _claims(spark, d).withColumn("credibility", F.round("credibility", 9))
    return c.groupBy(C.tier().alias("tier")).agg(F.count("*").alias("n"))


@query(f"""with {SWEEP_SQL}, o as (select focus, radius, max_nodes, src, count(*) as n from lcm group by all), h as (select focus, radius, max_nodes, src as hub from (select *, row_number() over (partition by focus, radius, max_nodes order by n desc, src) as k from o) where k = 1)
select focus, radius, max_nodes, hub, k::int as rank, src, rel, dst from (select l.*, hub, row_number() over (partition by l.focus, l.radius, l.max_nodes order by dst, rel) as k from lcm l join h on h.focus = l.focus and h.radius = l.radius and h.max_nodes = l.max_nodes and l.src = hub) where k <= 8""")
def a12_hubs(spark, d):
    return C.hubs(_sweep(spark, d)[1])


@query()
def a13_quotient(spark, d):
    c = _claims(spark, d).withColumn("credibility", F.round("credibility", 9))
    return C.quotient(c.withColumn("tier", C.tier()), ["tier"])


@query()
def r4_tier_table(spark, d):
    return R.tier_table(_claims(spark, d).withColumn("credibility", F.round("credibility", 9)))


@query(f"""with {CLAIMS_SQL} select row_number() over (order by round(score, 9) desc, focus, radius, max_nodes)::int as rank, focus, radius, max_nodes, n_nodes, n_edges, round(score, 6) as score, round(weight, 6) as weight,
replace(regexp_replace(focus, '[^\\p{{L}}\\p{{N}} _-]', '', 'g'), ' ', '_') || '_r' || radius || '_m' || max_nodes || '.json' as file from weighted""")
def r1_models_table(spark, d):
    w = S.softmax(S.top_models(_scores(spark, d)[0], MODELS))
    return R.models_table(w.withColumn("score", F.round("score", 9))).withColumns({"score": F.round("score", 6), "weight": F.round("weight", 6)})


@query(f"""with {CLAIMS_SQL}, t as (select * from claims order by round(credibility, 9) desc, support_count desc, src, rel, dst limit 30), e as (select *, {_squeezed('example_1')} as x from t)
select row_number() over (order by round(credibility, 9) desc, support_count desc, src, rel, dst)::int as rank, src || ' —' || rel || '→ ' || dst as claim, round(credibility, 6) as credibility, support_count, models_supporting, case when length(x) > 140 then substr(x, 1, 137) || '...' else x end as evidence from e""")
def r2_claims_table(spark, d):
    c = _claims(spark, d).withColumn("credibility", F.round("credibility", 9))
    return R.claims_table(c).withColumn("credibility", F.round("credibility", 6))


@query(f"with {TRIPLES_SQL} select a.subj as i, a.obj as j, b.obj as k, a.domain, count(*) as n from triples a join triples b on a.obj = b.subj and a.domain = b.domain group by all")
def g9_simplices(spark, d):
    return G.simplex_counts(_triples(spark, d))


@query(f"with {SWEEP_SQL}, e as (select distinct src, dst from lcm where radius = 1) select distinct t[1] as a, t[2] as b, t[3] as c from (select list_sort([x.src, x.dst, y.dst]) as t from e x join e y on x.dst = y.src where x.src <> y.dst)")
def g10_triangles(spark, d):
    return G.triangles(_sweep(spark, d)[1].filter("radius = 1").select("src", "dst").distinct())


@query("""with leaves as (select distinct c_mktsegment, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select lower(r_name) as topic, lower(r_name) as path from region union all select lower(n_name), lower(r_name) || ' → ' || lower(n_name) from nation join region on n_regionkey = r_regionkey
union all select lower(c_mktsegment || ' in ' || n_name), lower(r_name) || ' → ' || lower(n_name) || ' → ' || lower(c_mktsegment || ' in ' || n_name) from leaves""")
def g7_paths(spark, d):
    return G.paths(fixtures.topic_forest(spark, d)).select("topic", X.path_text("path").alias("path"))


@query(f"with {EDGES_SQL} select dst as topic, arg_min(src, seq * 3 + step) as parent from added where step > 0 group by 1")
def j5_discovering(spark, d):
    t = _triples(spark, d)
    found = t.select(F.explode(F.array(F.struct((F.col("seq") * 3 + 1).alias("seq"), F.col("topic").alias("parent"), F.col("subj").alias("child")), F.struct((F.col("seq") * 3 + 2).alias("seq"), F.col("topic").alias("parent"), F.col("obj").alias("child")))).alias("x")).select("x.*")
    return G.discovering_edges(found)


@query(f"with {TRIPLES_SQL}, s as (select subj as value, seq * 2 as pos0 from triples union all select obj, seq * 2 + 1 from triples), f as (select value, min(pos0) as pos0 from s group by 1) select row_number() over (order by pos0) - 1 as id, value from f")
def a14_encode(spark, d):
    return M.encode(_triples(spark, d), ["subj", "obj"])


_STATE = "s as (select subj as value, seq * 2 as pos0 from triples union all select obj, seq * 2 + 1 from triples), f as (select value, min(pos0) as pos0 from s group by 1), ids as (select row_number() over (order by pos0) - 1 as id, value from f), ds as (select domain as value, row_number() over (order by min(seq)) - 1 as id from triples group by 1)"


@query(f"with {TRIPLES_SQL}, {_STATE} select ids.id, dd.value as label from (select value, min(did) as did from (select subj as value, ds.id as did from triples join ds on ds.value = domain union all select obj, ds.id from triples join ds on ds.value = domain) group by 1) m join ids using (value) join ds dd on dd.id = did")
def a15_node_domain(spark, d):
    s = M.relational_state(_triples(spark, d))
    return M.node_labels(s["nodes"], s["edges"], s["dom"], "dom_id")


@query(f"with {TRIPLES_SQL}, {_STATE} select seq, a.id as i, b.id as j, ds.id as dom_id from triples join ids a on a.value = subj join ids b on b.value = obj join ds on ds.value = domain")
def g8_state_edges(spark, d):
    return M.relational_state(_triples(spark, d))["edges"].select("seq", "i", "j", "dom_id")


def _heat(how: str, agg: str):
    @query(f"with {SWEEP_SQL} select radius, " + ", ".join(f"round({agg} filter (max_nodes = {m}), 6) as \"{m}\"" for m in SIZES) + " from scores group by radius")
    def heat(spark, d):
        out = S.landscape(_scores(spark, d)[0], how)
        return out.select("radius", *[F.round(F.col(f"`{m}`"), 6).alias(str(m)) for m in SIZES])

    return heat


for _how, _agg in (("mean", "avg(score)"), ("median", "median(score)"), ("max", "max(score)"), ("bad", "avg(case when score <= 0 then 1.0 else 0.0 end)")):
    _name = f"a16_heat_{_how}"
    QUERIES[_name] = _heat(_how, _agg)
    ORACLE[_name] = ORACLE.pop("heat")
    QUERIES.pop("heat")


@query(f"with {SWEEP_SQL} select focus, round(max(score), 6) as best from scores group by 1 order by round(max(score), 9) desc, focus limit 8")
def a17_best_focus(spark, d):
    s = _scores(spark, d)[0].withColumn("score", F.round("score", 9))
    return S.best_by_focus(s, 8).withColumn("best", F.round("best", 6))


@query(f"with {SWEEP_SQL}, e as (select distinct src, dst from lcm where radius = 1 and src <> dst), n as (select distinct node from nodes where radius = 1) select node, coalesce(list_sort(list(src) filter (src in (select node from n))), []) as parents from n left join e on dst = node group by node")
def a20_parents(spark, d):
    nodes, lcm = _sweep(spark, d)
    return G.parents(lcm.filter("radius = 1"), nodes.filter("radius = 1"))


@query("""with c as (select count(*) as n, var_pop(l_quantity) * count(*) as s0, regr_syy(l_extendedprice, l_quantity) - power(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity) as s1, regr_syy(l_tax, l_discount) - power(regr_sxy(l_tax, l_discount), 2) / regr_sxx(l_tax, l_discount) as s2 from lineitem)
select 'l_quantity' as node, round(n * (ln(2 * pi()) + ln(s0 / n) + 1) + ln(n), 3) as bic from c union all select 'l_extendedprice', round(n * (ln(2 * pi()) + ln(s1 / n) + 1) + 2 * ln(n), 3) from c union all select 'l_tax', round(n * (ln(2 * pi()) + ln(s2 / n) + 1) + 2 * ln(n), 3) from c""")
def a21_bic(spark, d):
    got = S.linear_bic(table(spark, d, "lineitem"), {"l_quantity": [], "l_extendedprice": ["l_quantity"], "l_tax": ["l_discount"]})
    return spark.createDataFrame([(k, round(v, 3)) for k, v in got.items()], "node string, bic double")


@query()
def a22_hover_clusters(spark, d):
    e = table(spark, d, "embeddings")
    points = M.layout(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("h")), 64)
    return M.hover_clusters(points, e.select(F.col("vec_id").alias("id"), F.concat(F.lit("group_"), F.col("label").cast("string")).alias("label")))


# numeric
@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as activation from embeddings")
def n6_activation(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(M.activation("embedding"), 6).alias("activation"))


@query("""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as h from embeddings), p as (select a.vec_id as id, b.vec_id as other, 1 - list_cosine_similarity(a.h, b.h) as distance from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 25 = 0),
r as (select *, row_number() over (partition by id order by round(distance, 9), other) as rank from p) select id, rank::int as rank, other, round(distance, 6) as distance from r where rank <= 5""")
def n7_nearest(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("h"))
    return M.nearest(v, v.filter("id % 25 = 0"), 5).withColumn("distance", F.round("distance", 6))


@query("with v as (select vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as a from embeddings) select vec_id, round((a - min(a) over ()) / greatest(max(a) over () - min(a) over (), 1e-6), 6) as size from v")
def n9_marker_size(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", M.activation("embedding").alias("size"))
    return M.scaled(v, "size").withColumn("size", F.round("size", 6))


@query()
def n1_hashed_vectors(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), M.hashed_vectors("p_name", 16).alias("h"))


@query()
def n2_message_pass(spark, d):
    s = M.relational_state(_triples(spark, d))
    v = s["nodes"].select("id", M.hashed_vectors("value", 16).alias("h"))
    return M.message_pass(v, s["edges"], 10, 16, 2)


@query()
def n4_expert_block(spark, d):
    return M.expert_block(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("h")), 64)


@query()
def n7_layout(spark, d):
    return M.layout(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("h")), 64)


# predicates, resume, generation, increments
@query("select event_id, try_cast(props as double) as score from events where try_cast(props as double) is not null and not isnan(try_cast(props as double)) union all select event_id, value from events where not isnan(value)")
def f9_numeric_scores(spark, d):
    e = table(spark, d, "events")
    text = e.select("event_id", S.numbers("props").alias("score")).filter("score is not null")
    return text.unionByName(e.select("event_id", F.col("value").cast("string").alias("v")).select("event_id", S.numbers("v").alias("score")).filter("score is not null"))


@query("select doc_id, source from documents anti join labels using (doc_id)")
def f11_unlabelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("file"))
    return readers.labels_left(docs, table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("file"))).select("doc_id", "source")


@query("select doc_id, substr(sha256(text), 1, 12) as sha from documents where substr(sha256(text), 1, 12) not in (select substr(sha256(text), 1, 12) from documents where doc_id % 3 = 0)")
def f12_runs_left(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.content_id("text").alias("sha"))
    done = docs.filter("doc_id % 3 = 0").select("sha", F.lit("ok").alias("phase1_status"), F.lit("ok").alias("phase2_status"))
    return readers.runs_left(docs, done)


@query(f"with {TRIPLES_SQL} select subj, obj, rel, count(*) as support from triples group by 1, 2, 3")
def t2_merged_slices(spark, d):
    t, state = _triples(spark, d), None
    for k in range(3):
        state = merge_support(state, t.filter(F.col("seq") % 3 == k))
    return state


@query()
def g6_topic_expansion(spark, d):
    roots = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("seq"), F.lower("r_name").alias("topic"))
    return L.expand_topics(roots, L.StubClient, 3, 100)


@query()
def l1_phase_one(spark, d):
    roots = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("seq"), F.lower("r_name").alias("topic"))
    return pipeline.phase_one(roots, L.StubClient, GUIDE, 2, 40)["triples"]


@query(f"with {TRIPLES_SQL} select subj, obj, rel, count(*) as support from triples group by 1, 2, 3")
def t1_streamed_triples(spark, d):
    folder = scratch(spark, "stream")
    _triples(spark, d).drop("seq").repartition(3, "subj").write.json(f"{folder}/in")
    merge_slices(triple_stream(spark, f"{folder}/in", 1), f"{folder}/out", f"{folder}/check").awaitTermination()
    return latest_support(spark, f"{folder}/out").select("subj", "obj", "rel", "support")


@query(f"with {TRIPLES_SQL}, {_STATE}, labels as (select value, min(did) as did from (select subj as value, ds.id as did from triples join ds on ds.value = domain union all select obj, ds.id from triples join ds on ds.value = domain) group by 1) select ids.id, trim(ids.value) as label, dd.value as domain from ids join labels using (value) join ds dd on dd.id = did")
def j12_exported_points(spark, d):
    s = M.relational_state(_triples(spark, d))
    points = s["nodes"].select("id", F.array(F.lit(0.0), F.lit(0.0)).alias("xy"))
    return M.export_points(points, s["nodes"], M.node_labels(s["nodes"], s["edges"], s["dom"], "dom_id")).select("id", "label", "domain")


# files, flags and inputs
_FOREST_SQL = """forest as (select lower(r_name) as topic, null as parent, 0 as depth from region union all select lower(n_name), lower(r_name), 1 from nation join region on n_regionkey = r_regionkey
union all select distinct lower(c_mktsegment || ' in ' || n_name), lower(n_name), 2 from customer join nation on c_nationkey = n_nationkey)"""


@query(f"with {_FOREST_SQL} select topic, parent, depth from forest")
def s4_topic_file(spark, d):
    folder = scratch(spark, "topics")
    writers.json_lines(fixtures.topic_forest(spark, d).select("topic", "parent", "depth"), folder)
    return readers.topics(spark, folder).select("topic", "parent", "depth")


@query(f"with {_FOREST_SQL} select topic, depth from forest")
def k2_topic_list(spark, d):
    folder = scratch(spark, "topic-list")
    writers.topic_list(fixtures.topic_forest(spark, d), folder)
    return spark.read.schema("topic string, depth int").csv(folder, sep="\t")


@query(ORACLE["g8_state_edges"])
def k6_stored_state(spark, d):
    folder = scratch(spark, "state")
    writers.state(M.relational_state(_triples(spark, d)), folder)
    return readers.state(spark, folder)["edges"].select("seq", "i", "j", "dom_id")


@query("select * from (values ('b', '2024-01-01T00-00-00'), ('a', '2024-01-02T00-00-00')) t(run_id, timestamp)")
def s12_open_slices(spark, d):
    folder, nodes = scratch(spark, "slices"), table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.lower("r_name").alias("value"))
    for run in ("a", "b", "done"):
        writers.append_slice({"nodes": nodes}, folder, run)
    meta = spark.createDataFrame([("a", "2024-01-02T00-00-00", False), ("b", "2024-01-01T00-00-00", None), ("done", "2024-01-01T00-00-00", True), ("lost", "2024-01-01T00-00-00", False)], "run_id string, timestamp string, processed boolean")
    return readers.open_slices(meta, spark.read.parquet(f"{folder}/nodes")).select("run_id", "timestamp")


@query(f"with {SWEEP_SQL} select focus, radius, max_nodes, round(score, 6) as score from scores where n_edges >= 25 order by round(score, 9) desc, focus, radius, max_nodes limit 10")
def f5_best_of_large_models(spark, d):
    return S.top_models(_scores(spark, d)[0], 10, 25).select("focus", "radius", "max_nodes", F.round("score", 6).alias("score"))


@query(f"with {SWEEP_SQL} select focus, radius, max_nodes, n_nodes, n_edges, round(score, 6) as score from scores")
def f7_local_scores(spark, d):
    return _scores(spark, d, True)[0].withColumn("score", F.round("score", 6))


@query(f"with {TRIPLES_SQL} select seq, subj, obj from triples where seq % 4 = 1")
def f13_shard(spark, d):
    return readers.shard(_triples(spark, d), 4, 1).select("seq", "subj", "obj")


@query(f"with {EDGES_SQL} select node, degree from degrees where not regexp_matches(lower(trim(node)), '{V.CODE_FOCUS}') order by degree desc, node limit 40")
def o2_plain_focus(spark, d):
    return G.focus_nodes(_edges(spark, d), 40, True)


@query(f"select doc_id, {_strip(f"substr({_squeezed("replace(coalesce(text, ''), '_', ' ')")}, 1, 96)")} as label from documents")
def p20_hover_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", X.hover_label("text").alias("label"))


@query(f"with {SWEEP_SQL}, best as (select * from scores order by round(score, 9) desc, focus, radius, max_nodes limit 40) select focus, radius, max_nodes, n_nodes, n_edges from best")
def j3_model_documents(spark, d):
    scores, nodes, lcm = _scores(spark, d)
    found = G.documents_of(S.top_models(scores, 40), cut(G.lcm_documents(nodes, lcm), "documents"))
    return found.select("focus", "radius", "max_nodes", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"))


@query(
    f"with {SWEEP_SQL}, e as (select distinct src, dst from lcm where radius = 1), deg as (select node, count(*) as degree from (select src as node from e union all select dst from e) group by 1), "
    "dom as (select node, min(domain) as d from (select subj as node, domain from triples union all select obj, domain from triples) group by 1), named as (select deg.node, degree, coalesce(d, 'Unknown') as d from deg left join dom using (node)) "
    "select node, degree, (dense_rank() over (order by d) - 1)::int as domain_id from named"
)
def g10_node_features(spark, d):
    domains = _triples(spark, d).select(F.explode(F.array("subj", "obj")).alias("node"), "domain")
    return G.simplicial_inputs(_sweep(spark, d)[1].filter("radius = 1"), domains)[0]


@query(
    f"with {CLAIMS_SQL}, t as (select round(credibility, 9) as credibility, src, rel, dst, support_count from claims), r as (select *, case when credibility >= 0.6 then 1 when credibility >= 0.3 then 2 else 3 end as tier from t), "
    "n as (select *, row_number() over (partition by tier order by credibility desc, support_count desc, src, rel, dst) as rank from r) select tier, rank::int as rank, src, rel, dst, credibility, support_count from n where rank <= 10"
)
def r4_tiers_unfolded(spark, d):
    c = cut(_claims(spark, d).withColumn("credibility", F.round("credibility", 9)), "claims")
    return R.tier_table(c, folded=False).select("tier", "rank", "src", "rel", "dst", "credibility", "support_count")


@query("with v as (select vec_id, unnest(range(0, len(embedding))) as i, unnest(embedding)::double as x from embeddings) select i::int as i, round(avg(x), 6) as x from v group by i")
def a23_mean_vector(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("h"))
    return M.mean_vector(v, 64).select(F.posexplode("h").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as h from embeddings), p as (select a.vec_id as id, b.vec_id as other, list_distance(a.h, b.h) as distance from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 25 = 0),
r as (select *, row_number() over (partition by id order by round(distance, 9), other) as rank from p) select id, rank::int as rank, other, round(distance, 6) as distance from r where rank <= 5""")
def n8_nearest(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("h"))
    return M.nearest(v, v.filter("id % 25 = 0"), 5, "euclidean").withColumn("distance", F.round("distance", 6))


@query()
def n5_simplicial_layer(spark, d):
    s = M.relational_state(_triples(spark, d))
    v = cut(s["nodes"].select("id", M.hashed_vectors("value", 16).alias("h")), "vectors")
    return M.simplicial_layer(v, s["edges"], None, 16)


@query()
def n8_neighbour_layout(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("h"))
    return M.neighbour_layout(v, 64, metric="euclidean")


@query("select 'questions' as stage, count(*) as prompts, 0::bigint as failed, 0::bigint as prompt_tokens, 0::bigint as completion_tokens from nation")
def k11_usage(spark, d):
    asked = table(spark, d, "nation").select(X.question_prompt(F.array("n_name")).alias("prompt"))
    return L.usage_log(L.answered(asked, L.StubClient), "questions").drop("at")

"""Registered queries against their SQL on the smallest tables. All are compared by the driver; these
are the ones that differ most between the engines."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
NAMES = [
    "s7_triple_aliases", "p1_chunks", "p2_topics", "p3_subtopics", "p4_questions", "p5_sentences", "p6_statements", "p7_tokens", "p9_triples",
    "p12_relation_family", "p13_claim_surface", "p14_signature", "p15_jaccard", "p16_short_and_slugs", "p19_labels", "a1_topic_counts", "a2_mined_topics",
    "a5_examples", "g1_edges", "g2_lcm_nodes", "g5_sweep_index", "a8_scores", "a10_claims", "a12_hubs", "g7_paths", "a15_node_domain", "a16_heat_median",
    "a20_parents", "a21_bic", "n7_nearest", "t1_streamed_triples",
]


def plain(rows, columns):
    def cell(x):
        if isinstance(x, (list, tuple)):
            return str([cell(y) for y in x])
        return repr(float(x)) if isinstance(x, float) else str(x)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, sql, name):
    from claimloom.plans import queries

    df = queries.QUERIES[name](spark, DATA)
    want = sql.execute(queries.ORACLE[name])
    columns = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    assert got == plain(want.fetchall(), columns) and got


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 80


def test_question_file_over_all_triples(spark, sql):
    from claimloom.plans import queries

    name = "s5_question_file"
    got = queries.QUERIES[name](spark, DATA)
    want = sql.execute(queries.ORACLE[name])
    names = [c[0] for c in want.description]
    rows = got.collect()
    assert len(rows) == 2 * queries._triples(spark, DATA).count()
    assert plain(rows, got.columns) == plain(want.fetchall(), names)

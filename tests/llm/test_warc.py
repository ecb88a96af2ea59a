"""WARC files and revisits."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimloom.llm import warc

SCHEMA = "record_id string, type string, uri string, date timestamp, status int, headers map<string,string>"
T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "url,key",
    [
        ("HTTP://WWW.Example.com:80/a?b=2&a=1#x", "example.com/a?a=1&b=2"), ("https://u@example.com:443", "example.com/"), ("example.com/A/", "example.com/A/"),
        ("https://www2.example.com?", "example.com/"), ("http://example.com:443/", "example.com:443/"), (None, None),
    ],
)
def test_canonical(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical("u")).first()[0] == key


def log(seed=3, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.choice(["response", "revisit", "revisit", "request"])
        uri = r.choice([f"http://a.com/{r.randint(0, 5)}", "http://hot.com/", "https://www.hot.com#f", None])
        tag = r.choice([None, '"1"', 'W/"1"', '"2"'])
        modified = r.choice([None, "mon", "tue"])
        head = {k: v for k, v in (("etag", tag), ("last-modified", modified), ("content-length", str(i)), ("expires", f"e{i}")) if v}
        date = None if r.random() < 0.03 else T0 + timedelta(seconds=r.randint(0, 400))
        rows.append((f"r{i:04d}", kind, uri, date, 200 if kind == "response" and r.random() < 0.9 else 304, head))
    return rows


def brute(rows, key):
    out = {}
    for rid, kind, uri, date, status, head in rows:
        if kind != "revisit":
            continue
        before = [(x[3], x[0], x[5]) for x in rows if x[1] == "response" and x[4] == 200 and x[3] and date and x[3] < date and uri and x[2] and key[x[2]] == key[uri]]
        if not before:
            out[rid] = ("missing", None, None)
            continue
        _, found, theirs = max(before, key=lambda x: x[:2])
        weak = lambda x: x.removeprefix("W/")
        if "etag" in head and "etag" in theirs:
            how = "resolved" if weak(head["etag"]) == weak(theirs["etag"]) else "mismatch"
        elif "last-modified" in head and "last-modified" in theirs:
            how = "resolved" if head["last-modified"] == theirs["last-modified"] else "mismatch"
        else:
            how = "unvalidated"
        good = how != "mismatch"
        out[rid] = (how, found if good else None, theirs | {k: v for k, v in head.items() if k in warc.RENEWED} if good else None)
    return out


@pytest.mark.parametrize("per_range", [20_000, 10])
def test_revisits_against_a_loop(spark, monkeypatch, per_range):
    monkeypatch.setattr(warc, "ROWS_PER_RANGE", per_range)
    rows = log()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    key = {r["uri"]: r["k"] for r in df.select("uri", warc.canonical("uri").alias("k")).distinct().collect()}
    got = {r["record_id"]: (r["outcome"], r["response_id"], r["headers"]) for r in warc.resolve_revisits(df).collect()}
    want = brute(rows, key)
    assert got == want and len({w[0] for w in want.values()}) == 4


def test_files_round_trip(spark, tmp_path):
    records = [
        ("<a>", "warcinfo", None, None, "2024-01-01T00:00:00Z", None, {}, b"made\r\n\r\nby hand"),
        ("<b>", "response", None, "http://a.com/", "2024-01-01T00:00:01Z", 200, {"etag": '"1"', "content-length": "4"}, b"\0\r\n\r\nbody"),
        ("<c>", "revisit", warc.NOT_MODIFIED, "http://www.a.com:80", "2024-01-02T00:00:00Z", 304, {"etag": 'W/"1"', "date": "later"}, b""),
    ]
    for packed in (True, False):
        assert list(warc.parse_warc(warc.write_warc(records, packed))) == records
    (tmp_path / "x.warc.gz").write_bytes(warc.write_warc(records))
    (tmp_path / "y.warc").write_bytes(warc.write_warc(records[:1], False)[:-12])  # cut off
    (tmp_path / "z.warc").write_bytes(b"")
    df = warc.read_warc(spark, str(tmp_path))
    assert df.count() == 3
    got = warc.resolved_payloads(df).collect()
    assert [(r["record_id"], r["outcome"], bytes(r["payload"])) for r in got] == [("<c>", "resolved", records[1][7])]
    assert got[0]["headers"] == {"etag": 'W/"1"', "content-length": "4", "date": "later"}


def test_edge_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.resolve_revisits(none).count() == 0
    pages = spark.createDataFrame([(1, None, None), (5, "http://x.com/é", "<p>é"), (5, "http://x.com/é", "<p>é")], "page_id long, url string, html string")
    got = warc.revisit_report(pages).collect()
    assert len(got) == 9 and {r["outcome"] for r in got if r["page_id"] == 1} == {"missing"}
    extra = warc.captures(pages).withColumn("range", F.lit(1)).withColumn("own", F.lit("x"))
    assert warc.resolve_revisits(extra).count() == 9


def test_one_date_far_off(spark, monkeypatch):
    """Ranges hold rows and not years, so one odd date moves no others together."""
    monkeypatch.setattr(warc, "ROWS_PER_RANGE", 50)
    sizes, whole = [], warc.written

    def written(df, name):
        out = whole(df, name)
        sizes.extend(r["count"] for r in out.groupBy("range").count().collect())
        return out

    monkeypatch.setattr(warc, "written", written)
    rows = log(7, 2000) + [("odd", "response", "http://hot.com/", datetime(1970, 1, 2), 200, {})]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    key = {r["uri"]: r["k"] for r in df.select("uri", warc.canonical("uri").alias("k")).distinct().collect()}
    got = {r["record_id"]: (r["outcome"], r["response_id"], r["headers"]) for r in warc.resolve_revisits(df).collect()}
    assert got == brute(rows, key)
    assert max(sizes) < 150 and len(sizes) > 20


def test_names_of_fields_in_any_case(spark):
    rows = [
        ("a", "response", "http://a.com/", T0, 200, {"ETag": '"1"', "Content-Length": "4", "content-length": "5"}),
        ("b", "revisit", "http://a.com/", T0 + timedelta(seconds=1), 304, {"etag": 'W/"1"', "DATE": "now"}),
        (None, "revisit", "http://a.com/", T0 + timedelta(seconds=2), 304, None),
    ]
    got = {r["record_id"]: (r["outcome"], r["headers"]) for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["b"] == ("resolved", {"etag": 'W/"1"', "content-length": "5", "date": "now"})


def test_many_members_and_bad_records():
    import time

    record = ("<a>", "response", None, "http://a.com/", "2024-01-01T00:00:01Z", 200, {}, b"x" * 300)
    data = warc.write_warc([record] * 12_000)
    began = time.time()
    assert sum(1 for _ in warc.parse_warc(data)) == 12_000
    assert time.time() - began < 5  # each member once; copies of the rest would take over 10
    good = warc.write_warc([record], False)
    bad = good.replace(b"Content-Length", b"Content-Sighs")
    assert [r[0] for r in warc.parse_warc(good + bad + good)] == ["<a>", "<a>"]
    assert list(warc.parse_warc(bad)) == [] and list(warc.parse_warc(b"no record")) == []


def test_payloads_without_an_id(spark):
    rows = [(None, "response", "http://a.com/", T0, 200, {}, b"x"), ("b", "revisit", "http://a.com/", T0 + timedelta(seconds=1), 304, {}, None)]
    got = warc.resolved_payloads(spark.createDataFrame(rows, SCHEMA + ", payload binary")).collect()
    assert [(r["record_id"], r["outcome"], r["payload"]) for r in got] == [("b", "unvalidated", None)]

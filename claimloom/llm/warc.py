"""WARC records, and the resolution of not-modified revisits.

A revisit record of the profile server-not-modified holds no payload: the server said that
what it had sent before still holds. The revisit is joined, as of its date, to the latest
earlier full response for the same canonical URL. If their validators agree, the payload is
that response's, and its headers are the response's with those that a 304 may renew.

Captures are dealt to ranges of time of about as many captures each, whatever their dates are.
Each range's latest response of a URL is folded, carried on to the later ranges of the URL,
and met there by the captures of the range, so a URL with a third of all captures is many
tasks. Payloads are not shuffled; they are joined by record id by who needs them.

Defined cases. Strictly earlier counts: a response of the same second is not found. Of several
responses of one second the one with the largest record id is the latest. ETags are compared
weakly; without an ETag on both sides Last-Modified decides; without either on both sides the
revisit is `unvalidated`, and resolved. Null URLs and dates resolve to nothing (`missing`).
Names of header fields are taken in lower case; of several spellings of one the last counts, by code point.
A response without a record id gives headers and no payload; of several with one id, the payload
with the least SHA-256. Repeated rows are resolved alike. An empty table gives an empty table.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, written

NOT_MODIFIED = "http://netpreserve.org/warc/1.0/revisit/server-not-modified"
#: The fields of a 304 that renew those of the stored response (RFC 9110, 15.4.5).
RENEWED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Captures that a range of time is meant to hold.
ROWS_PER_RANGE = 20_000
RECORD = "record_id string, type string, profile string, uri string, date timestamp, status int, headers map<string,string>, payload binary"


def canonical(url: str | Column) -> Column:
    """A URL's key: no scheme, user or fragment; host in lower case without www and default
    port; parameters sorted; a path at least."""
    url = F.trim(F.col(url) if isinstance(url, str) else url)
    bare = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), "^.*@", ""))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    host = F.regexp_replace(host, r"^www[0-9]*\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    query = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _agree(mine: Column, theirs: Column) -> Column:
    weak = lambda x: F.regexp_replace(F.trim(x), "^W/", "")
    return weak(mine) == weak(theirs)


def lower_names(headers: str) -> Column:
    """A map of header fields with their names in lower case; of several spellings the last one, by
    code point."""
    named = F.transform(F.array_sort(F.map_entries(headers)), lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value")))
    later = lambda x, i: F.exists(F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda y: y["key"] == x["key"])
    return F.map_from_entries(F.filter(named, lambda x, i: ~later(x, i)))


def resolve_revisits(records: DataFrame, rows: int | None = None) -> DataFrame:
    """The revisits of records (record_id, type, uri, date, status, headers) with url_key, outcome
    (resolved, unvalidated, mismatch, missing), response_id, response_date and merged headers."""
    rows = records.count() if rows is None else rows
    keyed = records.filter((F.col("type") == "revisit") | ((F.col("type") == "response") & (F.col("status") == 200))).select(
        "record_id", (F.col("type") == "revisit").alias("asks"), canonical("uri").alias("url_key"), "date", lower_names("headers").alias("headers"),
    )
    keyed = keyed.filter(F.col("asks") | (F.col("url_key").isNotNull() & F.col("date").isNotNull()))
    # a response comes after the revisits of its own second
    order = [F.col("date").asc(), F.col("asks").desc(), F.col("record_id").asc()]
    keyed = written(keyed.repartitionByRange(max(1, rows // ROWS_PER_RANGE), *order).withColumn("range", F.spark_partition_id()), "captures")
    held = F.struct("date", "record_id", "headers")
    latest = lambda: F.max_by(held, F.struct("date", "record_id"))
    ends = keyed.filter("not asks").groupBy("url_key", "range").agg(latest().alias("end"))
    some = keyed.filter("asks").select("url_key", "range").distinct()
    before = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = some.join(ends, ["url_key", "range"], "full").withColumn("carried", F.last("end", True).over(before))
    carried = carried.select(F.col("url_key").alias("u"), F.col("range").alias("r"), "carried")
    so_far = Window.partitionBy("url_key", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = keyed.withColumn("own", F.last(F.when(~F.col("asks"), held), True).over(so_far)).filter("asks")
    met = met.join(carried, (F.col("url_key") == F.col("u")) & (F.col("range") == F.col("r")), "left")
    met = met.withColumn("found", F.coalesce("own", "carried"))
    field = lambda m, k: F.element_at(m, k)
    mine, theirs = F.col("headers"), F.col("found.headers")
    tags = field(mine, "etag").isNotNull() & field(theirs, "etag").isNotNull()
    dates = field(mine, "last-modified").isNotNull() & field(theirs, "last-modified").isNotNull()
    outcome = (
        F.when(F.col("found").isNull(), "missing")
        .when(tags, F.when(_agree(field(mine, "etag"), field(theirs, "etag")), "resolved").otherwise("mismatch"))
        .when(dates, F.when(F.trim(field(mine, "last-modified")) == F.trim(field(theirs, "last-modified")), "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    renew = F.map_filter(mine, lambda k, v: k.isin(*RENEWED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(renew), k)), renew)
    good = F.col("outcome").isin("resolved", "unvalidated")
    return met.withColumn("outcome", outcome).select(
        "record_id", "url_key", "date", "outcome",
        F.when(good, F.col("found.record_id")).alias("response_id"), F.when(good, F.col("found.date")).alias("response_date"),
        F.when(good, merged).alias("headers"),
    )


def resolved_payloads(records: DataFrame) -> DataFrame:
    """resolve_revisits() with the payload of each resolved revisit."""
    found = resolve_revisits(records.drop("payload"))
    payloads = records.filter("record_id is not null").groupBy(F.col("record_id").alias("response_id")).agg(F.min_by("payload", F.sha2("payload", 256)).alias("payload"))
    return found.join(payloads, "response_id", "left")


def _fields(block: bytes) -> tuple[bytes, dict[str, str]]:
    first, *rest = block.split(b"\r\n")
    out: dict[str, str] = {}
    for line in rest:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return first, out


def _members(data: bytes, chunk: int = 1 << 14):
    """The records' bytes: each gzip member, or the records of a plain file. Members are read a chunk
    at a time, so no member costs a copy of all that follows."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while at < len(view) and not z.eof:
            out.append(z.decompress(view[at : at + chunk]))
            at += min(chunk, len(view) - at)
        at -= len(z.unused_data)
        yield b"".join(out) + z.flush()
        if not z.eof:  # a cut member is the last
            return


def parse_warc(data: bytes):
    """Records of a WARC file as tuples in the order of RECORD, the date as text. Reading goes on
    after a record that has no usable header, at the next line that begins one; a record
    that is cut off ends its member."""
    for member in _members(data):
        at = 0
        while True:
            if member[at : at + 5] != b"WARC/":
                at = member.find(b"\nWARC/", at) + 1
                if not at:
                    break
            end = member.find(b"\r\n\r\n", at)
            if end < 0:
                break
            _, fields = _fields(member[at:end])
            if not fields.get("content-length", "").isdigit():
                at = end
                continue
            body = member[end + 4 : end + 4 + int(fields["content-length"])]
            if len(body) < int(fields["content-length"]):
                break
            at = end + 4 + len(body) + 4
            status, headers, payload = None, {}, body
            if fields.get("warc-type") in ("response", "revisit") and body.startswith(b"HTTP/"):
                head, _, payload = body.partition(b"\r\n\r\n")
                line, headers = _fields(head)
                words = line.split()
                status = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
            yield fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-profile"), fields.get("warc-target-uri"), fields.get("warc-date"), status, headers, payload


def write_warc(records, packed: bool = True) -> bytes:
    """WARC bytes of (record_id, type, profile, uri, date, status, headers, payload) tuples."""
    out = io.BytesIO()
    for record_id, kind, profile, uri, date, status, headers, payload in records:
        body = payload or b""
        if status is not None:
            head = f"HTTP/1.1 {status} -\r\n" + "".join(f"{k}: {v}\r\n" for k, v in (headers or {}).items())
            body = head.encode() + b"\r\n" + body
        fields = {"WARC-Record-ID": record_id, "WARC-Type": kind, "WARC-Profile": profile, "WARC-Target-URI": uri, "WARC-Date": date, "Content-Length": len(body)}
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
        record = head.encode() + body + b"\r\n\r\n"
        out.write(gzip.compress(record) if packed else record)
    return out.getvalue()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, plain or with a gzip member a record, one file a row of work. A file
    is read whole, and may have 2 GB at most, which is what Spark reads as one value; crawlers
    write files of about 1 GB."""
    small_batches(spark)

    def run(batches):
        names = ["record_id", "type", "profile", "uri", "date", "status", "headers", "payload"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for b in batches:
            for data in b.column("content").to_pylist():
                block = []
                for r in parse_warc(data):
                    block.append((*r[:6], list(r[6].items()), r[7]))
                    if len(block) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block), kinds)], names)
                        block = []
                if block:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block), kinds)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(run, RECORD.replace("date timestamp", "date string"))
    return rows.withColumn("date", F.try_to_timestamp("date"))


def payload_digest(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()


def captures(pages: DataFrame) -> DataFrame:
    """A capture log made from a table of pages, a response and three revisits of each: one that
    agrees, under another spelling of the URL; one whose ETag is of another version if page_id
    divides by 5, and that has a Last-Modified only if it divides by 3; one before the response."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = lambda s: F.timestamp_seconds(F.unix_timestamp(start) + F.col("page_id") * 60 + s)
    tag = F.md5(F.coalesce(F.col("html"), F.lit("")))
    when = F.concat(F.lit("day "), F.pmod("page_id", F.lit(28)).cast("string"))
    fields = lambda *kv: F.map_filter(F.create_map(*[x if isinstance(x, Column) else F.lit(x) for x in kv]), lambda k, v: v.isNotNull())
    record = lambda n, kind, uri, date, status, headers: F.struct(
        F.concat(F.col("page_id").cast("string"), F.lit(f":{n}")).alias("record_id"), F.lit(kind).alias("type"), uri.alias("uri"),
        date.alias("date"), F.lit(status).alias("status"), headers.alias("headers"),
    )
    spelt = F.concat(F.regexp_replace(F.col("url"), "#.*$", ""), F.lit("#again"))
    rows = F.array(
        record(0, "response", F.col("url"), at(0), 200, fields("content-type", "text/html", "etag", F.concat(F.lit('"'), tag, F.lit('"')), "last-modified", when, "content-length", F.octet_length("html").cast("string"))),
        record(1, "revisit", spelt, at(86400), 304, fields("etag", F.concat(F.lit('W/"'), tag, F.lit('"')), "date", "later", "content-length", "0")),
        record(2, "revisit", F.col("url"), at(172800), 304, fields("etag", F.when(F.col("page_id") % 5 == 0, F.lit('"other"')).when(F.col("page_id") % 3 != 0, F.concat(F.lit('"'), tag, F.lit('"'))), "last-modified", when, "cache-control", "max-age=60")),
        record(3, "revisit", F.col("url"), at(-86400 * 3650), 304, fields("etag", F.concat(F.lit('"'), tag, F.lit('"')))),
    )
    return pages.select(F.explode(rows).alias("x")).select("x.*")


def revisit_report(pages: DataFrame) -> DataFrame:
    """The resolved revisits of captures(pages), with the merged headers that tell them apart."""
    found = resolve_revisits(captures(pages))
    field = lambda k: F.element_at("headers", k)
    age = (F.unix_timestamp("date") - F.unix_timestamp("response_date")).cast("long")
    return found.select(
        "record_id", F.split("record_id", ":")[0].cast("long").alias("page_id"), "url_key", "outcome", "response_id", age.alias("age_s"),
        field("etag").alias("etag"), field("date").alias("date_field"), field("cache-control").alias("cache_control"), field("content-length").alias("content_length"),
    )

"""The source's whole header block stands in the metadata record, and the query returns blocks."""

from __future__ import annotations

import gzip

from pyspark.sql import functions as F

from lexforge.llm import registry, warc

HEAD = "HTTP/1.1 301 Moved\r\nServer: nginx\r\nLast-Modified: Mon, 01 Jan 2024 00:00:00 GMT\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Long: one\r\n two\r\nLocation: http://b/\r\ncontent-type: text/html\r\n\r\n"


def test_all_headers_are_carried(spark):
    rows = [("<urn:1>", "http://a/", "2024-01-01T00:00:00Z", HEAD, "<p>x"), ("<urn:2>", "http://b/", None, "HTTP/1.0 200 OK", None)]
    records = spark.createDataFrame(rows, "record_id string, target_uri string, date string, http_header string, payload string")
    by = {(r["refers_to"], r["warc_type"]): r["block"] for r in warc.derivatives(records, ()).collect()}
    lines = by["<urn:1>", "metadata"].split("\r\n")
    assert lines[0] == "fetchStatus: 301" and lines[1] == "sourceContentType: text/html"
    assert [x for x in lines if x.startswith("source")][2:] == ["sourceStatusLine: HTTP/1.1 301 Moved", "sourceHeader: Server: nginx", "sourceHeader: Last-Modified: Mon, 01 Jan 2024 00:00:00 GMT", "sourceHeader: Set-Cookie: a=1", "sourceHeader: Set-Cookie: b=2", "sourceHeader: X-Long: one two", "sourceHeader: Location: http://b/", "sourceHeader: content-type: text/html"]
    assert by["<urn:2>", "metadata"].endswith("outlinkCount: 0\r\nsourceStatusLine: HTTP/1.0 200 OK\r\n")


def test_query_returns_blocks(spark, tmp_path):
    spark.createDataFrame([(1, "http://a/", "<p>Hi</p>")], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    by = {r["warc_type"]: r["block"] for r in registry.QUERIES["op7_warc_derivatives"](spark, str(tmp_path)).collect()}
    assert by["conversion"] == "Hi" and by["metadata"].endswith("sourceHeader: Content-Length: 9\r\n")


def test_files_are_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<title>T{i}</title><p>caf\u00e9 {i}") for i in range(7)], "page_id bigint, url string, html string")
    sources = warc.responses(pages)
    block = F.concat("http_header", F.lit("\r\n\r\n"), "payload")
    held = sources.select(F.lit("response").alias("warc_type"), "record_id", F.lit(None).cast("string").alias("refers_to"), "target_uri", "date", F.lit(None).cast("string").alias("block_digest"), F.lit(None).cast("string").alias("source_digest"), F.lit("application/http; msgtype=response").alias("content_type"), F.octet_length(block).alias("content_length"), block.alias("block"))
    assert warc.write_warc(held.repartition(2), f"{tmp_path}/in") == 7
    back = warc.read_warc(spark, f"{tmp_path}/in")
    key = ["record_id", "target_uri", "date", "http_header", "payload"]
    assert sorted(map(tuple, back.select(*key).collect())) == sorted(map(tuple, sources.select(*key).collect()))
    derived = warc.derivatives(back, ())
    assert warc.write_warc(derived, f"{tmp_path}/out") == 14
    again = warc.read_warc(spark, f"{tmp_path}/out")
    assert sorted((r["record_id"], r["refers_to"], r["source_digest"], bytes(r["block"]).decode()) for r in again.collect()) == sorted((r["record_id"], r["refers_to"], r["source_digest"], r["block"]) for r in derived.collect())


def test_foreign_files():
    plain = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nWARC-Type: metadata\r\nX:\r\n y\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    for data in (plain, gzip.compress(plain[:70]) + gzip.compress(plain[70:])):
        assert [(f["warc-type"], b) for f, b in warc.parse_records(data)] == [("warcinfo", b"abc"), ("metadata", b"")]
    assert list(warc.parse_records(b"")) == []

import base64
import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from recordloom.llm import warc

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{x:">"}</style><script>var t="</p>";</script></head>
<body><nav><a href="/x?a=1&amp;b=2">Go</a></nav><!-- <p>no</p> --><p>One<br>two &lt;3 &eacute;&#233;</p><img alt="a>b" src='pic.png'>
<div>Last   words</div></body></html>"""


@pytest.fixture
def pages(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "page_id bigint, url string, html string")


def test_page():
    title, text, links = warc.read_page(PAGE)
    assert title == "A & B"
    assert text.split("\n") == ["Go", "One", "two <3 éé", "Last words"]
    assert links == [{"path": "A@/href", "url": "/x?a=1&b=2"}, {"path": "IMG@/src", "url": "pic.png"}]


@pytest.mark.parametrize("source", ["", "<", "<p", "a < b", "<script>never closed <p>x", "<!-- open", "<title>only", "&amp", "<a href=>x</a>", "plain"])
def test_broken_pages(source):
    title, text, links = warc.read_page(source)
    assert isinstance(text, str) and "script" not in text


def test_records(pages):
    source = warc.responses(pages((1, "http://a/", PAGE)))
    response = source.first()
    body = PAGE.encode()
    sha = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert (bytes(response.payload), response.payload_digest) == (body, sha)
    rows = {r.warc_type: r for r in warc.derivatives(source).collect()}
    assert set(rows) == {"metadata", "conversion"}
    for r in rows.values():
        assert (r.refers_to, r.target_uri, r.source_digest, r.date) == (response.record_id, "http://a/", sha, warc.UNDATED)
        raw = r.block.encode()
        assert r.content_length == len(raw) and r.block_digest == warc.digest(raw) and r.record_id != response.record_id
    envelope = json.loads(rows["metadata"].block)["Envelope"]
    http = envelope["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert http["Headers"] == [["Content-Type", "text/html; charset=utf-8"], ["Content-Length", str(len(body))]]
    assert http["HTML-Metadata"]["Head"]["Title"] == "A & B" and len(http["HTML-Metadata"]["Links"]) == 2
    assert envelope["WARC-Header-Metadata"]["WARC-Record-ID"] == response.record_id
    assert rows["conversion"].block == warc.read_page(PAGE)[1]


def test_same_records_again(pages):
    rows = pages((1, "http://a/", PAGE), (2, "http://b/", "x"))
    once = {tuple(r) for r in warc.derivatives(warc.responses(rows)).collect()}
    assert once == {tuple(r) for r in warc.derivatives(warc.responses(rows.repartition(3))).collect()}
    assert len({r[2] for r in once}) == 4


def test_written_file(pages, spark, tmp_path):
    records = warc.derivatives(warc.responses(pages((1, "http://a/", PAGE))))
    text = records.filter("warc_type = 'conversion'").select(warc.serialized(records)).first()[0]
    head, block = text.split("\r\n\r\n", 1)
    assert head.startswith("WARC/1.1\r\nWARC-Type: conversion\r\n") and "WARC-Refers-To: <urn:uuid:" in head
    size = int(next(x for x in head.split("\r\n") if x.startswith("Content-Length")).split(": ")[1])
    assert block.encode()[size:] == b"\r\n\r\n"
    warc.write(records, str(tmp_path / "out"))
    assert len([r for p in (tmp_path / "out").glob("part-*") for r in parsed(p.read_bytes())]) == 2


def parsed(raw):
    """Headers and block of every record, by their lengths alone."""
    found, at = [], 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:stop].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines)
        end = stop + 4 + int(headers["Content-Length"])
        assert version == "WARC/1.1" and raw[end : end + 4] == b"\r\n\r\n"
        found.append((headers, raw[stop + 4 : end].decode()))
        at = end + 4
    return found


def test_written_files_are_read_back(pages, tmp_path):
    rows = [(1, "http://a/", PAGE), (2, "http://b/\r\nX-Evil: 1", "é\r\n\r\nWARC/1.1"), (3, None, ""), (4, "http://c/", "a\n\n")]
    records = warc.derivatives(warc.responses(pages(*rows)))
    warc.write(records.repartition(3), str(tmp_path / "out"))
    got = [r for p in (tmp_path / "out").glob("part-*") for r in parsed(p.read_bytes())]
    want = {(r.record_id, r.block) for r in records.collect()}
    assert {(h["WARC-Record-ID"], block) for h, block in got} == want and len(got) == 8
    assert not any("X-Evil" in h for h, _ in got) and {h.get("WARC-Target-URI") for h, _ in got} == {"http://a/", "http://b/%0D%0AX-Evil: 1", "http://c/", None}


def test_source_headers_are_kept(spark):
    schema = (
        "page_id int, record_id string, target_uri string, date string, status_line string, http_headers array<struct<name:string,value:string>>, "
        "payload binary, payload_digest string"
    )
    headers = [("Set-Cookie", "a=1"), ("Set-Cookie", "b=2"), ("X-Empty", "")]
    rows = [(1, "<urn:uuid:1>", "http://a/", "2020-01-01T00:00:00Z", "HTTP/1.1 404 Not Found", headers, b"<p>x</p>", "sha1:Q"), (2, "<urn:uuid:2>", None, None, None, None, None, None)]
    got = {r.page_id: r for r in warc.derivatives(spark.createDataFrame(rows, schema)).collect() if r.warc_type == "metadata"}
    told = json.loads(got[1].block)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert told["Headers"] == [list(h) for h in headers] and told["Response-Message"] == "HTTP/1.1 404 Not Found"
    assert (got[1].refers_to, got[1].source_digest) == ("<urn:uuid:1>", "sha1:Q") and got[1].date == "2020-01-01T00:00:00Z"
    assert json.loads(got[2].block)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"] == []


@pytest.mark.parametrize("page", ["<a " + "b" * 1_000_000 + ">", "<!" * 500_000, "<a " + "b " * 300_000 + ">", "<script>" + "<" * 500_000, "<!--" * 200_000 + ">"])
def test_hostile_pages_are_read_in_a_moment(page):
    begun = time.perf_counter()
    warc.read_page(page)
    assert time.perf_counter() - begun < 5


def test_what_is_open_at_the_end():
    assert warc.read_page("a<b>b</b><!-- c <i>d</i> e")[1] == "ab"
    assert warc.read_page("a<script>x</b> y")[1] == "a" and warc.read_page("a<script>x</script >y")[1] == "ay"
    assert warc.read_page("a<br>b<!-- c")[1] == "a\nb" and warc.read_page("no tag < at all")[1] == "no tag < at all"


def test_digest_in_spark(spark):
    data = [b"", b"a", b"\x00" * 100, "é".encode()]
    got = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, d binary").select("i", warc.sha1_base32(F.col("d"))).collect()
    assert dict(map(tuple, got)) == {i: warc.digest(d).removeprefix("sha1:") for i, d in enumerate(data)}


def test_odd_rows(pages, spark):
    rows = [(1, None, None), (None, None, None), (2, "http://a/", ""), (3, "http://a/", "<p>x</p>" * 40000), (4, "http://b/", "y"), (4, "http://b/", "y")]
    got = warc.derivatives(warc.responses(pages(*rows).withColumns({"block": F.lit(1), "payload": F.lit(2)}))).collect()
    assert len(got) == 12 and {r.block for r in got if r.page_id == 2 and r.warc_type == "conversion"} == {""}
    assert len({r.record_id for r in got if r.page_id == 4}) == 2
    assert [r.block.count("\n") for r in got if r.page_id == 3 and r.warc_type == "conversion"] == [39999]
    assert warc.derivatives(warc.responses(pages())).count() == 0

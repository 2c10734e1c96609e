import json
import re

from plumage.llm import warc as W


def test_records_round_trip_and_refer(spark):
    page = "<html><head><title>T &amp; t</title><meta name=d content='x'></head><body><!-- no --><script>var a='<p>';</script><nav><a href='/x'>X</a></nav><p>Hello <b>big</b>&nbsp;world<br>two</p><img src=i.png></body>"
    pages = spark.createDataFrame([(1, "http://h/p/", page), (2, None, None), (2, None, None), (3, "http://h/\r\nq", ""), (None, "u", "x < y > z")], "page_id long, url string, html string")
    responses = {r.page_id: r.record for r in W.responses_of_pages(pages).collect()}
    rows = W.derivatives(W.responses_of_pages(pages)).collect()
    assert len(rows) == 10
    for r in rows:
        headers, block = W.parse_record(bytes(r.record))
        headers = dict(headers)
        source, response = W.parse_record(bytes(responses[r.page_id]))
        source = dict(source)
        assert headers["WARC-Refers-To"] == source["WARC-Record-ID"] == r.refers_to and headers["WARC-Date"] == source["WARC-Date"]
        assert headers["WARC-Block-Digest"] == W.sha1_digest(block) == r.block_digest and len(block) == r.content_length
        assert r.source_payload_digest == source["WARC-Payload-Digest"] == W.sha1_digest(W.split_http(response)[1])
        assert W.record_bytes(list(headers.items()), block) == bytes(r.record)
    by = {(r.page_id, r.record_type): r for r in rows}
    assert by[1, "metadata"].concurrent_to == by[1, "conversion"].record_id and by[1, "conversion"].concurrent_to == by[1, "metadata"].record_id
    text = W.parse_record(bytes(by[1, "conversion"].record))[1].decode()
    assert text == "X\nHello big world\ntwo"
    meta = json.loads(W.parse_record(bytes(by[1, "metadata"].record))[1])["Envelope"]
    assert meta["HTML-Metadata"] == {"Title": "T & t", "Metas": [{"name": "d", "content": "x"}], "Links": [{"path": "a", "url": "http://h/x"}, {"path": "img", "url": "http://h/p/i.png"}]}
    assert ["WARC-Type", "response"] in meta["WARC-Headers"] and ["Content-Type", "text/html; charset=utf-8"] in meta["HTTP-Headers"]


def test_malformed_records_stay_visible(spark):
    rows = [(1, None), (2, b"junk"), (3, b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"), (4, b"WARC/1.1\r\n\r\n")]
    out = W.derivatives(spark.createDataFrame(rows, "page_id long, record binary")).collect()
    assert [(r.page_id, r.record_type, r.record) for r in out] == [(i, "malformed", None) for i in range(1, 5)]
    assert W.derivatives(spark.createDataFrame([], "page_id long, record binary")).count() == 0


def test_other_charsets():
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<p>caf\xe9"
    record = W.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("Content-Length", str(len(block)))], block)
    assert W.parse_record(W.derived(record)[1][-1])[1].decode() == "café"
    assert W.charset_of("content-type: x; charset=nonsense") == "utf-8"


def test_text_against_a_parser():
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "head")
            self.out.append("\n" if tag in W._BLOCKS else "")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "head")
            self.out.append("\n" if tag in W._BLOCKS else "")

        def handle_data(self, data):
            self.out.append("" if self.off else data)

    import glob

    import pyarrow.parquet as pq

    for page in pq.read_table(glob.glob("/root/testdata/sf0.001/pages.parquet")[0]).column("html").to_pylist():
        reader = Reader()
        reader.feed(page)
        reader.close()
        expected = "\n".join(x for x in (" ".join(line.split()) for line in "".join(reader.out).split("\n")) if x)
        assert re.sub(r"\s+", " ", W.text_of(page)) == re.sub(r"\s+", " ", expected)


def test_open_elements_keep_the_text_after_them():
    for page, text in (
        ("<html><head><title>T</title><body><p>Hello world", "Hello world"), ("<head><meta content='a > b'><title>x < y</title><link href=a><p>Hi</p></body>", "Hi"), ("<head>\n<script>1</script><noscript><img></noscript><title>T</title>Text", "Text"),
        ("<head><title>T</title></head><p>a</p><svg><p>b</p>", "a\nb"), ("<p>a<template><p>b<svg>c</svg>d", "a\nb d"), ("<p>a<noscript>b", "ab"), ("a<svg/>b<svg><svg>c</svg>d</svg>e", "ab e"),
        ("<template>a<svg></template>b</svg>c", "bc"), ("<header>a</header><head-line>b</head-line>", "a\nb"), ("a<script>b", "a"), ("a<style>b", "a"), ("a<!-- b", "a"),
    ):
        assert W.text_of(page) == text
    import time

    began = time.time()
    for page in ("<head><title>" * 30_000, "<svg>" * 60_000 + "</svg>" * 60_000, "<head><meta a=\"" * 20_000, "<template><svg>" * 30_000):
        W.text_of(page)
    assert time.time() - began < 60


def test_hostile_markup_is_fast():
    import time

    began = time.time()
    for page in ("<a href=\"" * 30_000, "<" * 300_000, "<!--" * 50_000, "<script>" * 30_000, "<a " + "b='c' " * 50_000, "&amp" * 100_000):
        W.text_of(page)
        W.page_metadata(page, "http://h/")
    assert time.time() - began < 60


def response(http, payload, *headers, kind="response"):
    block = ("HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in http) + "\r\n").encode() + payload
    return W.record_bytes([("WARC-Type", kind), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://a/b"), *headers, ("content-length", str(len(block)))], block)


def test_codings_charsets_and_headers():
    import gzip
    import zlib

    page = "<html><body><p>déjà vu</p></body></html>".encode()
    text = lambda record: W.parse_record(W.derived(record)[1][-1])[1].decode()
    kind = ("Content-Type", "text/html; charset=utf-8")
    chunks = b"7;x=1\r\n" + page[:7] + b"\r\n" + f"{len(page) - 7:x}".encode() + b"\r\n" + page[7:] + b"\r\n0\r\n\r\n"
    for http, payload in [([], page), ([("Content-Encoding", "gzip")], gzip.compress(page)), ([("content-encoding", "deflate")], zlib.compress(page)), ([("Transfer-Encoding", "chunked")], chunks), ([("Content-Encoding", "br")], page), ([("Content-Encoding", "gzip")], page), ([("Transfer-Encoding", "chunked")], page)]:
        assert text(response([kind, *http], payload)) == "déjà vu"
    for name in ("hex", "rot13", "base64", "zip", "none-such", "utf-16"):
        assert len(W.derived(response([("Content-Type", f"text/html; charset={name}")], page))) == 2
    twice = [("WARC-Concurrent-To", "<urn:uuid:2>"), ("WARC-Concurrent-To", "<urn:uuid:3>"), ("X", "a\r\n  b")]
    envelope = json.loads(W.parse_record(W.derived(response([kind], page, *twice))[0][-1])[1])["Envelope"]
    assert [h for h in envelope["WARC-Headers"] if h[0] in ("WARC-Concurrent-To", "X")] == [["WARC-Concurrent-To", "<urn:uuid:2>"], ["WARC-Concurrent-To", "<urn:uuid:3>"], ["X", "a b"]]
    assert W.derived(response([kind], page, kind="request")) == []


def test_hostile_pages_of_a_megabyte_take_seconds():
    import time

    for part in ("<title>", "<title ", "<script ", "<style\n", "<svg ", "<head ", "<template ", "<!", "<!--", "<a href=\"", "<a ", "<meta charset=", "</title", "<script>a</script ", "<head><title>x</head "):
        page = part * (1_000_000 // len(part))
        for text in (page, page + ">", "<html>" + page + "<p>end</p>"):
            began = time.process_time()
            W.text_of(text)
            W.page_metadata(text, "http://h/")
            W.charset_of("", text.encode())
            assert time.process_time() - began < 6, part  # a review asked for 2 s; machines here are up to 3 times slower


def test_what_follows_the_last_tag():
    for page, text in (("a<script>b</script>c <script d", "a c <script d"), ("a<!-- b > c", "a"), ("a<p>b<!-- c", "a\nb"), ("a<script>b > c", "a"), ("<b>x</b> 1 < 2", "x 1 < 2"), ("no tags", "no tags"), ("a<style>x</style>", "a"), ("a<!---->b", "a b"), ("a<!-->b", "a")):
        assert W.text_of(page) == text, page
    meta = lambda page: W.page_metadata(page, "http://h/")
    assert meta("<title>a<title>b</title>")["Title"] == "a<title>b" and meta("<title>a")["Title"] is None and meta("<title></title>")["Title"] == "" and meta("<titled>x</titled>")["Title"] is None
    assert meta("<TITLE x='1'> a  b </Title >")["Title"] == "a b"


def test_members_meta_charset_and_types():
    import gzip

    body = lambda record, i=1: W.parse_record(W.derived(record)[i][-1])[1]
    two = gzip.compress(b"<p>hello ") + gzip.compress(b"world</p>")
    assert body(response([("Content-Encoding", "gzip")], two)) == b"hello world" == body(response([("Content-Encoding", "gzip")], two + b"\0\0"))
    assert W.decoded_payload([("Content-Encoding", "gzip")], two[:-4]) == two[:-4]
    page = "<html><head><meta charset='gbk'></head><body>\u6c34\u9e1f</body>"
    assert body(response([], page.encode("gbk"))).decode() == "\u6c34\u9e1f"
    assert body(response([("Content-Type", "text/html; charset=utf-8")], page.encode())).decode() == "\u6c34\u9e1f"  # the header counts first
    assert body(response([], page.replace("gbk", "none-such").encode())).decode() == "\u6c34\u9e1f"
    (only,) = W.derived(response([("Content-Type", "image/png")], b"\x89PNG\r\n"))
    assert only[0] == "metadata" and only[3] is None and json.loads(W.parse_record(only[-1])[1])["Envelope"]["HTML-Metadata"] is None
    for kind in ("application/xhtml+xml", "TEXT/plain", "application/json; x=1", ""):
        assert len(W.derived(response([("Content-Type", kind)], b"x"))) == 2


def test_types_of_rows_and_names(spark):
    rows = [(1, response([], b"x"), 7), (2, response([], b"x", kind="request"), 7), (3, None, 7), (4, b"no record", 7), (5, b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", 7)]
    found = W.derivatives(spark.createDataFrame(rows, "page_id long, record binary, record_type int")).collect()
    assert sorted((r.page_id, r.record_type) for r in found) == [(1, "conversion"), (1, "metadata"), (2, "other"), (3, "malformed"), (4, "malformed"), (5, "malformed")]

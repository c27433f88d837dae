"""Legacy archives and their conversion: format fixtures written by hand, round
trips against brute force, edge cases."""

import base64
import gzip
import hashlib

import pytest

from tidemark.llm import queries, warc
from tidemark.llm.common import new_path

V1 = (
    b"filedesc://IA-001.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 InternetArchive\nURL IP-address Archive-date Content-type Archive-length\n"
    b"\nhttp://a.example/with a blank.html 127.10.100.2 19961104142103 text/html 57\nHTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>one</p>\n\n\n"
    b"\ndns:a.example 127.10.100.2 199611041421 text/dns 9\na.example\n"
)
V2_HEAD = b"2 0 Someone\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
V2 = (
    b"filedesc://IA-002.arc 0.0.0.0 19970923142103 text/plain 200 - - 0 IA-002.arc %d\n" % len(V2_HEAD) + V2_HEAD
    + b"http://b.example/ 127.0.0.1 19970101000000 text/html 404 abc - 240 IA-002.arc 31\nHTTP/1.0 404 Gone\r\nA: b\r\n\r\nnope\n"
)


def test_versions_of_the_format():
    one, dns = warc.arc_records(V1)
    assert (one["URL"], one["Archive-date"], one["archive"], one["version"]) == ("http://a.example/with a blank.html", "19961104142103", "IA-001.arc", 1)
    head, payload = warc.split_http(one["content"])
    assert payload == b"<p>one</p>\n\n\n" and head.endswith(b"\r\n\r\n")
    assert dns["content"] == b"a.example" and warc.warc_date(dns["Archive-date"]) == "1996-11-04T14:21:00Z" and warc.split_http(dns["content"]) is None
    assert V1[dns["offset"] :].startswith(b"dns:")
    (two,) = warc.arc_records(V2)
    assert (two["version"], two["Result-code"], two["Checksum"], two["content"][-4:]) == (2, "404", "abc", b"nope")
    # a member for each record, as archives were compressed
    cut = V1.index(b"\nhttp://")
    assert [r["URL"] for r in warc.arc_records(gzip.compress(V1[:cut]) + gzip.compress(V1[cut:]))] == [one["URL"], dns["URL"]]
    assert list(warc.arc_records(b"")) == []


@pytest.mark.parametrize("broken", [V1[:-6], V1[: V1.index(b"<p>")], b"no archive\n", V1.replace(b"1 0 Internet", b"7 0 Internet"), V1.replace(b" text/dns 9", b" text/dns")])
def test_broken_archives_are_errors(broken):
    with pytest.raises(ValueError):
        list(warc.arc_records(broken, "it"))


def test_record_round_trip():
    made = warc.warc_record("response", warc.record_id("a", 3), "2000-01-01T00:00:00Z", [("X", "é")], b"\r\n\r\nWARC/1.1\r\n") + b"\r\n\r\n"
    assert [(h["x"], b) for h, b in warc.warc_records(made + made)] == [("é", b"\r\n\r\nWARC/1.1\r\n")] * 2


def plain(rows, least=0):
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    last = {}
    for k, p in rows:
        if len(p) >= least:
            last[p] = max(last.get(p, -1), -1 if k is None else k)
    out = []
    for k, p in rows:
        again = len(p) >= least and last[p] != k
        out.append((k, len(p), sha(p), "revisit" if again else "response", last[p] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_edges(spark, least):
    long = "<p>word é</p>\r\n\r\n" * 200_000
    texts = [None, "", "", "WARC/1.1\r\n\r\n", "HTTP/1.1 200 OK\r\n\r\nx", "hot copy", "filedesc://x 1 0 3\n", long, long, "\x00\n", "a\r\n"] + ["hot copy"] * 40
    rows = [(k, f"http://x/{k} y\n" if k % 3 else None, t, "clash", "c2", 5) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key string, content string, offset int").repartition(7)
    got = warc.round_trip(df, new_path(spark, "arc"), new_path(spark, "warc"), least, file_mb=1)
    want = plain([(k, (t or "").encode()) for k, t in enumerate(texts)], least)
    assert sorted(map(tuple, got.select("key", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == want
    assert {r.uri for r in got.collect()} == {f"http://x/{k}%20y%0A" if k % 3 else "-" for k in range(len(texts))}


def test_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, None, "x"), (None, "u", "x"), (3, "u", "x"), (3, "u", "x"), (None, "u", "alone")], "page_id long, url string, html string")
    got = warc.round_trip(df, new_path(spark, "arc"), new_path(spark, "warc")).collect()
    assert sorted((str(r.key), r.record_type, str(r.refers_to)) for r in got) == sorted(
        [("None", "revisit", "3"), ("None", "revisit", "3"), ("3", "revisit", "3"), ("3", "response", "None"), ("None", "response", "None")]
    )
    none = df.filter("false")
    assert warc.round_trip(none, new_path(spark, "arc"), new_path(spark, "warc")).count() == 0


def test_payloads_and_other_archives(spark, tmp_path):
    (tmp_path / "a.arc").write_bytes(V1)
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(V2))
    path = new_path(spark, "warc")
    warc.convert(spark, str(tmp_path), path)
    rows = {r.uri: r for r in warc.read_warc(spark, path, payload=True).collect()}
    assert set(rows) == {"http://a.example/with a blank.html", "http://b.example/"}  # the DNS answer is a resource
    assert bytes(rows["http://b.example/"].payload) == b"nope" and rows["http://b.example/"].date == "1997-01-01T00:00:00Z"


def test_query(spark, small):
    rows = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.op12_arc_to_warc(spark, small).collect()), key=str) == plain(rows)

"""WARC: references that resolve, hot payloads, and archives that the writer did not make."""

import base64
import gzip
import hashlib
import tempfile

import pytest

from calibrant.llm import op10_warc as op10
from calibrant.llm import repeats
from calibrant.llm.common import Scratch


def test_references_name_records(spark):
    """Every WARC-Refers-To is the id of a response with that payload; ids are unique but for a page that is written again."""
    text = ["a" * 1500, "é" * 40_000, "b" * 1200]
    rows = [(i, f"http://h/{i}", text[i % 3]) for i in range(30)] + [(29, "http://h/29", text[2])] * 3 + [(28, "http://other/", text[1]), (28, "http://h/28", text[1]), (None, "u", text[0]), (50, "u", "x")]
    path = "file://" + tempfile.mkdtemp() + "/w"
    op10.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, segment=4096)
    got = op10.read_warc(spark, path).collect()
    assert len(got) == len(rows)
    stored = {x["record_id"]: x for x in got if x["record_type"] == "response"}
    again = [x for x in got if x["record_type"] == "revisit"]
    assert len(again) == 28 and all(stored[x["refers_to_record"]]["digest"] == x["digest"] and stored[x["refers_to_record"]]["page_id"] == x["refers_to"] for x in again)
    assert sorted(x["page_id"] or -1 for x in stored.values()) == [27, 28, 28, 29, 50] and sum(x["page_id"] == 29 for x in got) == 4
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    heads = [f for x in files for f, _ in op10.parse(op10.inflate(x["content"]))]
    assert all("warc-target-uri" in f for f in heads) and any(f["warc-type"] == "continuation" for f in heads)


def test_hot_payload(spark, monkeypatch):
    """A third of all rows is one payload, joined without an exchange of its rows."""
    monkeypatch.setattr(repeats, "LEAST", 10)
    rows = [(i, "u", "hot" * 500 if i % 3 == 0 else str(i) * 500) for i in range(300)]
    got = {x["page_id"]: x for x in op10.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark)).collect()}
    assert len(got) == 300
    for i, _, h in rows:
        want = ("revisit", 297) if i % 3 == 0 and i != 297 else ("response", None)
        assert (got[i]["record_type"], got[i]["refers_to"]) == want and got[i]["payload_bytes"] == len(h) and got[i]["payload_digest"] == hashlib.sha1(h.encode()).hexdigest()


def record(kind: str, block: bytes, *fields: str) -> bytes:
    head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *fields, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark):
    """One gzip member a record; warcinfo, request and metadata; digests missing, base32, SHA-256 and of the framed body; a resource; folded lines; segments."""
    body, framed = b"<p>one</p>", b"4\r\n<p>o\r\n6;x=1\r\nne</p>\r\n0\r\n\r\n"
    plain, chunked = b"HTTP/1.1 200 OK\r\nContent-Length: 10\r\n\r\n" + body, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + framed
    b32 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = "Content-Type: application/http; msgtype=response"
    records = [
        record("warcinfo", b"software: x\r\n", "WARC-Record-ID: <urn:0>", "Content-Type: application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Record-ID: <urn:1>", "Content-Type: application/http; msgtype=request"),
        record("response", plain, "WARC-Record-ID: <urn:2>", "WARC-Target-URI: http://a/", http),
        record("response", chunked, "WARC-Record-ID: <urn:3>", "WARC-Target-URI: http://b/", "WARC-Payload-Digest: " + b32, http),
        record("response", chunked, "WARC-Record-ID: <urn:4>", "WARC-Payload-Digest: sha256:" + hashlib.sha256(framed).hexdigest(), "X-Note: a", "  folded: b", http),
        record("resource", b"GIF", "WARC-Record-ID: <urn:5>", "Content-Type: image/gif"),
        record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Record-ID: <urn:6>", "WARC-Refers-To: <urn:3>", "WARC-Payload-Digest: " + b32, http),
        record("metadata", b"", "WARC-Record-ID: <urn:7>"),
        record("continuation", chunked[60:], "WARC-Record-ID: <urn:9>", "WARC-Segment-Origin-ID: <urn:8>", "WARC-Segment-Number: 2", f"WARC-Segment-Total-Length: {len(chunked)}"),
        record("response", chunked[:60], "WARC-Record-ID: <urn:8>", "WARC-Segment-Number: 1", "WARC-Payload-Digest: " + b32, http),
    ]
    d = tempfile.mkdtemp()
    with open(f"{d}/crawl.warc.gz", "wb") as f:
        f.write(b"".join(map(gzip.compress, records)))
    got = {x["record_id"]: x for x in op10.read_warc(spark, "file://" + d, "*.warc.gz").collect()}
    assert sorted(got) == [f"<urn:{i}>" for i in (2, 3, 4, 5, 6, 8)]
    sha = hashlib.sha1(body).hexdigest()
    assert all(bytes(got[f"<urn:{i}>"]["payload"]) == body and got[f"<urn:{i}>"]["digest"] == sha and got[f"<urn:{i}>"]["page_id"] is None for i in (2, 3, 4, 8))
    assert bytes(got["<urn:5>"]["payload"]) == b"GIF" and (got["<urn:6>"]["payload"], got["<urn:6>"]["refers_to_record"], got["<urn:6>"]["digest"]) == (None, "<urn:3>", sha)
    with pytest.raises(ValueError, match="digest"):
        op10.checked(plain, True, "sha1:" + "0" * 40)
    assert op10.checked(plain, True, "unknown:abc") == body

import base64
import gzip
import hashlib
import json
import re
import time
import uuid
import zlib

import pyarrow.parquet as pq
import pytest

from rivulet.llm import warc

PAGE = "<html><head><title>T &amp; t</title><meta name='a' content='b'></head><body><nav><a href='/x?a&amp;b'>Menu</a></nav><p>Some é text.</p></body></html>"


def test_round_trip_of_records():
    record = warc.response("http://e/ü", PAGE, "1")
    data = record.serialized()
    for form in (data + data, gzip.compress(data) + gzip.compress(data)):
        assert list(warc.read_records(form)) == [record, record]


def test_derivatives_are_linked():
    record = warc.response("http://e/", PAGE, "1")
    metadata, conversion, ok, text = warc.derive(record)
    assert ok and text == "T & t\nMenu\nSome é text."
    for kind, made in (("metadata", metadata), ("conversion", conversion)):
        assert made.get("WARC-Type") == kind and made.get("WARC-Refers-To") == record.get("WARC-Record-ID")
        assert made.get("WARC-Target-URI") == "http://e/" and made.get("WARC-Date") == record.get("WARC-Date")
        assert made.get("WARC-Block-Digest") == warc.digest(made.block) and int(made.get("Content-Length")) == len(made.block)
    assert conversion.get("WARC-Source-Payload-Digest") == record.get("WARC-Payload-Digest") == warc.digest(PAGE.encode())
    facts = json.loads(metadata.block)["Envelope"]
    assert [tuple(x) for x in facts["WARC-Header-Metadata"]] == record.headers
    http = facts["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert http["Status-Line"] == "HTTP/1.1 200 OK" and http["Entity-Digest"] == record.get("WARC-Payload-Digest")
    assert http["HTML-Metadata"] == {"Head": {"Title": "T & t", "Metas": [{"name": "a", "content": "b"}]}, "Links": [{"path": "A@/href", "url": "/x?a&b"}]}


def test_codings_and_wrong_digests():
    body = gzip.compress("<p>é</p>".encode("latin-1"))
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body)
    block = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\nContent-Type: text/html; charset=latin-1\r\n\r\n" + chunked
    record = warc.Record("WARC/1.1", [("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Block-Digest", "sha1:AAAA"), ("Content-Length", str(len(block)))], block)
    metadata, conversion, ok, text = warc.derive(record)
    assert text == "é" and not ok and conversion.version == "WARC/1.1"


def test_tables(spark):
    rows = [(1, "http://e/", PAGE, "z"), (2, None, None, "z"), (1, "http://e/", PAGE, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = warc.derivatives(warc.responses(pages)).collect()
    assert len(out) == 3 and all(r.error is None and r.digest_ok and r.refers_to == r.source_id for r in out)
    assert {r.page_id: r.text for r in out} == {1: "T & t\nMenu\nSome é text.", 2: ""}
    bad = spark.createDataFrame([(1, None), (2, b"junk"), (3, b"WARC/1.0\r\nContent-Length: 9\r\n\r\nx"), (4, b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n")], "page_id long, record binary")
    assert all(r.error and r.conversion is None for r in warc.derivatives(bad).collect())
    assert warc.derivatives(bad.limit(0)).count() == 0
    packed = warc.pack(warc.derivatives(warc.responses(pages)).coalesce(1), "conversion").collect()
    assert sum(r.n_records for r in packed) == 3 and len(list(warc.read_records(bytes(packed[0]["data"])))) == packed[0].n_records


def test_all_records_of_a_cell(spark):
    made = [warc.response(f"http://e/{i}", f"<p>text {i}</p>", str(i)) for i in range(700)]
    data = [r.serialized() for r in made]
    cells = [(1, b"".join(data)), (2, b"".join(gzip.compress(x) for x in data[:3])), (3, data[0] + b"junk"), (4, None)]
    out = warc.derivatives(spark.createDataFrame(cells, "page_id long, record binary")).collect()
    own = {k: [r for r in out if r.page_id == k] for k in (1, 2, 3, 4)}
    for k, n in ((1, 700), (2, 3)):
        assert [(r.source_id, r.text, r.error) for r in own[k]] == [(m.get("WARC-Record-ID"), f"text {i}", None) for i, m in enumerate(made[:n])]
    assert [(r.text, r.error is None) for r in own[3]] == [("text 0", True), (None, False)]
    assert len(own[4]) == 1 and own[4][0].error


def test_query_equals_digests_and_ids_made_by_hand(spark):
    """Every page of the smallest table: ids, links and digests as the definitions give them, without the operator's code."""
    from rivulet.llm.queries import op3_warc

    folder = "/root/testdata/sf0.001"
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    urn = lambda kind, source: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{source}')}>"
    want = {}
    for p in pq.read_table(f"{folder}/pages.parquet").to_pylist():
        source = urn("response", f"{p['page_id']} {p['url']}")
        want[p["page_id"], p["url"]] = (source, urn("metadata", source), urn("conversion", source), source, sha1((p["html"] or "").encode()), True)
    found = op3_warc(spark, folder).collect()
    assert len(found) == len(want) and all(r.error is None for r in found)
    assert {(r.page_id, r.url): (r.source_id, r.metadata_id, r.conversion_id, r.refers_to, r.source_payload_digest, r.digest_ok) for r in found} == want
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    for r in warc.derivatives(warc.responses(pages)).collect():
        head, _, block = bytes(r.conversion)[:-4].partition(b"\r\n\r\n")
        named = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert block.decode() == r.text and named["WARC-Block-Digest"] == sha1(block) and int(named["Content-Length"]) == len(block)
        assert named["WARC-Refers-To"] == r.source_id and named["WARC-Source-Payload-Digest"] == r.source_payload_digest
        assert named["WARC-Target-URI"] == r.url and named["WARC-Type"] == "conversion"


def test_facts_leave_out_comments_and_scripts():
    from rivulet.llm import html_text

    page = "<!-- <title>no</title><a href=c> --><title>Yes</title><script>'<meta name=x><a href=s>'</script><META Name=k content='v'><a href=/1 class=x>l</a><img src=i.png>"
    facts = warc.page_facts(html_text.markup(page))
    assert facts["Head"] == {"Title": "Yes", "Metas": [{"name": "k", "content": "v"}]}
    assert [x["url"] for x in facts["Links"]] == ["/1", "i.png"]


@pytest.mark.parametrize("piece", ["<title>", "<meta ", "<meta name", "<a href", "<meta a a ", "<a b=\"", "x" * 9])
def test_hostile_pages_take_linear_time(piece):
    for end in ("", ">"):
        record = warc.response("http://e/", piece * (500_000 // len(piece)) + end, "1")
        start = time.time()
        warc.derive(record)
        assert time.time() - start < 10
    record = warc.response("http://e/", "<meta " + "a" * 500_000 + ">", "1")
    start = time.time()
    warc.derive(record)
    assert time.time() - start < 10


def test_chunks_that_lie():
    headers = [("Transfer-Encoding", "chunked")]
    for payload in (b"-5\r\nabc\r\n", b"zz\r\nabc", b"3\r\nabc\r\n-1\r\n\r\n"):
        assert re.sub(r"\s", "", warc.decoded_body(headers, payload)) != ""


def made(charset: str, payload: bytes, *headers: str) -> bytes:
    http = "\r\n".join(["HTTP/1.1 200 OK", f"Content-Type: text/html; charset={charset}", *headers]).encode() + b"\r\n\r\n" + payload
    return warc.Record("WARC/1.0", [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{charset}>"), ("Content-Length", str(len(http)))], http).serialized()


def test_hostile_charsets_and_bodies(spark):
    names = ["idna", "unicode_escape", "raw_unicode_escape", "punycode", "utf-7", "base64", "rot13", "undefined", "no-such", "utf-16-surrogatepass", "utf-8", "windows-1251"]
    rows = [(n, made(n, rb"<p>a\ud800\xff b &#xD800; &#55296; c</p>" + b"\xed\xa0\x80\xff")) for n in names]
    out = {r.name: r for r in warc.derivatives(spark.createDataFrame(rows, "name string, record binary")).collect()}
    assert len(out) == len(names) and all(r.error is None and r.text.startswith("a") for r in out.values())
    assert "\ufffd" in out["idna"].text and out["unicode_escape"].text == out["utf-8"].text
    cyrillic = warc.derivatives(spark.createDataFrame([(made("windows-1251", "<p>мост</p>".encode("cp1251")),)], "record binary")).collect()
    assert [r.text for r in cyrillic] == ["мост"]


def test_bombs_are_errors_and_members_are_read(monkeypatch):
    monkeypatch.setattr(warc, "MAX_BODY", 1000)
    page = gzip.compress(b"<p>one") + gzip.compress(b" two</p>")
    assert warc.decoded_body([("Content-Encoding", "gzip")], page) == "<p>one two</p>"
    assert warc.decoded_body([("Content-Encoding", "gzip")], page[:-9]) != "" and warc.decoded_body([("Content-Encoding", "deflate")], zlib.compress(b"x" * 999)) == "x" * 999
    for coding, data in (("gzip", gzip.compress(b"0" * 1001)), ("deflate", zlib.compress(b"0" * 100_000)), ("gzip", gzip.compress(b"0" * 600) * 2)):
        with pytest.raises(warc.BadRecord):
            warc.decoded_body([("Content-Encoding", coding)], data)
    with pytest.raises(warc.BadRecord):
        list(warc.read_records(gzip.compress(b"WARC/1.0" * 1000)))


def test_a_bomb_fails_its_record_only(spark):
    bomb = gzip.compress(gzip.compress(b"0" * (warc.MAX_BODY + 1)))
    rows = [(1, made("utf-8", gzip.decompress(bomb), "Content-Encoding: gzip")), (2, made("utf-8", b"<p>fine</p>"))]
    out = {r.id: r for r in warc.derivatives(spark.createDataFrame(rows, "id int, record binary")).collect()}
    assert "more than" in out[1].error and out[1].text is None and (out[2].error, out[2].text) == (None, "fine")

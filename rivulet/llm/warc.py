"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

Every response record gives a metadata record (JSON: the source record's headers as they were, the HTTP status and
headers, title, meta tags and links of the page, lengths and digests) and a conversion record (the page's visible text).
Both name the source in ``WARC-Refers-To``, keep its target URI and date, and carry block digests of their own; the
conversion also keeps the source's payload digest in ``WARC-Source-Payload-Digest``. Record ids of derivatives are
name-based UUIDs of the source's id, so a repeated run gives the same records.

Defined results: a record that can't be read (no version line, no end of headers, too short a block) gives no
derivatives and an ``error``; so does one of another type than response. A digest that is named but wrong gives
``digest_ok`` false and derivatives all the same. Chunked and compressed bodies are decoded for the text; digests are of
the payload as stored. Texts are decoded by the charsets that browsers know, others count as UTF-8, and what can't be
decoded becomes the replacement character. A body or an archive that decompresses to more than ``MAX_BODY`` bytes gives an
error (memory is bounded by some multiple of that, or of the record as stored). Null records are unreadable ones. Repeated records give equal derivatives. A very long record is
worked on whole, alone, in time linear in its length; an empty table gives an empty result. Extra columns are kept, but
for those with the names of the new columns, which are replaced. Records that ``responses`` makes from a table of pages
carry the fetch date it is given; a table without dates has none to give, so the default is a fixed one.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html as htmllib
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm import html_text

VERSION = b"WARC/1.0"
#: Bytes of records that ``pack`` puts in one archive, about.
PACK_BYTES = 64 << 20
#: Bytes that a compressed body or archive may have when decompressed.
MAX_BODY = 256 << 20
# Text encodings of the web platform, by the names of their codecs.
CHARSETS = frozenset(
    """
    utf-8 utf-16-le utf-16-be ascii cp866 iso8859-1 iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-6 iso8859-7 iso8859-8
    iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16 koi8-r koi8-u mac-roman mac-cyrillic cp874 cp1250 cp1251 cp1252
    cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 gbk gb2312 gb18030 big5 big5hkscs euc_jp iso2022_jp shift_jis euc_kr cp949
    """.split()
)
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace
#: A name begins where no name goes on, so that no place is scanned twice.
_PAIR = re.compile(r"""(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""")
_TARGETS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src"}


class BadRecord(ValueError):
    """A record that can't be read."""


#: What reading a single record may raise, whatever its bytes.
_UNREADABLE = (ValueError, OSError, EOFError, zlib.error)


def decompressed(data: bytes, wbits: int) -> bytes:
    """All members of compressed data; more than ``MAX_BODY`` bytes are an error."""
    parts, size = [], 0
    while data:
        stream = zlib.decompressobj(wbits)
        part = stream.decompress(data, MAX_BODY - size + 1)
        size += len(part)
        if size > MAX_BODY:
            raise BadRecord(f"decompresses to more than {MAX_BODY} bytes")
        if not stream.eof:
            raise EOFError("compressed data end too early")
        parts.append(part)
        data = stream.unused_data.lstrip(b"\0")
    return b"".join(parts)


@dataclass
class Record:
    version: str
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def serialized(self) -> bytes:
        lines = [self.version.encode()] + [f"{k}: {v}".encode() for k, v in self.headers]
        return b"\r\n".join(lines) + b"\r\n\r\n" + self.block + b"\r\n\r\n"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind}:{source}')}>"


def _headers(raw: bytes) -> list[tuple[str, str]]:
    found: list[tuple[str, str]] = []
    for line in raw.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and found:  # a folded line goes on with the last header
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            found.append((name.strip(), value.strip()))
    return found


def read_records(data: bytes) -> Iterator[Record]:
    """The records of a WARC file, plain or gzipped (also record by record)."""
    if data[:2] == b"\x1f\x8b":
        data = decompressed(data, 31)
    at = 0
    while at < len(data):
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise BadRecord("no version line or no end of headers")
        first, _, rest = data[at:end].partition(b"\r\n")
        headers = _headers(rest)
        length = next((v for k, v in headers if k.lower() == "content-length"), "")
        if not length.isdigit() or end + 4 + int(length) > len(data):
            raise BadRecord("no content length, or a block shorter than that")
        start = end + 4
        yield Record(first.decode("ascii", "replace"), headers, data[start : start + int(length)])
        at = start + int(length)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of an HTTP response."""
    end, gap = block.find(b"\r\n\r\n"), 4
    if end < 0:
        end, gap = block.find(b"\n\n"), 2
    if end < 0:
        return "", [], block
    first, _, rest = block[:end].partition(b"\n")
    return first.decode("latin-1").rstrip("\r"), _headers(rest), block[end + gap :]


def decoded_body(headers: list[tuple[str, str]], payload: bytes) -> str:
    """The payload's text: transfer and content coding undone as far as they can be read, then decoded."""
    named = {k.lower(): v for k, v in headers}
    if "chunked" in named.get("transfer-encoding", "").lower():
        parts, at = [], 0
        while (eol := payload.find(b"\r\n", at)) >= 0:
            try:
                size = int(payload[at:eol].split(b";")[0], 16)
            except ValueError:
                break
            if size <= 0:
                break
            parts.append(payload[eol + 2 : eol + 2 + size])
            at = eol + 4 + size
        payload = b"".join(parts) or payload
    coding = named.get("content-encoding", "").lower()
    try:
        if coding in ("gzip", "x-gzip"):
            payload = decompressed(payload, 31)
        elif coding == "deflate":
            payload = decompressed(payload, 15)
    except (EOFError, zlib.error):
        pass
    charset = re.search(r"charset=[\"']?([-\w]+)", named.get("content-type", ""), re.I)
    if charset is None and (m := re.search(rb"charset=[\"']?([-\w]+)", payload[:2048], re.I)):
        charset = re.match(r"(.*)", m[1].decode("ascii"))
    try:
        codec = codecs.lookup(charset[1]).name if charset else "utf-8"
    except (LookupError, ValueError):
        codec = "utf-8"
    return payload.decode(codec if codec in CHARSETS else "utf-8", "replace").encode("utf-8", "replace").decode("utf-8")


def page_facts(pieces: Iterable[tuple[str, str, str]]) -> dict:
    """Title, meta tags and links of a page's markup; what stands in comments and scripts doesn't count."""
    title, metas, links = None, [], []
    for kind, name, rest in pieces:
        if kind == "raw" and name == "title" and title is None:
            title = " ".join(htmllib.unescape(rest).split())
        elif kind == "open" and name == "meta":
            metas.append({k.lower(): htmllib.unescape(v.strip("\"'")) for k, v in _PAIR.findall(rest)})
        elif kind == "open" and (target := _TARGETS.get(name)):
            if url := {k.lower(): v for k, v in _PAIR.findall(rest)}.get(target):
                links.append({"path": f"{name.upper()}@/{target}", "url": htmllib.unescape(url.strip("\"'"))})
    return {"Head": {"Title": title, "Metas": metas}, "Links": links}


def plain_text(title: str | None, pieces: Iterable[tuple[str, str, str]]) -> str:
    """Title and visible text, a line per block."""
    return "\n".join(x for x in [title, *(b.text for b in html_text.blocks(pieces))] if x)


def response(url: str | None, page: str, source: str, date: str = "2024-01-01T00:00:00Z") -> Record:
    """A response record of a fetched page."""
    payload = page.encode("utf-8")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", source)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", " ".join(url.split())))
    headers += [("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return Record(VERSION.decode(), headers, block)


def derive(record: Record) -> tuple[Record, Record, bool, str]:
    """(metadata record, conversion record, whether the named digests hold, the text) of a response record."""
    if (record.get("WARC-Type") or "").lower() != "response":
        raise BadRecord("not a response")
    source = record.get("WARC-Record-ID")
    if not source:
        raise BadRecord("no record id")
    status, headers, payload = split_http(record.block)
    held = [(record.get("WARC-Block-Digest"), record.block), (record.get("WARC-Payload-Digest"), payload)]
    ok = all(digest(data) == named for named, data in held if named and named.startswith("sha1:"))
    pieces = list(html_text.markup(decoded_body(headers, payload)))
    page = page_facts(pieces)
    text = plain_text(page["Head"]["Title"], pieces)
    linked = [(k, v) for k in ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address") if (v := record.get(k)) is not None]
    facts = {
        "Envelope": {
            "Format": "WARC",
            "WARC-Header-Length": str(len(record.serialized()) - len(record.block) - 4),
            "WARC-Header-Metadata": [[k, v] for k, v in record.headers],
            "Block-Digest": digest(record.block),
            "Actual-Content-Length": str(len(record.block)),
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {"Status-Line": status, "Headers": [[k, v] for k, v in headers], "Entity-Length": str(len(payload)), "Entity-Digest": digest(payload), "HTML-Metadata": page},
            },
        }
    }
    both = []
    for kind, content, block in (("metadata", "application/json", json.dumps(facts, ensure_ascii=False).encode("utf-8", "replace")), ("conversion", "text/plain", text.encode("utf-8", "replace"))):
        named = [("WARC-Type", kind), *linked, ("WARC-Record-ID", record_id(kind, source)), ("WARC-Refers-To", source)]
        if kind == "conversion" and (value := record.get("WARC-Payload-Digest")):
            named.append(("WARC-Source-Payload-Digest", value))
        both.append(Record(record.version, [*named, ("WARC-Block-Digest", digest(block)), ("Content-Type", content), ("Content-Length", str(len(block)))], block))
    return both[0], both[1], ok, text


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", record: str = "record") -> DataFrame:
    """Add ``record``: each page as a serialised response record. Null html is an empty page."""
    rows = pages.drop(record).withColumns({"__key": F.col(key).cast("string"), "__url": F.col(url).cast("string"), "__html": F.coalesce(F.col(html).cast("string"), F.lit(""))})
    rows = rows.drop(html)
    kept = [c for c in rows.columns if not c.startswith("__")]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(record, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("__key", "__url", "__html")]
            found = [response(u, h, f"{k} {u}").serialized() for k, u, h in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.binary())], names=[*kept, record])

    return rows.mapInArrow(run, schema)


_NEW = [("source_id", "string"), ("metadata_id", "string"), ("conversion_id", "string"), ("refers_to", "string"), ("source_payload_digest", "string"), ("digest_ok", "boolean"), ("metadata", "binary"), ("conversion", "binary"), ("text", "string"), ("error", "string")]


def derivatives(records: DataFrame, record: str = "record") -> DataFrame:
    """For each serialised response record its derivatives (serialised), their links, and the text; the record itself is
    left out, other columns are kept. A cell of several records (an archive) gives a row for each, and a last one with an
    error if what follows them can't be read. No shuffle."""
    names = [n for n, _ in _NEW]
    rows = records.withColumn("__record", F.coalesce(F.col(record).cast("binary"), F.lit(b""))).drop(record, *names)
    kept = [c for c in rows.columns if c != "__record"]
    kinds = {"string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}
    arrow = {"string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(n, kinds[k]) for n, k in _NEW)])

    def failed(e: Exception) -> tuple:
        return (None,) * 9 + (str(e),)

    def one(source: Record) -> tuple:
        try:
            metadata, conversion, ok, text = derive(source)
        except _UNREADABLE as e:
            return failed(e)
        return (source.get("WARC-Record-ID"), metadata.get("WARC-Record-ID"), conversion.get("WARC-Record-ID"), conversion.get("WARC-Refers-To"), conversion.get("WARC-Source-Payload-Digest"), ok, metadata.serialized(), conversion.serialized(), text, None)

    def each(data: bytes) -> Iterator[tuple]:
        n = 0
        try:
            for n, source in enumerate(read_records(data), 1):
                yield one(source)
            if n == 0:
                raise BadRecord("empty")
        except _UNREADABLE as e:
            yield failed(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = ((i, row) for i, x in enumerate(batch.column("__record")) for row in each(x.as_py()))
            while some := list(itertools.islice(made, 500)):
                at = pa.array([i for i, _ in some], pa.int64())
                found = list(zip(*(row for _, row in some), strict=True))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in kept), *(pa.array(v, arrow[k]) for v, (_, k) in zip(found, _NEW, strict=True))], names=[*kept, *names])

    return rows.mapInArrow(run, schema)


def pack(records: DataFrame, column: str, most: int = PACK_BYTES) -> DataFrame:
    """(data, n_records): gzipped WARC archives (a member per record) of about ``most`` bytes of records each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        archive = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary()), pa.array([len(held)], pa.int64())], names=["data", "n_records"])
        for batch in batches:
            for value in batch.column(0):
                if (data := value.as_py()) is not None:
                    held.append(gzip.compress(data, 6, mtime=0))
                    size += len(data)
                    if size >= most:
                        yield archive()
                        held, size = [], 0
        if held:
            yield archive()

    return records.select(column).mapInArrow(run, "data binary, n_records long")

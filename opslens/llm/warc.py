"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

``responses`` frames fetched pages as WARC/1.1 response records. ``derive``
reads each response record (named fields, HTTP head, payload) and builds a
metadata record (JSON: the source's named fields, HTTP status and headers,
title, links made absolute) and a conversion record (the page's plain text).
Both refer to the response by WARC-Refers-To and keep its target URI, date
and payload digest; each has its own id and block digest. ``write`` packs
records as gzip members into one file a task in the shared folder; ``read``
goes through the files record by record and checks every block digest.

Cases: a null page body is a response with an empty payload, a null URL a
record without a target URI. A record that is not a well-formed response is
returned by ``derive`` as one row of type ``invalid`` with the reason and no
record. Equal input rows give equal records. Line breaks in a URL are escaped.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import open_fs, settle, shared_path, shuffle_width

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
KEEP_URL = "!#$%&'()*+,/:;=?@[]~-._"


def sha1(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}{CRLF}" for k, v in fields.items() if v is not None)
    return f"WARC/1.1{CRLF}{head}Content-Length: {len(block)}{CRLF}{CRLF}".encode() + block + b"\r\n\r\n"


def new_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def response(page_id, url: str | None, body: str | None, date: str = DATE) -> bytes:
    payload = (body or "").encode()
    http = (f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
            f"Content-Length: {len(payload)}{CRLF}{CRLF}").encode() + payload
    uri = None if url is None else quote(url, safe=KEEP_URL)
    return record({"WARC-Type": "response", "WARC-Record-ID": new_id("response", str(page_id), uri or "", sha1(payload)),
                   "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Block-Digest": sha1(http),
                   "WARC-Payload-Digest": sha1(payload), "Content-Type": "application/http; msgtype=response"}, http)


def _fields(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        if line[:1] in " \t" and out:  # a folded line goes on
            last = next(reversed(out))
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            out[name.strip()] = value.strip()
    return out


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block of one record; ValueError if it is not one."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split(CRLF)
    if not gap or not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = _fields(lines)
    size = fields.get("Content-Length", "")
    if not size.isdigit() or len(rest) < int(size):
        raise ValueError("block shorter than its Content-Length")
    block = rest[:int(size)]
    if fields.get("WARC-Block-Digest", "").startswith("sha1:") and fields["WARC-Block-Digest"] != sha1(block):
        raise ValueError("block digest does not match")
    return fields, block


def parse_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers and decoded payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split(CRLF)
    if not gap or not status.startswith("HTTP/"):
        raise ValueError("no HTTP response in the block")
    headers = _fields(lines)
    low = {k.lower(): v.lower() for k, v in headers.items()}
    if low.get("transfer-encoding") == "chunked":
        parts, rest = [], payload
        while rest:
            size, _, rest = rest.partition(b"\r\n")
            n = int(size.split(b";")[0] or b"0", 16)
            if not n:
                break
            parts.append(rest[:n])
            rest = rest[n + 2:]
        payload = b"".join(parts)
    if low.get("content-encoding") in ("gzip", "x-gzip"):
        payload = gzip.decompress(payload)
    return status, headers, payload


_DROP = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", re.S | re.I)
# The rest of a tag: a quoted attribute value can hold a ">".
_REST = r"""(?>[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+>"""
_BREAK = re.compile(r"<(?:/?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|nav|header|footer|blockquote|pre|title)"
                    r"|br|hr)\b" + _REST, re.I)
_TAG = re.compile(r"<[/!?a-zA-Z]" + _REST)
_CODE = re.compile(r"<(?:!--.*?-->|((script|style)\b" + _REST + r").*?(</\2\s*>))", re.S | re.I)
_ROOTED = re.compile(r"/(?:[\w-]+(?:/[\w-]+)*)?")  # a path that joining leaves as it is
_LINK = re.compile(r"<(a|link|img|script|iframe|source)\b(" + _REST + ")", re.I)
_VALUE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.S | re.I)


def _closed(page: str) -> tuple[str, str]:
    """The page up to its last ">", and the rest, in which no tag ends (so it isn't searched for one)."""
    end = page.rfind(">") + 1
    return page[:end], page[end:]


def plain_text(page: str) -> str:
    head, tail = _closed(page)
    head, rest = _closed(_DROP.sub(" ", head))
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", head)) + rest + tail)
    return "\n".join([plain for line in text.split("\n") if (plain := " ".join(line.split()))])


def links_of(page: str, base: str | None) -> list[dict[str, str]]:
    """Links of a whole page: all but what stands in comments and inside scripts and styles."""
    out, base = [], base or ""
    try:
        root = urljoin(base, "/")  # joined with a plain path from the root only once a page
    except ValueError:
        root = None
    page = _closed(_CODE.sub(lambda m: f"<{m[1]}{m[3]}" if m[1] else " ", _closed(page)[0]))[0]
    for tag, rest in _LINK.findall(page):
        found = next(((name.lower(), *value) for name, *value in _VALUE.findall(rest) if name.lower() in ("href", "src")), None)
        if found is None:
            continue
        url = html.unescape(next((v for v in found[1:] if v), ""))
        path = f"{tag.lower()}@/{found[0]}"
        try:
            joined = root + url[1:] if root and _ROOTED.fullmatch(url) else urljoin(base, url)
            out.append({"path": path, "url": joined})
        except ValueError:  # a malformed host stays as written
            out.append({"path": path, "url": url})
    return out


def derive_one(raw: bytes) -> list[dict]:
    """Rows of the metadata and the conversion record of one response record."""
    try:
        source, block = parse(raw)
        if source.get("WARC-Type") != "response" or "WARC-Record-ID" not in source:
            raise ValueError("not a response record")
        status, headers, payload = parse_http(block)
    except (ValueError, OSError, EOFError, zlib.error) as why:
        return [{"record_type": "invalid", "reason": str(why)}]
    charset = re.search(r"charset=\"?([\w.:-]+)", next((v for k, v in headers.items() if k.lower() == "content-type"), ""), re.I)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    uri, rid = source.get("WARC-Target-URI"), source["WARC-Record-ID"]
    title = _TITLE.search(page)
    found = links_of(page, uri)
    envelope = {"Envelope": {"WARC-Header-Metadata": source, "Payload-Metadata": {"HTTP-Response-Metadata": {
        "Status": status, "Headers": headers, "HTML-Metadata": {
            "Title": " ".join(html.unescape(title[1]).split()) if title else None, "Links": found}}}}}
    rows = []
    for kind, media, body in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False).encode()),
                              ("conversion", "text/plain; charset=utf-8", plain_text(page).encode())):
        own = {"WARC-Type": kind, "WARC-Record-ID": new_id(kind, rid), "WARC-Date": source.get("WARC-Date"),
               "WARC-Target-URI": uri, "WARC-Refers-To": rid, "WARC-Source-Payload-Digest": source.get("WARC-Payload-Digest"),
               "WARC-Block-Digest": sha1(body), "Content-Type": media}
        rows.append({"record_type": kind, "record": record(own, body)})
    return rows


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              date: str = DATE) -> DataFrame:
    """key, record (bytes) of a response record for each page."""
    @F.pandas_udf("binary")
    def build(ids: pd.Series, urls: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([response(*row, date) for row in zip(ids, urls, bodies, strict=True)], dtype=object)

    return pages.select(F.col(id_col).cast("string").alias("key"),
                        build(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(url_col), F.col(html_col)).alias("record"))


_ROWS = "array<struct<record_type:string,reason:string,record:binary>>"


def derive(records: DataFrame, record_col: str = "record", key_col: str = "key") -> DataFrame:
    """key, record_type (metadata, conversion or invalid), reason, record (bytes)."""
    @F.arrow_udf(_ROWS)
    def build(raws: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("record_type", pa.string()), ("reason", pa.string()), ("record", pa.binary())]))
        return pa.array([derive_one(raw or b"") for raw in raws.to_pylist()], kind)

    rows = records.select(F.col(key_col).alias("key"), F.explode(build(F.col(record_col))).alias("row"))
    return rows.select("key", "row.record_type", "row.reason", "row.record")


def write(records: DataFrame, folder: str) -> DataFrame:
    """Pack the records into gzip-member files, one a task; the manifest: path, n_records, n_bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        sink, n, size, name = None, 0, 0, f"part-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if raw is None:
                    continue
                if sink is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip.compress(raw, 6, mtime=0)
                sink.write(member)
                n, size = n + 1, size + len(member)
        if sink:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n]), pa.array([size])],
                                             ["path", "n_records", "n_bytes"])

    return settle(records.select("record").mapInArrow(pack, "path string, n_records long, n_bytes long"), "warc")


def members(uri: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as source:
        held, unzip, parts = b"", zlib.decompressobj(31), []
        while True:
            data = held or source.read(chunk)
            if not data:
                break
            parts.append(unzip.decompress(data))
            held = unzip.unused_data
            if unzip.eof:
                yield b"".join(parts)
                unzip, parts = zlib.decompressobj(31), []


def read(manifest: DataFrame) -> DataFrame:
    """record_type, record_id, refers_to, target_uri, date, content_type, content_length, block_digest,
    source_payload_digest and content (text) of every record of the files."""
    cols = [("record_type", "WARC-Type"), ("record_id", "WARC-Record-ID"), ("refers_to", "WARC-Refers-To"),
            ("target_uri", "WARC-Target-URI"), ("date", "WARC-Date"), ("content_type", "Content-Type"),
            ("block_digest", "WARC-Block-Digest"), ("source_payload_digest", "WARC-Source-Payload-Digest")]
    names = [c for c, _ in cols] + ["content_length", "content"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.string()] * len(cols), pa.int64(), pa.string()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for raw in members(path):
                    fields, block = parse(raw)
                    rows.append((*[fields.get(f) for _, f in cols], len(block), block.decode("utf-8", "replace")))
                    size += len(block)
                    if size > 8_000_000:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    files = manifest.select("path").repartition(shuffle_width(manifest.sparkSession), "path")
    return files.mapInArrow(unpack, ", ".join(f"{c} string" for c, _ in cols) + ", content_length long, content string")


def derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Responses of all pages, derived, written and read back."""
    built = derive(responses(pages, id_col, url_col, html_col))
    return read(write(built, shared_path(pages.sparkSession, "warc")))

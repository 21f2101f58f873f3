"""Operator 4: WARC derivatives.

Every response record becomes two linked records: ``metadata`` (JSON: the source's WARC and
HTTP headers, title, language, links) and ``conversion`` (the page as plain text). Both name
the response in WARC-Refers-To, keep its target URI, date and payload digest, and carry a
digest of their own block. Record ids are derived from the response's id and the record's
type, so building twice gives the same records.

Defined results: null or empty html gives a response with an empty payload, metadata without
title and links, and an empty conversion; a null url gives an empty target URI; repeated
rows give repeated records; other columns are ignored. Markup that never closes (comment,
script, style) hides the rest of the page, as browsers have it.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame

CRLF = "\r\n"
#: Elements without text, and elements that end a line (fixed values).
_HIDDEN = ("script", "style", "noscript", "template", "textarea", "svg")
_LINES = "address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th thead title tr ul".split()
_OPEN = re.compile(r"<!--|<(" + "|".join(_HIDDEN) + r")(?=[\s/>])", re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>""")
_ATTR = re.compile(r"""([a-zA-Z][a-zA-Z0-9:-]*+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_BLANK = re.compile(r"[^\S\n]+")
_LINE_SET = frozenset(_LINES)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def visible(page: str) -> str:
    """The page without comments and elements that hold no text, in one forward pass."""
    out, at, closers = [], 0, {}
    while m := _OPEN.search(page, at):
        out.append(page[at : m.start()])
        if m[1] is None:
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
        else:
            name = m[1].lower()
            closer = closers.setdefault(name, re.compile(rf"</{name}\s*>", re.I))
            end = closer.search(page, m.end())
            at = len(page) if end is None else end.end()
    out.append(page[at:])
    return "".join(out)


def page_parts(page: str) -> tuple[str, dict]:
    """Plain text, and title, language and links in order of appearance."""
    about: dict = {"title": None, "lang": None, "links": []}
    out, at, title_from = [], 0, None
    seen = visible(page)
    for m in _TAG.finditer(seen):
        out.append(seen[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if name in _LINE_SET:
            if name == "title":
                if not m[1]:
                    title_from = len(out)
                elif title_from is not None and about["title"] is None:
                    about["title"] = " ".join(entities.unescape("".join(out[title_from:])).split())
            out.append("\n")
        if name in ("a", "html") and not m[1]:
            attrs = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTR.findall(m[3])}
            if name == "a" and "href" in attrs:
                about["links"].append(attrs["href"])
            elif name == "html" and about["lang"] is None:
                about["lang"] = attrs.get("lang")
    out.append(seen[at:])
    text = _BLANK.sub(" ", entities.unescape("".join(out)).replace("\r", "\n"))
    return "\n".join(x for x in (line.strip() for line in text.split("\n")) if x), about


def header_lines(first: str, headers: dict[str, str]) -> str:
    """A header block; line breaks in values become spaces, so no value can start a header."""
    return CRLF.join([first, *(f"{k}: {' '.join(str(v).split())}" for k, v in headers.items())]) + CRLF + CRLF


def serialise(headers: dict[str, str], block: bytes) -> bytes:
    return header_lines("WARC/1.1", headers).encode() + block + (CRLF * 2).encode()


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records of concatenated WARC bytes."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in data[at:end].decode().split(CRLF)[1:])
        size = int(headers["Content-Length"])
        out.append((headers, data[end + 4 : end + 4 + size]))
        at = end + 4 + size + 4
    return out


def response(key: str, url: str, page: str, date: str) -> tuple[dict[str, str], bytes]:
    """A response record (headers and block) of a fetched page."""
    payload = page.encode()
    http = header_lines("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": len(payload)}).encode()
    block = http + payload
    headers = {
        "WARC-Type": "response", "WARC-Record-ID": record_id("response", key, url), "WARC-Target-URI": url, "WARC-Date": date, "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block), "Content-Length": str(len(block)),
    }
    return headers, block


def derive(headers: dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and the conversion record of a response record."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split(CRLF)
    http = dict(line.split(": ", 1) if ": " in line else (line, "") for line in lines)
    text, about = page_parts(payload.decode("utf-8", "replace"))
    source = headers["WARC-Record-ID"]
    common = {"WARC-Refers-To": source, "WARC-Target-URI": headers["WARC-Target-URI"], "WARC-Date": headers["WARC-Date"], "WARC-Refers-To-Payload-Digest": headers["WARC-Payload-Digest"]}
    plain, meta_id, text_id = text.encode(), record_id("metadata", source), record_id("conversion", source)
    meta = json.dumps({"warc": headers, "http": {"status": status, "headers": http}, "html": about, "conversion": {"id": text_id, "digest": digest(plain), "bytes": len(plain)}}, ensure_ascii=False).encode()

    def record(kind: str, own: str, content: str, body: bytes):
        return {"WARC-Type": kind, "WARC-Record-ID": own, **common, "Content-Type": content, "WARC-Block-Digest": digest(body), "Content-Length": str(len(body))}, body

    return [record("metadata", meta_id, "application/json", meta), record("conversion", text_id, "text/plain; charset=utf-8", plain)]


_ROW = pa.schema([("key", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("source_digest", pa.string()), ("block_digest", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("block", pa.string())])


def derivatives(df: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Two rows per page: its metadata and its conversion record, headers as columns.

    No shuffle; a task holds a hundred pages at a time.
    """
    def run(batches):
        for batch in batches:
            keys, urls, pages = (batch.column(i).to_pylist() for i in range(3))
            for at in range(0, len(keys), 100):
                rows = []
                for key, url, page in zip(keys[at : at + 100], urls[at : at + 100], pages[at : at + 100]):
                    for h, body in derive(*response(str(key), url or "", page or "", date)):
                        rows.append((key, h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Refers-To-Payload-Digest"], h["WARC-Block-Digest"], h["Content-Type"], len(body), body.decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROW.types)], schema=_ROW)

    kinds = ", ".join(f"{f.name} {'long' if pa.types.is_int64(f.type) else 'string'}" for f in _ROW)
    return df.select(df[id_col].cast("long"), df[url_col], df[html_col]).mapInArrow(run, kinds).withColumnRenamed("key", id_col)


def write(records: DataFrame, path: str) -> None:
    """Derived records as WARC files, one per task, each record as its bytes."""
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                headers = {"WARC-Type": r["warc_type"], "WARC-Record-ID": r["record_id"], "WARC-Refers-To": r["refers_to"], "WARC-Target-URI": r["target_uri"], "WARC-Date": r["warc_date"], "WARC-Refers-To-Payload-Digest": r["source_digest"], "Content-Type": r["content_type"], "WARC-Block-Digest": r["block_digest"], "Content-Length": r["content_length"]}
                out.append(serialise(headers, r["block"].encode())[:-1].decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    records.select("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "source_digest", "content_type", "block_digest", "content_length", "block").mapInArrow(run, "value string").write.text(path)

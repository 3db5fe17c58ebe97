"""WARC derivatives: metadata and plain-text conversion records of responses.

``responses`` wraps fetched pages as WARC response records (HTTP head and
body); ``derive`` reads response records and yields, for each, a
conversion record (plain text) and a metadata record (title, language,
links, the source's WARC headers and HTTP head).  Both name the response in
WARC-Refers-To with its own id, URI and date and carry its payload digest;
the metadata record names the conversion.  ``serialise`` and ``parse`` turn records into WARC
bytes and back without loss.

Record ids are UUIDs of (kind, page key, URI, payload digest): running
again gives the same ids.

Defined cases: a null page body or block counts as empty, a null URI leaves
out the URI headers and links stay as written, a missing date leaves out the
date headers; a record that is no response or has no id has no derivatives;
of a repeated header the first counts; a block without an HTTP head is all
body; repeated rows give equal records row by row; a page without markup gives its own text; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
SCHEMA = ("page_id {key}, record_type string, record_id string, refers_to string, target_uri string, "
          "warc_date string, headers array<struct<name:string,value:string>>, block string, "
          "block_digest string, source_digest string")

# An unclosed quote ends at the next tag, so matching stays linear.
_TAG = re.compile(r"""<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|[!?][^>]*>)""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SKIPPED = {"script", "style", "noscript", "template", "svg"}
_BREAKS = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 "
              "h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split())
_CHARSET = re.compile(r"""content-type\s*:.*?charset\s*=\s*["']?([\w.:-]+)""", re.I)
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, kind + chr(31) + chr(31).join(map(str, parts)))}>"


def _clean(text: str) -> str:
    return _LINES.sub("\n", _BLANKS.sub(" ", entities.unescape(text).replace("\xa0", " "))).strip()


def read_html(page: str) -> dict:
    """Plain text, title, language and links of a page."""
    out, links, title, lang, at, end = [], [], None, None, 0, len(page)
    in_title = -1
    while True:
        m = _TAG.search(page, at)
        if m is None:
            out.append(page[at:])
            break
        out.append(page[at:m.start()])
        at = m.end()
        if m.group(2) is None:
            if m.group().startswith("<!--"):
                close = page.find("-->", at)
                at = end if close < 0 else close + 3
            continue
        name, closing = m.group(2).lower(), bool(m.group(1))
        if name in _BREAKS:
            out.append("\n")
        if closing:
            if name == "title" and in_title >= 0 and title is None:
                title = _clean("".join(out[in_title:]))
            continue
        if name == "title":
            in_title = len(out)
        elif name in ("a", "html"):
            values = {a.group(1).lower(): next(g for g in a.groups()[1:] if g is not None)
                      for a in _ATTRIBUTE.finditer(m.group(3))}
            if name == "a" and "href" in values:
                links.append(entities.unescape(values["href"]))
            elif name == "html":
                lang = lang or values.get("lang")
        elif name in _SKIPPED and not m.group(3).endswith("/"):
            close = re.compile(f"</{name}[^>]*>", re.I).search(page, at)
            at = end if close is None else close.end()
    return {"text": _clean("".join(out)), "title": title or "", "lang": lang or "", "links": links}


def http_block(body: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body


def response(key, uri: str | None, page: str | None, date: str = DATE) -> dict:
    """A response record as (headers, block)."""
    body = (page or "").encode("utf-8", "surrogatepass")
    block = http_block(body)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, uri, digest(body)))]
    if uri is not None:
        headers.append(("WARC-Target-URI", uri))
    headers += [("WARC-Date", date), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)),
                ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return {"headers": headers, "block": block}


def _one_line(text: str) -> str:
    return " ".join(text.split())


def _payload(block: bytes) -> tuple[str, list[str], bytes]:
    """Status line, header lines and body of an HTTP response; a block
    without an HTTP head is all body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    status, *http = head.decode("latin-1").split("\r\n")
    return status, http, body


def _text(body: bytes, http: list[str]) -> str:
    """The body in the charset that Content-Type names; an unknown or
    missing one is read as UTF-8."""
    for line in http:
        m = _CHARSET.match(line)
        if m:
            try:
                return body.decode(m.group(1), "replace")
            except LookupError:
                break
    return body.decode("utf-8", "replace")


def derivatives(source: dict) -> list[dict]:
    """The conversion and the metadata record of a response record, none of
    another record.  A source digest that the record lacks is computed."""
    named = {k.lower(): v for k, v in reversed(source["headers"])}
    if named.get("warc-type") != "response" or not named.get("warc-record-id"):
        return []
    status, http, body = _payload(source["block"])
    page = read_html(_text(body, http))
    origin, uri, date = named["warc-record-id"], named.get("warc-target-uri"), named.get("warc-date")
    payload = named.get("warc-payload-digest") or digest(body)
    ids = {k: record_id(k, origin) for k in ("conversion", "metadata")}
    fields = [("title", _one_line(page["title"])), ("language", page["lang"]), ("conversion", ids["conversion"]),
              ("source-payload-digest", payload), ("http-status", status)]
    fields += [("http-header", _one_line(h)) for h in http]
    fields += [("warc-header", f"{k}: {_one_line(v or '')}") for k, v in source["headers"]]
    fields += [("outlink", _one_line(_joined(uri, x))) for x in page["links"]]
    blocks = {"conversion": ("text/plain; charset=utf-8", page["text"]),
              "metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields if v))}
    out = []
    for kind, (mime, text) in blocks.items():
        block = text.encode("utf-8", "replace")
        headers = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Target-URI", uri), ("WARC-Date", date),
                   ("WARC-Refers-To", origin), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date),
                   ("WARC-Source-Payload-Digest", payload), ("WARC-Block-Digest", digest(block)),
                   ("Content-Type", mime), ("Content-Length", str(len(block)))]
        out.append({"headers": [(k, v) for k, v in headers if v is not None], "block": block})
    return out


def _joined(uri: str | None, link: str) -> str:
    try:
        return urljoin(uri, link) if uri is not None else link
    except ValueError:  # not a valid address: as written
        return link


def serialise(record: dict) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in record["headers"]) + "\r\n"
    return head.encode() + record["block"] + b"\r\n\r\n"


def parse(data: bytes) -> list[dict]:
    """Records of WARC bytes."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = [tuple(x.split(": ", 1)) for x in lines]
        size = int(dict(headers)["Content-Length"])
        out.append({"headers": headers, "block": data[end + 4:end + 4 + size]})
        at = end + 4 + size + 4
    return out


_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def _listed(headers) -> list:
    return [{"name": a, "value": b} for a, b in headers]


def responses(pages: DataFrame, key: str = "page_id", uri: str = "url", page: str = "html", date: str = DATE) -> DataFrame:
    """(key, headers, block): one response record for every page."""
    kind = pages.schema[key].dataType.simpleString()

    def task(batches):
        for batch in batches:
            made = [response(k, u, p, date) for k, u, p in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.record_batch({key: batch.column(0), "headers": pa.array([_listed(r["headers"]) for r in made], _HEADERS),
                                   "block": pa.array([r["block"] for r in made], pa.large_binary())})

    return pages.select(F.col(key), F.col(uri).cast("string"), F.col(page).cast("string")).mapInArrow(
        task, f"`{key}` {kind}, headers array<struct<name:string,value:string>>, block binary")


def derive(records: DataFrame, key: str = "page_id", headers: str = "headers", block: str = "block") -> DataFrame:
    """Two rows (conversion, metadata) for every response record, see ``SCHEMA``."""
    kind = records.schema[key].dataType.simpleString()

    def task(batches):
        for batch in batches:
            rows = {c: [] for c in ("record_type", "record_id", "refers_to", "target_uri", "warc_date", "headers",
                                    "block", "block_digest", "source_digest")}
            pair = []
            for i, (hs, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                source = {"headers": [(h["name"], h["value"]) for h in hs or ()], "block": bytes(b or b"")}
                for r in derivatives(source):
                    h = dict(r["headers"])
                    for c, v in zip(rows, (h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h.get("WARC-Target-URI"),
                                           h.get("WARC-Date"), _listed(r["headers"]), r["block"].decode(),
                                           h["WARC-Block-Digest"], h["WARC-Source-Payload-Digest"])):
                        rows[c].append(v)
                    pair.append(i)
            yield pa.record_batch({key: batch.column(0).take(pa.array(pair, pa.int64())), **{
                c: pa.array(v, _HEADERS if c == "headers" else pa.string()) for c, v in rows.items()}})

    schema = SCHEMA.format(key=kind).replace("page_id", f"`{key}`", 1)
    return records.select(F.col(key), F.col(headers), F.col(block)).mapInArrow(task, schema)

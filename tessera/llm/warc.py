"""Derivatives of web-archive responses: metadata and plain-text conversion records.

A record is a row: record_id, warc_type, refers_to, target_uri, date,
content_type, headers (further WARC headers), block. A response's block is its
HTTP message, as bytes. Each response yields a metadata record
(application/warc-fields) and, if its content is text, a conversion record
(text/plain), both referring to it; the response's headers and digests are
carried in their headers.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "record_id string, warc_type string, refers_to string, target_uri string, date string, content_type string, headers map<string,string>, block binary"
FIRST = ["WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type"]
COLUMNS = ["warc_type", "record_id", "refers_to", "target_uri", "date", "content_type"]

# A head without an end tag ends at <body or at what no head holds.
_HIDDEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|$)|<head\b(?:(?:(?!<body\b).)*?</head\s*>"
    r"|[^>]*>(?:\s|<!--.*?-->|<(script|style|title|template|noscript)\b.*?</\2\s*>|<(?:meta|link|base|basefont|bgsound)\b[^>]*>)*)",
    re.S | re.I,
)
_BREAKS = re.compile(r"\s*</?(?:p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|tr|table|article|section|header|footer|nav|main|aside|blockquote|pre|form|body|html|title)\b[^>]*>\s*", re.I)
_TAGS = re.compile(r"<[a-z/!?][^>]*>", re.I)
_SPACES, _LINES = re.compile(r"[ \t\r\f\v\xa0]+"), re.compile(r"\s*\n\s*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """A record id that the parts decide."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def page_text(page: str) -> str:
    """Text that a page shows, a line for each block; entities decoded, runs of blanks one blank."""
    shown = _TAGS.sub("", _BREAKS.sub("\n", _HIDDEN.sub("", page.replace("\r\n", "\n"))))
    return _LINES.sub("\n", _SPACES.sub(" ", html.unescape(shown))).strip()


def page_fields(page: str) -> list[tuple[str, str]]:
    """title, language and outlinks (in order, once each) of a page."""
    title, lang = _TITLE.search(page), _LANG.search(page)
    out = [("title", " ".join(html.unescape(title[1]).split()))] if title else []
    out += [("language", lang[1])] if lang else []
    links = dict.fromkeys(html.unescape(a or b or c) for a, b, c in _HREF.findall(page))
    return out + [("outlink", " ".join(link.split())) for link in links if link]


_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


def split_http(block: bytes) -> tuple[str, str, bytes]:
    """(status line, header lines, body) of an HTTP message; a block that isn't one is all body."""
    if not block.startswith(b"HTTP/"):
        return "", "", block
    head, _, body = block.partition(b"\r\n\r\n")
    status, _, lines = head.decode("utf-8", "replace").partition("\r\n")
    return status, lines, body


def body_text(body: bytes, content: str) -> tuple[str, str] | None:
    """(page, its text) of a body with that Content-Type; None if it isn't text. Without a type it counts as a page.

    The character set is the header's, else the page's own, else UTF-8; what can't be decoded is replaced.
    """
    kind = content.partition(";")[0].strip().lower()
    page = kind in ("", "text/html", "application/xhtml+xml")
    if not page and not kind.startswith("text/"):
        return None
    charset = _CHARSET.search(content) or (_CHARSET.search(body[:2048].decode("latin-1")) if page else None)
    try:
        text = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    return text, page_text(text) if page else text


def derivatives(record: dict) -> list[tuple]:
    """The metadata record of a response, and the conversion record if it holds text, as rows of RECORD."""
    block = bytes(record["block"] or b"")
    headers = dict(record["headers"] or {})
    status, http, body = split_http(block)
    lines = [line for line in http.split("\r\n") if line]
    content = next((line.partition(":")[2].strip() for line in lines if line.lower().startswith("content-type:")), "")
    found = body_text(body, content)
    source = {k: v for k, v in headers.items() if k.lower() != "content-length"}
    source.setdefault("WARC-Payload-Digest", digest(body))
    own = {f"WARC-Source-{k.removeprefix('WARC-')}": v for k, v in source.items()}
    own |= {f"WARC-Refers-To-{k}": record[c] for k, c in (("Target-URI", "target_uri"), ("Date", "date")) if record.get(c) is not None}
    fields = [("via-status", status)] if status else []
    fields += [("via-header", line) for line in lines]
    fields += page_fields(found[0]) if found and found[0] is not found[1] else []
    blocks = [("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields))]
    blocks += [("conversion", "text/plain", found[1])] if found else []
    out = []
    for kind, content, text in blocks:
        data = text.encode("utf-8", "replace")
        more = own | {"WARC-Block-Digest": digest(data), "Content-Length": str(len(data))}
        out.append((record_id(record["record_id"], kind), kind, record["record_id"], record["target_uri"], record["date"], content, more, data))
    return out


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response of `records` (a table of RECORD's columns), one where its content isn't text; other records are left out.

    A null block counts as empty: no fields, an empty text. Texts are converted
    whole, however long. A response without
    an id has derivatives without refers_to, whose ids its target, date and
    block decide. Repeated responses yield repeated records; other columns are
    dropped; an empty table gives an empty result.
    """
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                r = {k: None if v is None or v is pd.NA or v != v else v for k, v in r.items()}
                if r["record_id"] is None:
                    made = derivatives(r | {"record_id": record_id(r["target_uri"], r["date"], digest(bytes(r["block"] or b"")))})
                    out += [(*m[:2], None, *m[3:]) for m in made]
                else:
                    out += derivatives(r)
            yield pd.DataFrame(out, columns=names)

    responses = records.filter("warc_type = 'response'").select(*names)
    return responses.mapInPandas(run, RECORD)


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records for a table of page_id, url and html. Null html is an empty body."""
    body = F.coalesce("html", F.lit(""))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)
    uid = F.sha1(F.concat_ws("|", F.col("page_id").cast("string"), "url").cast("binary"))
    dashed = F.concat_ws("-", *[F.substring(uid, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return pages.select(
        F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"),
        F.lit("response").alias("warc_type"),
        F.lit(None).cast("string").alias("refers_to"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.create_map(F.lit("WARC-IP-Address"), F.lit("0.0.0.0")).alias("headers"),
        block.cast("binary").alias("block"),
    )


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Records as WARC/1.1 files, one for each partition. Lengths and missing digests are computed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                block = bytes(r["block"] or b"")
                head = [(k, r[c]) for k, c in zip(FIRST, COLUMNS, strict=True) if r[c] is not None]
                rest = {"WARC-Block-Digest": digest(block)} | dict(r["headers"] or {}) | {"Content-Length": str(len(block))}
                out.append(("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*head, *rest.items()]) + "\r\n").encode() + block)
            yield pd.DataFrame({"value": out})

    # As a string the bytes stay what they are.
    lines = records.mapInPandas(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _inflated(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes, piece by piece; members of a compressed one are inflated one after another, a cut-off one as far as it goes."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + size] for i in range(0, len(data), size))
        return
    at, member = 0, zlib.decompressobj(31)
    while at < len(data) or member.unconsumed_tail:
        given = member.unconsumed_tail or data[at : at + size]
        at += 0 if member.unconsumed_tail else len(given)
        try:
            yield member.decompress(given, size)
        except zlib.error:
            return
        if member.eof:
            at -= len(member.unused_data)
            member = zlib.decompressobj(31)


def parse_warc(data: bytes) -> Iterator[tuple]:
    """Rows of RECORD from a WARC file's bytes, compressed or not; only one record is held at a time. A record that the file cuts off is left out."""
    held, more = bytearray(), _inflated(data)

    def reach(n: int) -> bool:
        while len(held) < n:
            piece = next(more, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    def find(what: bytes, start: int = 0) -> int:
        while (at := held.find(what, start)) < 0:
            start = max(start, len(held) - len(what))
            if not reach(len(held) + 1):
                return -1
        return at

    while (at := find(b"WARC/")) >= 0:
        del held[:at]
        if (end := find(b"\r\n\r\n")) < 0:
            return
        lines = held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = head.get("Content-Length", "0")
        size = int(size) if size.isdecimal() else 0
        if not reach(end + 4 + size):
            return
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]
        kind, own, refers, uri, date, content = (head.pop(k, None) for k in FIRST)
        yield own, kind, refers, uri, date, content, head, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, in Spark's own readers; a file is one task's work, and handed on in batches."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                held, size = [], 0
                for row in parse_warc(bytes(content)):
                    held.append(row)
                    size += len(row[-1])
                    if size > 8 << 20 or len(held) >= 1000:
                        yield pd.DataFrame(held, columns=names)
                        held, size = [], 0
                yield pd.DataFrame(held, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)

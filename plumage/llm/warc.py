"""WARC derivatives: a metadata and a plain-text conversion record for each response.

Both records refer to the response by its identifier, carry its target, date and
payload digest, and name each other. The metadata record's block is canonical JSON
with the response's WARC and HTTP headers and the page's title, metas and links; the
conversion record's block is the page's text.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat_tools import canonical

DATE = "2024-01-01T00:00:00Z"
#: Bytes of a page in which its meta element may name the charset.
META_BYTES = 2_048
OUT_SCHEMA = "page_id long, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, content_type string, block_digest string, source_payload_digest string, content_length long, record binary"

_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)(noscript|template|svg)(?=[\s/>])[^>]*>", re.I | re.S)
_ATTRIBUTES = r"""(?=[\s/>])(?:(?:[^<>"']|"[^"]*"|'[^']*')*+>|[^>]*>)"""
_HEAD = re.compile(rf"<head{_ATTRIBUTES}(?:\s++|</?(?:base|basefont|bgsound|link|meta|noscript|template){_ATTRIBUTES}|<title{_ATTRIBUTES}(?:(?!</?(?:title|head|body)(?=[\s/>])).)*+</title\s*>|</?title{_ATTRIBUTES}|<[!?][^>]*>)*+(?:</head\s*>)?", re.I | re.S)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>""")
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_TITLE, _TITLE_END = re.compile(r"<title\b", re.I), re.compile(r"</title\s*+>", re.I)
_CODE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)


def sha1_digest(data: bytes) -> str:
    """Digest as WARC files label it: base 32 of the SHA-1."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def charset_of(http_headers: str, payload: bytes = b"") -> str:
    """Charset of the Content-Type header, else of a meta element near the page's start; UTF-8 if neither is known as one of texts."""
    in_header = re.search(r"(?im)^content-type:[^\r\n]*charset=[\"']?([-\w]+)", http_headers)
    in_page = re.search(rb"(?i)<meta\s[^<>]*?charset\s*=\s*[\"']?\s*([-\w]+)", payload[:META_BYTES])
    for name in [m[1] if isinstance(m[1], str) else m[1].decode("ascii", "replace") for m in (in_header, in_page) if m]:
        try:
            name = codecs.lookup(name).name
            b"a".decode(name, errors="replace")  # hex, base64 and others are no charsets
            return name
        except (LookupError, ValueError):
            continue
    return "utf-8"


def is_text(http_headers: list[tuple[str, str]]) -> bool:
    """Whether the Content-Type is one of texts; without one it is taken for text."""
    kind = (header(http_headers, "Content-Type") or "text/html").split(";")[0].strip().lower()
    return not kind or kind.startswith("text/") or kind.endswith(("+xml", "+json", "/xml", "/json", "/javascript"))


def ungzipped(payload: bytes) -> bytes:
    """All members of a gzip payload; what follows them and is none is left out."""
    out: list[bytes] = []
    while payload:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(payload) + member.flush())
        except zlib.error:
            if not out:
                raise
            break
        if not member.eof:
            raise ValueError("a member is cut short")
        payload = member.unused_data
    return b"".join(out)


def tags_part(page: str) -> int:
    """Where the last tag of a page can end: beyond it patterns of tags need not be tried.

    Without this an open ``<script`` for each few characters makes each of them look
    for its end up to the page's.
    """
    return page.rfind(">") + 1


def title_of(page: str) -> str | None:
    """What stands in the first title element; if the first has no end, none has."""
    began = _TITLE.search(page)
    start = page.find(">", began.end()) + 1 if began else 0
    end = _TITLE_END.search(page, start) if start else None
    return page[start : end.start()] if end else None


def without_dropped(page: str) -> str:
    """``page`` without scripts, styles and comments, which may run to its end, and without closed noscript, template and svg elements.

    Those nest, and elements left open in one end with it. Of one that is never
    closed only the tag goes, later on.
    """
    cuts, stack, held = [], [], {"noscript": 0, "template": 0, "svg": 0}
    tail_at = tags_part(page)
    for m in _DROPPED.finditer(page, 0, tail_at):
        name = (m[3] or "").lower()
        if not name:
            cuts.append(m.span())
        elif not m[2]:
            if name != "svg" or not m[0].endswith("/>"):
                stack.append((name, m.start()))
                held[name] += 1
        elif held[name]:
            last = None
            while last != name:
                last, start = stack.pop()
                held[last] -= 1
            while cuts and cuts[-1][0] >= start:
                cuts.pop()
            cuts.append((start, m.end()))
    if cuts and cuts[-1][1] == tail_at and _open_end(page[slice(*cuts[-1])]):
        cuts[-1] = (cuts[-1][0], len(page))  # a script or comment without an end takes what follows with it
    elif (comment := page.find("<!--", max(tail_at, cuts[-1][1] if cuts else 0))) >= 0:
        cuts.append((comment, len(page)))
    out, at = [], 0
    for start, end in cuts:
        out.append(page[at:start])
        at = end
    return " ".join([*out, page[at:]])


def _open_end(cut: str) -> bool:
    """Whether a piece that was cut is a comment, script or style without its end."""
    if cut.startswith("<!--"):
        return not (cut.endswith("-->") and len(cut) > 6)
    name = re.match(r"<(script|style)(?=[\s/>])", cut, re.I)
    return bool(name) and not re.search(rf"</{name[1]}\s*+>\Z", cut[-200:], re.I)


def text_of(page: str) -> str:
    """Text of a page: block elements end lines, other tags vanish, entities are resolved.

    Scripts, styles, comments and the head are left out; runs of white space are one
    space, and empty lines go. The head ends with its end tag or before the first
    text or tag that can't be in one, as its end tag may be missing.
    """
    page = without_dropped(page)
    tail_at = tags_part(page)
    page, tail = _HEAD.sub(" ", page[:tail_at]), page[tail_at:]
    page = _TAG.sub(lambda m: "\n" if m[2] and m[2].lower() in _BLOCKS else "", page) + tail
    lines = (" ".join(line.split()) for line in html.unescape(page).split("\n"))
    return "\n".join(line for line in lines if line)


def page_metadata(page: str, target: str) -> dict:
    """Title, metas and links of a page; links are absolute, in order, repeats included."""
    page = page[: tags_part(page)]
    title = title_of(page)
    metas, links = [], []
    for m in _TAG.finditer(_CODE.sub(" ", page)):
        name = (m[2] or "").lower()
        if m[1] or name not in ("a", "link", "img", "meta", "iframe"):
            continue
        attributes = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(m[3])}
        if name == "meta":
            metas.append(attributes)
        elif url := attributes.get("src" if name in ("img", "iframe") else "href"):
            try:
                links.append({"path": name, "url": urljoin(target, url)})
            except ValueError:
                links.append({"path": name, "url": url})
    return {"Links": links, "Metas": metas, "Title": " ".join(html.unescape(title).split()) if title is not None else None}


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def header_lines(lines: list[str]) -> list[tuple[str, str]]:
    """Names and values of header lines in their order; a line that begins with a space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif line.strip():
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def header(headers: list[tuple[str, str]], name: str) -> str | None:
    """First value of a header, whatever the case of its name."""
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def parse_record(record: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers (repeated ones too) and block of one record; ValueError if it isn't one."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = header_lines(lines[1:])
    size = int(header(headers, "Content-Length") or "none")
    if size < 0 or len(rest) < size:
        raise ValueError("the block is cut short")
    return headers, rest[:size]


def unchunked(payload: bytes) -> bytes:
    """A payload in chunked transfer coding put together; ValueError if it isn't."""
    out, at = [], 0
    while True:
        end = payload.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size")
        size = int(payload[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        if size < 0 or end + 2 + size > len(payload):
            raise ValueError("a chunk is cut short")
        out.append(payload[end + 2 : end + 2 + size])
        at = end + 4 + size


def decoded_payload(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without chunks, gzip and deflate; one that breaks their rules, or has another coding, stays as it is."""
    codings = lambda name: [c.strip().lower() for k, v in headers if k.lower() == name for c in v.split(",")]
    for coding in [*reversed(codings("transfer-encoding")), *reversed(codings("content-encoding"))]:
        try:
            if coding == "chunked":
                payload = unchunked(payload)
            elif coding in ("gzip", "x-gzip"):
                payload = ungzipped(payload)
            elif coding == "deflate":
                payload = zlib.decompress(payload, 15 if payload[:1] == b"\x78" else -15)
        except (ValueError, zlib.error):
            return payload
    return payload


def split_http(block: bytes) -> tuple[str, bytes]:
    """HTTP headers and payload of a response's block."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    return (head.decode("iso-8859-1"), payload) if gap else ("", block)


def derived(record: bytes) -> list[tuple]:
    """The metadata and conversion records of a response record; none of other records.

    Responses of other types than text (images, PDFs) have a metadata record only,
    without a page's title, metas and links.
    """
    source, block = parse_record(record)
    if (header(source, "WARC-Type") or "").lower() != "response":
        return []
    http, payload = split_http(block)
    target, refers, date = header(source, "WARC-Target-URI") or "", header(source, "WARC-Record-ID"), header(source, "WARC-Date") or DATE
    status, *lines = http.split("\r\n")
    fields = header_lines(lines)
    text, body = is_text(fields), decoded_payload(fields, payload)
    page = body.decode(charset_of(http, body), errors="replace") if text else ""
    payload_digest = header(source, "WARC-Payload-Digest") or sha1_digest(payload)
    ids = {kind: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers}#{kind}')}>" for kind in ("metadata", "conversion")}
    envelope = {"Envelope": {"HTML-Metadata": page_metadata(page, target) if text else None, "HTTP-Headers": [list(f) for f in fields], "HTTP-Status": status, "Payload-Digest": payload_digest, "Payload-Length": len(payload), "WARC-Headers": [list(h) for h in source]}}
    out = []
    for kind, other, content_type, data in (("metadata", "conversion", "application/json", canonical(envelope).encode("utf-8", "surrogatepass")), ("conversion", "metadata", "text/plain; charset=utf-8", text_of(page).encode("utf-8", "replace")))[: 2 if text else 1]:
        other = other if text else None
        digest = sha1_digest(data)
        headers = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", refers), ("WARC-Concurrent-To", ids[other] if other else None), ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Block-Digest", digest), ("WARC-Source-Payload-Digest", payload_digest), ("Content-Type", content_type), ("Content-Length", str(len(data)))]
        out.append((kind, ids[kind], refers, ids[other] if other else None, target, content_type, digest, payload_digest, len(data), record_bytes(headers, data)))
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records for every row of ``responses(page_id, record)``: see :data:`OUT_SCHEMA`.

    A null or empty record, or bytes that are no WARC record, give one row of type
    ``malformed`` without contents, and a record that is no response one of type
    ``other``, so nothing is lost unseen. Very long pages are converted whole, and
    repeated rows give equal records. Other columns go. An empty table gives no
    rows. No shuffle.
    """

    def batches(source):
        import pyarrow as pa

        types = [pa.int64(), *[pa.string()] * 8, pa.int64(), pa.binary()]
        names = [c.strip().split(" ")[0] for c in OUT_SCHEMA.split(",")]
        for batch in source:
            rows = []
            for page, record in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    rows += [(page, *r) for r in derived(record or b"")] or [(page, "other", *[None] * 9)]
                except ValueError:
                    rows.append((page, "malformed", *[None] * 9))
                if len(rows) >= 2_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return responses.select(F.col("page_id").cast("long"), "record").mapInArrow(batches, OUT_SCHEMA)


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Pages ``(page_id, url, html)`` as response records; a null page has no payload.

    Identifiers follow from page_id, url and payload, so equal rows have equal ones.
    """

    def batches(source):
        import pyarrow as pa

        for batch in source:
            out = []
            for page, url, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                payload = (text or "").encode("utf-8")
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                digest = sha1_digest(payload)
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page} {url} {digest}")
                target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Target-URI", target), ("WARC-Date", DATE), ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", sha1_digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
                out.append(record_bytes(headers, block))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["page_id", "record"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(batches, "page_id long, record binary")


def op6_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page, with the digest of their bytes."""
    done = derivatives(responses_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return done.withColumn("record_sha256", F.sha2("record", 256)).drop("record")

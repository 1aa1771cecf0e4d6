"""WARC derivatives: response records become linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.llm.storage import with_computed

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
# Elements whose content is no text, and those that end a line.
HIDDEN = frozenset("script style noscript template head".split())
BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav blockquote pre hr title".split())
NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9-]*)")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?+")
DECODED = 256_000_000  # bytes of a decoded payload; a longer one is an error of its record


def digest(raw: bytes) -> str:
    """The labelled SHA-1 that block and payload digests use."""
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """One record; the type comes first, the block's length last."""
    lines = [VERSION, b"WARC-Type: " + kind.encode()]
    lines += [f"{k}: {_one_line(v)}".encode() for k, v in headers.items()]
    lines.append(f"Content-Length: {len(block)}".encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes] | ValueError]:
    """Headers (names in lower case) and block of every record, in order.

    Where a record is broken or cut, its error stands for it, and reading goes on at the next line
    that begins a record, so that valid records before and after it are kept.
    """
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        wrong = "broken record header" if end < 0 or not raw.startswith(b"WARC/", at) else None
        if wrong is None:
            lines = raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = headers.get("content-length", "")
            stop = end + 4 + int(size) if re.fullmatch("[0-9]{1,18}", size) else -1
            if 0 <= stop <= len(raw):
                yield headers, raw[end + 4 : stop]
                at = stop + 4 if raw.startswith(b"\r\n\r\n", stop) else stop
                continue
            wrong = "broken record length"
        yield ValueError(wrong)
        after = raw.find(b"\nWARC/", at)
        at = after + 1 if after >= 0 else len(raw)


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers (names in lower case) and payload of an HTTP response."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        return "", {}, block
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def tokens(page: str) -> Iterator[tuple[str, str, int, int]]:
    """Kind (text, tag or mark), name of a tag in lower case, start and stop of each part of a page.

    One pass from left to right: what has been searched once is not searched again, so the time grows
    with the length of a page, whatever it holds. Comments and declarations are marks; an opening
    without an end is text, and so is "<" before no name.
    """
    at, n = 0, len(page)
    missing: set[str] = set()  # ends that no longer occur

    def find(what: str, begin: int) -> int:
        if what in missing:
            return -1
        found = page.find(what, begin)
        if found < 0:
            missing.add(what)
        return found

    while at < n:
        low = page.find("<", at)
        if low < 0:
            break
        if low > at:
            yield "text", "", at, low
        name = NAME.match(page, low + 1)
        if page.startswith("<!--", low):
            stop, size, kind = find("-->", low + 4), 3, "mark"
        elif page.startswith(("<!", "<?"), low):
            stop, size, kind = find(">", low + 2), 1, "mark"
        elif name:
            stop, size, kind = find(">", name.end()), 1, "tag"
        else:
            stop, size, kind = -1, 0, "text"
        at = stop + size if stop >= 0 else low + 1
        yield (kind, name[1].lower() if kind == "tag" else "", low, at) if stop >= 0 else ("text", "", low, at)
    if at < n:
        yield "text", "", at, n


def attributes(tag: str) -> dict[str, str]:
    """The attributes of a tag, names in lower case; of equal names the first."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(tag, NAME.match(tag, 1).end(), len(tag) - 1):
        out.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return out


def read_page(page: str) -> tuple[str, str, str, list[str]]:
    """Shown text, title, language and links of a page.

    Scripts, styles, the head and comments are not shown, tags are dropped, and blocks stand on lines
    of their own. A hidden element that never ends hides nothing.
    """
    ends = {name: [m.start() for m in re.finditer(rf"(?i)</{name}\s*+>", page)] for name in HIDDEN}
    shown, titles, links, language = [], [], [], ""
    title_at, skip = -1, 0
    for kind, name, start, stop in tokens(page):
        opening = kind == "tag" and page[start + 1] != "/"
        if kind == "tag" and name == "title":
            if opening and title_at < 0 and not titles:
                title_at = stop
            elif not opening and title_at >= 0 and not titles:
                titles.append(page[title_at:start])
        if opening and name == "html" and not language:
            language = attributes(page[start:stop]).get("lang", "")
        if start < skip:
            continue
        if opening and name in HIDDEN:
            after = bisect_left(ends[name], stop)
            if after < len(ends[name]):
                skip = page.index(">", ends[name][after]) + 1
                shown.append(" ")
        elif kind == "text":
            shown.append(html.unescape(page[start:stop]))
        elif kind == "mark" or name in BREAKS:
            shown.append("\n" if name in BREAKS else " ")
        if opening and name == "a" and start >= skip and "href" in (found := attributes(page[start:stop])):
            links.append(found["href"])
    lines = (" ".join(line.split()) for line in "".join(shown).split("\n"))
    return "\n".join(line for line in lines if line), " ".join(html.unescape(titles[0]).split()) if titles else "", language, links


def plain_text(page: str) -> str:
    """The text that a page shows."""
    return read_page(page)[0]


def _unchunked(payload: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = payload.find(b"\r\n", at)
        size = payload[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(b"[0-9a-fA-F]{1,8}", size):
            raise ValueError("broken chunk")
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(parts)
        if at + n > len(payload):
            raise ValueError("cut chunk")
        parts.append(payload[at : at + n])
        at += n + 2


def _inflated(payload: bytes, bits: int) -> bytes:
    out, rest = [], payload
    while rest:
        z = zlib.decompressobj(bits)
        out.append(z.decompress(rest, DECODED + 1 - sum(map(len, out))))
        if z.unconsumed_tail or sum(map(len, out)) > DECODED:
            raise ValueError("decoded payload is too long")
        if not z.eof:
            raise ValueError("cut payload")
        rest = z.unused_data
    return b"".join(out)


def decode_transfer(headers: dict[str, str], payload: bytes) -> bytes:
    """The payload without its transfer and content codings (chunked, gzip, deflate, identity); ValueError for others."""
    steps = [x.strip().lower() for k in ("content-encoding", "transfer-encoding") for x in headers.get(k, "").split(",")]
    for step in reversed(steps):
        try:
            if step == "chunked":
                payload = _unchunked(payload)
            elif step in ("gzip", "x-gzip"):
                payload = _inflated(payload, 31)
            elif step == "deflate":
                payload = _inflated(payload, 15 if payload[:1] == b"\x78" else -15)
            elif step not in ("", "identity"):
                raise ValueError(f"content coding {step} can't be decoded here")
        except zlib.error as e:
            raise ValueError(f"broken {step} payload") from e
    return payload


def decode_payload(headers: dict[str, str], payload: bytes) -> str:
    found = re.search(r"charset=[\"']?([\w-]+)", headers.get("content-type", ""), re.I)
    try:
        return payload.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(raw: bytes) -> list[bytes | ValueError]:
    """A metadata and a conversion record for each response record in raw, in order; an error stands for a record that is broken."""
    out: list[bytes | ValueError] = []
    for found in parse(raw):
        if isinstance(found, ValueError):
            out.append(found)
        elif found[0].get("warc-type") == "response":
            try:
                out += _derivatives(*found)
            except ValueError as e:
                out.append(e)
    return out


def _derivatives(headers: dict[str, str], block: bytes) -> list[bytes]:
    status, source, payload = split_http(block)
    text, title, language, links = read_page(decode_payload(source, decode_transfer(source, payload)))
    link = {"WARC-Target-URI": headers.get("warc-target-uri", ""), "WARC-Date": headers.get("warc-date", DATE)}
    refers = {"WARC-Refers-To": headers["warc-record-id"], "WARC-Refers-To-Target-URI": link["WARC-Target-URI"], "WARC-Refers-To-Date": link["WARC-Date"]} if "warc-record-id" in headers else {}
    fields = {"status": status, **{f"source-{k}": v for k, v in sorted(source.items())}, "source-payload-digest": headers.get("warc-payload-digest", digest(payload)), "source-block-digest": headers.get("warc-block-digest", digest(block)), "language": language, "title": title}
    about = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields.items()) + "".join(f"outlink: {_one_line(x)}\r\n" for x in links)
    out = []
    for kind, content, body in (("metadata", "application/warc-fields", about.encode("utf-8", "replace")), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        named = {"WARC-Record-ID": record_id(kind, headers.get("warc-record-id"), digest(block)), **link, **refers, "WARC-Block-Digest": digest(body)}
        if kind == "conversion":
            named["WARC-Source-Payload-Digest"] = fields["source-payload-digest"]
        out.append(record(kind, named | {"Content-Type": content}, body))
    return out


def response(key: object, url: str | None, page: str | None) -> bytes:
    """A response record for a page; a null url or page is empty."""
    payload = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    headers = {"WARC-Record-ID": record_id("response", key, url, digest(payload)), "WARC-Target-URI": url or "", "WARC-Date": DATE, "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response"}
    return record("response", headers, block)


DERIVED = "warc_type string, record_id string, refers_to string, target_uri string, block_digest string, source_digest string, content string, warc binary"


def derive_records(df: DataFrame, warc: str = "warc", key: str = "page_id") -> DataFrame:
    """A row for every derivative of the records in column `warc`: key, DERIVED and error.

    A null cell or one without responses gives no rows, nor does an empty table. A record that is
    broken, cut or coded in a way that can't be read gives one row that holds its error and nothing
    else; the other records of its cell are derived. Repeated rows and null keys give repeated
    records, very long pages are read whole in one pass, and other columns are not read.
    """
    fields = dict(c.split() for c in DERIVED.split(", ")) | {"error": "string"}

    def work(cells: list[bytes | None]) -> Iterator[tuple]:
        rows = []
        for i, raw in enumerate(cells):
            for x in derive(raw) if raw is not None else []:
                if isinstance(x, ValueError):
                    rows.append((i, *[None] * (len(fields) - 1), str(x)))
                    continue
                ((h, body),) = parse(x)
                rows.append((i, h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), h["warc-target-uri"], h["warc-block-digest"], h.get("warc-source-payload-digest"), body.decode("utf-8", "replace"), x, None))
        if rows:
            yield tuple(map(list, zip(*rows, strict=True)))

    named = df.select(F.col(key).alias("_key"), F.col(warc).alias("_warc"))
    return with_computed(named, ("_warc",), work, drop=("_warc",), **fields).withColumnRenamed("_key", key)


def response_records(pages: DataFrame, out: str = "warc") -> DataFrame:
    """page_id and one response record for each page; null urls and pages are empty, very long ones whole."""

    def work(*columns: list) -> Iterator[tuple]:
        yield range(len(columns[0])), [response(*r) for r in zip(*columns, strict=True)]

    return with_computed(pages.select("page_id", "url", "html"), ("page_id", "url", "html"), work, drop=("url", "html"), **{out: "binary"})


def warc_rows(pages: DataFrame) -> DataFrame:
    """op4: both derivatives of every page, with their links, digests and text."""
    made = derive_records(response_records(pages))
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "block_digest", "source_digest", "content", F.octet_length("warc").cast("long").alias("warc_bytes"))

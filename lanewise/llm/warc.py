"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response yields two records that point back to it by ``WARC-Refers-To``
and keep its target URI and date. The metadata record holds the source's
headers, its digests, the title, the language and the links; the conversion
record holds the visible text. Record ids are derived from the source's id, so
reruns agree. Digests are SHA-1 in base 32, as crawlers write them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, map_batches, map_rows

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space of URLs
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
# Elements whose content isn't shown, and elements that end a line.
HIDDEN = frozenset("script style template noscript iframe object svg head title".split())
RAW = frozenset("script style".split())
BREAKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr li main nav ol p pre section table tbody td tfoot th thead tr ul option".split()
)

RESPONSE = ["key", "record_id", "target_uri", "date", "headers", "payload"]
RESPONSE_SCHEMA = pa.schema([(f, pa.binary() if f == "payload" else pa.string()) for f in RESPONSE])


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _tag_end(page: str, at: int) -> int:
    """Index of the ``>`` that ends the tag; quoted ones don't. -1: none."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        at = m.end() if close < 0 else close + 1
    return -1


def extract(page: str) -> tuple[str, str | None, str | None, list[str]]:
    """Visible text, title, language and links of a page, in one pass."""
    out, title, language, links = [], None, None, []
    hidden: list[str] = []
    at, low = 0, page.lower()
    while at < len(page):
        lt = page.find("<", at)
        piece = page[at:] if lt < 0 else page[at:lt]
        if piece and not hidden:
            out.append(html.unescape(piece).replace("\n", " "))
        elif piece and hidden[-1] == "title" and title is None:
            title = " ".join(html.unescape(piece).split())
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        m = _NAME.match(page, lt)
        if not m:
            if page.startswith(("<!", "<?", "</"), lt) and (end := page.find(">", lt)) >= 0:
                at = end + 1
            else:
                if not hidden:
                    out.append("<")
                at = lt + 1
            continue
        end = _tag_end(page, m.end())
        if end < 0:
            break
        name, closing = m[1].lower(), page[lt + 1] == "/"
        inside = page[m.end() : end]
        at = end + 1
        if name in BREAKS:
            out.append("\n")
        if closing:
            if name in hidden:
                del hidden[len(hidden) - 1 - hidden[::-1].index(name) :]
        elif name in RAW:
            stop = low.find("</" + name, at)
            at = len(page) if stop < 0 else stop
            hidden.append(name)
        elif name in HIDDEN and not inside.endswith("/"):
            hidden.append(name)
        elif name == "body":
            hidden.clear()
        if not closing and name in ("a", "html"):
            for k, x, y, z in _ATTRIBUTE.findall(inside):
                if name == "a" and k.lower() == "href":
                    links.append(html.unescape(x or y or z))
                elif name == "html" and k.lower() == "lang":
                    language = x or y or z
    lines = (_BLANK.sub(" ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x), title, language, links


def responses_from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Pages as response records ``(key, record_id, target_uri, date, headers, payload)``.

    A table of pages has no headers and no times: the status line and type that
    any HTML page has stand for the headers, the length is the page's, and the
    date is the given one (``responses_from_warc`` keeps those of a crawl). A
    null url is empty, a null page has no bytes. Ids are derived from id, url and
    content, so different captures of one url differ and equal rows agree.
    """
    uri, page = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    key = F.to_json(F.struct(F.col(id_col).cast("string").alias("i"), F.col(url_col).alias("u"), F.sha2(F.col(html_col).cast("binary"), 256).alias("h")))
    name: Column = F.sha1(key.cast("binary"))
    urn = F.concat(
        F.lit("<urn:uuid:"), F.substring(name, 1, 8), F.lit("-"), F.substring(name, 9, 4), F.lit("-5"), F.substring(name, 14, 3),
        F.lit("-a"), F.substring(name, 18, 3), F.lit("-"), F.substring(name, 21, 12), F.lit(">"),
    )
    return pages.select(
        F.col(id_col).alias("key"), urn.alias("record_id"), uri.alias("target_uri"), F.lit(date).alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(page).cast("string")).alias("headers"),
        page.alias("payload"),
    )


def responses_from_warc(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """The response records of WARC files, one file to a row (as Spark's
    ``binaryFile`` reads them), in the form of ``responses_from_pages``.

    ``key`` is the path and the record's number in it. Ids, dates and headers are
    the crawl's own; records of other types are left out; null content has none.
    Damaged records and members are skipped, and ``damage_in_warc`` lists them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out, held = [], 0
                for n, (head, block, _) in enumerate(read_records(content or b"")):
                    if head.get("WARC-Type") != "response" or lacking(head):
                        continue
                    headers, _, payload = block.partition(b"\r\n\r\n")
                    row = (f"{path}#{n}", head["WARC-Record-ID"], head.get("WARC-Target-URI", ""), head["WARC-Date"], headers.decode("utf-8", "replace"), payload)
                    out.append(dict(zip(RESPONSE, row)))
                    held += len(payload)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(out, RESPONSE_SCHEMA)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, RESPONSE_SCHEMA)

    picked = files.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).cast("binary").alias("content"))
    return map_rows(picked, run, ", ".join(f"{f} string" for f in RESPONSE[:-1]) + ", payload binary")


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows for every response: ``(key, type, record_id, refers_to,
    target_uri, date, content_type, source_digest, block_digest, block)``.

    ``metadata`` and ``conversion`` refer to the response and to each other (the
    metadata names the conversion). Bytes that aren't UTF-8 are replaced in the
    text and not in the digests. Repeated responses give repeated records.
    """
    fields = ["key", "type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_digest", "block_digest", "block"]
    kind = responses.schema["key"].dataType.simpleString()

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, out = [], []
            keyed = batch.column(0)
            rows = zip(*(batch.column(i).to_pylist() for i in range(1, 6)))
            for k, (record, uri, date, headers, payload) in enumerate(rows):
                source = digest(payload)
                block = digest(headers.encode() + b"\r\n\r\n" + payload)
                text, title, language, links = extract(payload.decode("utf-8", "replace"))
                own = [f"<urn:uuid:{uuid.uuid5(_SPACE, f'{record} {t}')}>" for t in ("metadata", "conversion")]
                about = [("conversion-id", own[1]), ("source-payload-digest", source), ("source-block-digest", block)]
                about += [("source-header", line) for line in headers.split("\r\n")]
                about += [(n, v) for n, v in (("title", title), ("language", language)) if v]
                about += [("outlink", " ".join(x.split())) for x in links]
                blocks = ["".join(f"{n}: {v}\r\n" for n, v in about).encode(), text.encode("utf-8", "replace")]
                types = (("metadata", "application/warc-fields"), ("conversion", "text/plain; charset=utf-8"))
                for (t, c), i, b in zip(types, own, blocks):
                    keys.append(k)
                    out.append((t, i, record, uri, date, c, source, digest(b), b))
            columns = list(zip(*out)) if out else [()] * 9
            arrays = [keyed.take(pa.array(keys, pa.int64()))]
            arrays += [pa.array(c, pa.string()) for c in columns[:-1]] + [pa.array(columns[-1], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, fields)

        return apply

    picked = responses.select("key", "record_id", "target_uri", "date", "headers", "payload")
    return map_batches(picked, make, f"key {kind}, " + ", ".join(f"{f} string" for f in fields[1:-1]) + ", block binary")


def serialise(record: dict, compress: bool = True) -> bytes:
    """One record as WARC/1.1 bytes, a gzip member of its own if compressed."""
    head = [
        ("WARC-Type", record["type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["date"]),
        ("WARC-Target-URI", record["target_uri"]), ("WARC-Refers-To", record["refers_to"]),
        ("WARC-Block-Digest", record["block_digest"]), ("Content-Type", record["content_type"]), ("Content-Length", str(len(record["block"]))),
    ]
    data = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v).encode() + b"\r\n" + bytes(record["block"]) + b"\r\n\r\n"
    return gzip.compress(data, mtime=0) if compress else data


def inflated(data: bytes, size: int = 1 << 20) -> Iterator[bytes | str]:
    """A WARC file's bytes in pieces of ``size`` at most, gzip members one by one; a
    text says what is wrong with a member, after which the next one is looked for."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), size):
            yield data[at : at + size]
        return
    at = 0
    while at < len(data):
        member, rest = zlib.decompressobj(31), memoryview(data)[at:]
        fed = 0
        try:
            while not member.eof and (fed < len(rest) or member.unconsumed_tail):
                given = member.unconsumed_tail or rest[fed : fed + size]
                fed += 0 if member.unconsumed_tail else len(given)
                if out := member.decompress(given, size):
                    yield out
            if not member.eof:
                yield "the file is cut off"
                return
            at += fed - len(member.unused_data)
        except zlib.error as e:
            yield f"damaged member: {e}"
            at += 2
        at = data.find(b"\x1f\x8b\x08", at)
        if at < 0:
            return


def header_fields(text: str) -> dict[str, str]:
    """Named fields: a line that begins with a blank goes on with the one before it,
    lines without a colon say nothing."""
    out: dict[str, str] = {}
    name = None
    for line in text.split("\r\n"):
        if line[:1] in (" ", "\t"):
            if name:
                out[name] = f"{out[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip() if colon else None
        if name:
            out[name] = value.strip()
    return out


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Records of a WARC file: headers, block and None; for what isn't one, no
    headers, no block and what is wrong. Reading goes on where the next record
    begins. No more than a record and a piece of the file is held inflated."""
    pieces = inflated(data)
    held, at, over = bytearray(), 0, False
    wrong: list[str] = []

    def have(n: int) -> bool:
        """Read on until ``n`` bytes lie after ``at``."""
        nonlocal over, at
        while len(held) - at < n and not over and not wrong:
            piece = next(pieces, None)
            if piece is None:
                over = True
            elif isinstance(piece, str):
                wrong.append(piece)
            else:
                if at > 1 << 20:
                    del held[:at]
                    at = 0
                held.extend(piece)
        return len(held) - at >= n

    def skip(reason: str) -> tuple[dict, bytes, str]:
        """To the next line that only a record begins with."""
        nonlocal at
        at += 1
        while True:
            if found := _VERSION.search(held, at):
                at = found.start()
                break
            n = len(held) - at
            if not have(n + 1):
                at = len(held)
                break
            at += max(0, n - 16)
        return {}, b"", reason

    while True:
        if wrong and len(held) - at == 0:
            yield {}, b"", wrong.pop()
            continue
        if not have(1) and not wrong:
            return
        if held[at : at + 2] == b"\r\n":  # between records
            at += 2
            continue
        seen = 0
        while (end := held.find(b"\r\n\r\n", at + max(0, seen - 3))) < 0:
            seen = len(held) - at
            if not have(seen + 1):
                break
        if end < 0 and wrong:  # what a damaged member has begun
            del held[at:]
            continue
        if not held.startswith(b"WARC/", at) or end < 0:
            yield skip("no record begins here" if end >= 0 else "the file is cut off")
            continue
        head = header_fields(held[at:end].decode("utf-8", "replace").partition("\r\n")[2])
        length = head.get("Content-Length", "")
        if not length.isdecimal():
            yield skip("a record without its length")
            continue
        size = end + 4 - at + int(length)
        if not have(size):
            if wrong:
                del held[at:]
            else:
                yield {}, b"", "the file is cut off"
                return
            continue
        begin = at + size - int(length)
        yield head, bytes(held[begin : at + size]), None
        at += size


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC file's bytes: headers and block. Stops with an error
    at bytes that aren't a record."""
    for n, (head, block, wrong) in enumerate(read_records(data)):
        if wrong:
            raise ValueError(f"record {n}: {wrong}")
        yield head, block


def damage_in_warc(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """What ``responses_from_warc`` leaves out: ``(path, number, reason)``, ``number``
    counting records and gaps alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [(path, n, why) for n, (head, _, wrong) in enumerate(read_records(content or b"")) if (why := wrong or lacking(head))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string()))], ["path", "number", "reason"])

    picked = files.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).cast("binary").alias("content"))
    return map_rows(picked, run, "path string, number bigint, reason string")


def lacking(head: dict[str, str]) -> str | None:
    """Why a response can't be used: it has no id or no date."""
    gone = [k for k in ("WARC-Record-ID", "WARC-Date") if not head.get(k)] if head.get("WARC-Type") == "response" else []
    return f"a response without {gone[0]}" if gone else None


def packed(records: DataFrame, compress: bool = True) -> DataFrame:
    """``(key, type, warc)``: every record in the bytes of its WARC form; written
    one after the other they are a WARC file."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("type"), pa.array([serialise(r, compress) for r in batch.to_pylist()], pa.binary())],
                ["key", "type", "warc"],
            )

        return apply

    return map_batches(records, make, f"key {records.schema['key'].dataType.simpleString()}, type string, warc binary")

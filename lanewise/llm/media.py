"""Media columns: signature sniffing.

One Aho-Corasick automaton finds all magic bytes of a value in a single scan.
A hit counts only if the format's validator can walk the structure from there
and so states a length. The type of a value is that of the medium at its first
byte, whatever was declared; media that start later are carved out.

``store_wave`` and ``read_wave`` keep any bytes losslessly as 8-bit samples.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, utf8

# Magic bytes, where they stand in the file, and the media type.
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"WEBP", 8, "image/webp"),
    (b"WAVE", 8, "audio/wav"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
)
RATE = 8000
BLOCK = 64


class Seen(defaultdict):
    """What validators found out about one value, kept so that no part of it is
    walked twice: many signatures may lead into one chain of pages or chunks."""

    def __init__(self):
        super().__init__(dict)

    def follow(self, kind: str, at: int, step: Callable[[int], tuple[int | None, int | None]]) -> int | None:
        """Where the chain from ``at`` ends; ``step`` gives the next place, or
        None and the end (None: it breaks off)."""
        known, way, end = self[kind], [], None
        here: int | None = at
        while here is not None:
            if here in known:
                end = known[here]
                break
            way.append(here)
            here, end = step(here)
        known.update(dict.fromkeys(way, end))
        return end

    def next_zero(self, d: bytes, at: int) -> int:
        """The first zero byte from ``at`` on, or -1. Places are asked for in
        order, so the last answer often holds."""
        low, high = self["zero"].get("last", (0, 0))
        if not (low <= at and (high < 0 or at <= high)) or not self["zero"]:
            high = d.find(b"\0", at)
            self["zero"]["last"] = at, high
        return high

    def places(self, d: bytes, what: bytes) -> list[int]:
        """All places of ``what``, in order."""
        if what not in self["places"]:
            self["places"][what] = [m.start() for m in re.finditer(b"(?=" + re.escape(what) + b")", d)]
        return self["places"][what]


def _png(d: bytes, at: int, seen: Seen) -> int | None:
    def step(i: int) -> tuple[int | None, int | None]:
        if i + 12 > len(d):
            return None, None
        n, kind = struct.unpack_from(">I4s", d, i)
        if i + 12 + n > len(d) or zlib.crc32(memoryview(d)[i + 4 : i + 8 + n]) != struct.unpack_from(">I", d, i + 8 + n)[0]:
            return None, None
        return (None, i + 12 + n) if kind == b"IEND" else (i + 12 + n, None)

    end = seen.follow("png", at + 8, step) if d[at + 12 : at + 16] == b"IHDR" else None
    return end and end - at


def _jpeg(d: bytes, at: int, seen: Seen) -> int | None:
    if "coded" not in seen["jpeg marks"]:  # markers that may end coded data
        seen["jpeg marks"]["coded"] = [m.start() for m in re.finditer(rb"\xff(?=[^\x00\xd0-\xd7])", d, re.S)]
    marks = seen["jpeg marks"]["coded"]

    def step(i: int) -> tuple[int | None, int | None]:
        if i + 2 > len(d) or d[i] != 0xFF:
            return None, None
        mark = d[i + 1]
        if mark == 0xD9:
            return None, i + 2
        if mark == 0x01 or 0xD0 <= mark <= 0xD7:
            return i + 2, None
        if i + 4 > len(d) or (n := struct.unpack_from(">H", d, i + 2)[0]) < 2:
            return None, None
        i += 2 + n
        if mark == 0xDA:  # coded data up to the next marker that isn't stuffing
            k = bisect_left(marks, i)
            return (marks[k], None) if k < len(marks) else (None, None)
        return i, None

    end = seen.follow("jpeg", at + 2, step)
    return end and end - at


def _gif(d: bytes, at: int, seen: Seen) -> int | None:
    if at + 13 > len(d):
        return None
    colours = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def blocks(i: int) -> int:
        def step(k: int) -> tuple[int | None, int | None]:
            return (k + d[k] + 1, None) if k < len(d) and d[k] else (None, k + 1)

        return seen.follow("gif blocks", i, step)

    def step(i: int) -> tuple[int | None, int | None]:
        if i >= len(d):
            return None, None
        if d[i] == 0x3B:
            return None, i + 1
        if d[i] == 0x21:
            return blocks(i + 2), None
        if d[i] == 0x2C and i + 10 < len(d):
            return blocks(i + 11 + colours(d[i + 9])), None
        return None, None

    end = seen.follow("gif", at + 13 + colours(d[at + 10]), step)
    return end and end - at


def _bmp(d: bytes, at: int, seen: Seen) -> int | None:
    if at + 30 > len(d):
        return None
    size, spare, start, head = struct.unpack_from("<IIII", d, at + 2)
    fits = spare == 0 and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= start <= size
    return size if fits and at + size <= len(d) else None


def _riff(form: bytes, part: bytes) -> Callable[[bytes, int, Seen], int | None]:
    def walk(d: bytes, at: int, seen: Seen) -> int | None:
        if at + 20 > len(d) or d[at : at + 4] != b"RIFF" or d[at + 8 : at + 12] != form:
            return None
        end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
        if end > len(d):
            return None
        i, has = at + 12, False
        while i + 8 <= end:
            kind, n = struct.unpack_from("<4sI", d, i)
            has |= kind.startswith(part)
            i += 8 + n + (n & 1)
        return end - at if has and i == end else None

    return walk


def _flac(d: bytes, at: int, seen: Seen) -> int | None:
    def step(i: int) -> tuple[int | None, int | None]:
        if i + 4 > len(d):
            return None, None
        head = struct.unpack_from(">I", d, i)[0]
        i += 4 + (head & 0xFFFFFF)
        if head >> 31:  # frames run to the end of the value
            return None, len(d) if i + 2 <= len(d) and d[i] == 0xFF and d[i + 1] >> 2 == 0x3E else None
        return i, None

    # the first block describes the stream and has 34 bytes
    end = seen.follow("flac", at + 4, step) if d[at + 4 : at + 8] in (b"\0\0\0\x22", b"\x80\0\0\x22") else None
    return end and end - at


def _ogg(d: bytes, at: int, seen: Seen) -> int | None:
    def step(i: int) -> tuple[int | None, int | None]:
        if d[i : i + 5] != b"OggS\0" or i + 27 > len(d):
            return None, None
        table = d[i + 27 : i + 27 + d[i + 26]]
        last, i = d[i + 5] & 4, i + 27 + len(table) + sum(table)
        return (None, None) if i > len(d) else (None, i) if last else (i, None)

    end = seen.follow("ogg", at, step)
    return end and end - at


def _pdf(d: bytes, at: int, seen: Seen) -> int | None:
    ends, refs = seen.places(d, b"%%EOF"), seen.places(d, b"startxref")
    k, r = bisect_left(ends, at), bisect_left(refs, at)
    fits = k < len(ends) and r < len(refs) and refs[r] + 9 <= ends[k]
    return ends[k] + 5 - at if fits else None


def _zip(d: bytes, at: int, seen: Seen) -> int | None:
    if "starts" not in seen["zip"]:  # the first end record that counts back to a start
        starts: dict[int, int] = {}
        for end in seen.places(d, b"PK\x05\x06"):
            if end + 22 <= len(d):
                size, offset, note = struct.unpack_from("<IIH", d, end + 12)
                if end + 22 + note <= len(d):
                    starts.setdefault(end - offset - size, end + 22 + note)
        seen["zip"]["starts"] = starts
    end = seen["zip"]["starts"].get(at)
    return end and end - at


def _gzip(d: bytes, at: int, seen: Seen) -> int | None:
    if at + 18 > len(d) or d[at + 3] & 0xE0:
        return None
    flags, i = d[at + 3], at + 10
    if flags & 4:
        i += 2 + struct.unpack_from("<H", d, i)[0]
    for field in (8, 16):  # a name and a comment, each up to a zero byte
        if flags & field:
            if (i := seen.next_zero(d, i)) < 0:
                return None
            i += 1
    i += flags & 2
    if i not in seen["inflated"]:
        seen["inflated"][i] = _inflate(d, i)
    found = seen["inflated"][i]
    if found is None or found[0] + 8 > len(d) or struct.unpack_from("<II", d, found[0]) != found[1:]:
        return None
    return found[0] + 8 - at


def _inflate(d: bytes, at: int) -> tuple[int, int, int] | None:
    """End of the compressed data, and CRC-32 and length of what it holds."""
    unpack, i, crc, size, piece = zlib.decompressobj(-15), at, 0, 0, b""
    try:
        while not unpack.eof:
            if not piece:
                piece = d[i : i + 65536]
                i += len(piece)
            out = unpack.decompress(piece, 1 << 20)
            if not out and not unpack.eof and i >= len(d) and not unpack.unconsumed_tail:
                return None
            crc, size, piece = zlib.crc32(out, crc), size + len(out), unpack.unconsumed_tail
    except zlib.error:
        return None
    return i - len(unpack.unused_data), crc, size & 0xFFFFFFFF


VALIDATORS: dict[str, Callable[[bytes, int, Seen], int | None]] = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp,
    "image/webp": _riff(b"WEBP", b"VP8"), "audio/wav": _riff(b"WAVE", b"data"),
    "audio/flac": _flac, "audio/ogg": _ogg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip,
}


#: Bytes that are widened or decoded at once, and the longest signature.
CHUNK, REACH = 1 << 20, max(len(magic) for magic, *_ in MAGIC)


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, where, kind in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic) + where, kind))
    found.make_automaton()
    return found


def media_in(value: bytes, signatures) -> list[tuple[str, int, int]]:
    """Validated media ``(type, start, length)``: the one at the first byte, if
    any, then those that start later, leftmost first, without overlaps."""
    whole, inner, past, seen = [], [], 0, Seen()
    # a piece at a time, with what a signature may reach into the next
    hits = sorted({(at + end + 1 - back, kind) for at in range(0, len(value), CHUNK) for end, (back, kind) in signatures.iter(value[at : at + CHUNK + REACH].decode("latin-1"))})
    for start, kind in hits:
        if start < 0 or (start and start < past) or (not start and whole):
            continue
        length = VALIDATORS[kind](value, start, seen)
        if length:
            if start == 0:
                whole.append((kind, 0, length))
            else:
                inner.append((kind, start, length))
                past = start + length
    return whole + inner


def sniff_media(values: DataFrame, id_col: str, content_col: str, declared_col: str | None = None) -> DataFrame:
    """One row per row of ``values``: ``(id, declared, type, valid, media)``.

    ``type`` is what the bytes are; where no medium starts at the first byte it
    is the declared type and ``valid`` is false. ``media`` is an array of
    ``(type, start, length, sha256)``. Null and empty values have no media.
    """
    picked = values.select(
        F.col(id_col).alias("id"),
        (F.col(declared_col) if declared_col else F.lit(None)).cast("string").alias("declared"),
        F.col(content_col).cast("binary").alias("content"),
    )
    medium = pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())])

    def make():
        signatures = automaton()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            types, valid, media = [], [], []
            for declared, value in zip(batch.column(1).to_pylist(), utf8(batch.column(2))):
                found = media_in(value or b"", signatures)
                own = next((k for k, at, _ in found if not at), None)
                types.append(own or declared)
                valid.append(own is not None)
                media.append([
                    {"type": k, "start": a, "length": n, "sha256": hashlib.sha256(value[a : a + n]).hexdigest()} for k, a, n in found
                ])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(types, pa.string()), pa.array(valid, pa.bool_()), pa.array(media, pa.list_(medium))],
                ["id", "declared", "type", "valid", "media"],
            )

        return apply

    kind = picked.schema["id"].dataType.simpleString()
    return map_batches(
        picked, make,
        f"id {kind}, declared string, type string, valid boolean, media array<struct<type:string,start:bigint,length:bigint,sha256:string>>",
    )


def store_wave(payload: bytes) -> bytes:
    """The bytes as one channel of unsigned 8-bit samples."""
    pad = len(payload) & 1
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    body = b"WAVE" + form + struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * pad
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def read_wave(stored: bytes, signatures) -> bytes:
    """The samples of a stored wave, by way of its sniffed structure."""
    found = media_in(stored, signatures)
    if not found or found[0] != ("audio/wav", 0, len(stored)):
        raise ValueError("not one whole wave")
    i = 12
    while True:
        kind, n = struct.unpack_from("<4sI", stored, i)
        if kind == b"data":
            return stored[i + 8 : i + 8 + n]
        i += 8 + n + (n & 1)


def wave_features(samples: bytes) -> str:
    """Whole-number features: count, sum, sum of squares, least, most, crossings
    of the middle, then counts of samples in eight equal ranges."""
    x, counts, crossings = np.frombuffer(samples, np.uint8), np.zeros(256, np.int64), 0
    for at in range(0, len(x), CHUNK):
        part = x[at : at + CHUNK + 1]  # and the first of the next
        counts += np.bincount(part[:CHUNK], minlength=256)
        crossings += int(((part[1:] ^ part[:-1]) >= 128).sum())
    level, some = np.arange(256), np.flatnonzero(counts)
    numbers = [len(x), counts @ level, counts @ (level * level), some[0], some[-1], crossings, *counts.reshape(8, 32).sum(axis=1)]
    return f"wav/{RATE}/1/8;" + ",".join(str(int(n)) for n in numbers)


def text_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Every whole text stored as a wave, sniffed, read back and described; and the
    media that the text itself holds (a PDF pasted as it is, say).

    One row per row of ``docs``: ``(id, n_bytes, payload_sha256, payload_bytes,
    tail_crc32, media_type, media, feature, carved)`` with the media in the text as
    ``type:start:length``, comma-joined, in ``carved`` and the stored bytes in
    ``media`` (null unless ``with_media``: they needn't leave the worker then). The
    payload is the UTF-8 text (null: empty) filled with zero bytes to a positive
    multiple of 64. Equal texts give equal values.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def make():
        signatures = automaton()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in utf8(batch.column(1)):
                text = text or b""
                stored = store_wave(text + b"\0" * (-len(text) % BLOCK if text else BLOCK))
                back = read_wave(stored, signatures)
                out.append((
                    len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), "audio/wav",
                    len(stored), hashlib.sha256(stored).hexdigest(), stored if with_media else None, wave_features(back),
                    ",".join(f"{kind}:{at}:{size}" for kind, at, size in media_in(text, signatures)),
                ))
            n, p, s, c, t, m, h, b, f, w = zip(*out) if out else ((),) * 10
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()), pa.array(p, pa.int64()), pa.array(s, pa.string()), pa.array(c, pa.int64()),
                    pa.array(t, pa.string()), pa.array(m, pa.int64()), pa.array(h, pa.string()), pa.array(b, pa.binary()), pa.array(f, pa.string()),
                    pa.array(w, pa.string()),
                ],
                COLUMNS,
            )

        return apply

    kind = picked.schema["id"].dataType.simpleString()
    return map_batches(
        picked, make,
        f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_type string, "
        "media_bytes bigint, media_sha256 string, media binary, feature string, carved string",
    )


COLUMNS = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_type", "media_bytes", "media_sha256", "media", "feature", "carved"]

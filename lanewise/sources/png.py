"""PNG images as arrays: 8-bit grey, RGB, palette and RGBA, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels: np.ndarray, level: int = 6) -> bytes:
    """RGBA ``(height, width, 4)`` as PNG; equal pixels give equal bytes."""
    h, w, _ = pixels.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(pixels, np.uint8).reshape(h, w * 4)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, unit: int) -> np.ndarray:
    """Undo the five row filters; ``raw`` has the filter byte first in each row."""
    h, n = raw.shape[0], raw.shape[1] - 1
    out = np.zeros((h, n), np.uint8)
    above = np.zeros(n, np.uint8)
    for i in range(h):
        kind, row = int(raw[i, 0]), raw[i, 1:]
        if kind == 0:
            out[i] = row
        elif kind == 2:
            out[i] = row + above
        elif kind == 1:
            out[i] = np.cumsum(row.reshape(-1, unit).astype(np.uint32), axis=0).astype(np.uint8).reshape(-1)
        elif kind in (3, 4):
            line, up = bytearray(row.tobytes()), above.tobytes()
            for j in range(n):
                a = line[j - unit] if j >= unit else 0
                b = up[j]
                if kind == 3:
                    line[j] = (line[j] + (a + b) // 2) & 255
                    continue
                c = up[j - unit] if j >= unit else 0
                p = a + b - c
                pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                line[j] = (line[j] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
            out[i] = np.frombuffer(bytes(line), np.uint8)
        else:
            raise ValueError(f"row filter {kind}")
        above = out[i]
    return out


def decode(data: bytes | None) -> np.ndarray | None:
    """RGBA pixels, or None for what isn't such a PNG or is damaged."""
    if not data or data[:8] != MAGIC:
        return None
    at, body, palette, alpha, head = 8, b"", None, b"", None
    try:
        while at < len(data):
            n, kind = struct.unpack_from(">I4s", data, at)
            part = data[at + 8 : at + 8 + n]
            if len(part) < n or zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + n)[0]:
                return None
            at += 12 + n
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif kind == b"PLTE":
                palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
            elif kind == b"tRNS":
                alpha = part
            elif kind == b"IDAT":
                body += part
            elif kind == b"IEND":
                break
        w, h, depth, colour, _, _, lace = head
        if depth != 8 or lace or colour not in CHANNELS:
            return None
        unit = CHANNELS[colour]
        x = _unfilter(np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * unit + 1), unit).reshape(h, w, unit)
    except (struct.error, zlib.error, ValueError, TypeError):
        return None
    full = np.full((h, w, 1), 255, np.uint8)
    if colour == 6:
        return x
    if colour == 2:
        return np.concatenate([x, full], axis=2)
    if colour in (0, 4):
        return np.concatenate([np.repeat(x[..., :1], 3, axis=2), x[..., 1:] if colour == 4 else full], axis=2)
    table = np.full(256, 255, np.uint8)
    table[: len(alpha)] = np.frombuffer(alpha, np.uint8)
    if palette is None or x.max() >= len(palette):
        return None
    return np.concatenate([palette[x[..., 0]], table[x[..., 0]][..., None]], axis=2)

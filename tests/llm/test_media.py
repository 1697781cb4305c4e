import hashlib
import struct
import zlib

import pytest

from lanewise.llm import media as M


def png(w=2, h=2):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress((b"\0" + b"\1\2\3\4" * w) * h)) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff\x2c\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02\x44\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02\x11\xff\x00\x22\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\1\2\0"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
ZIP = b"PK\x03\x04" + b"\0" * 26 + b"PK\x01\x02" + b"\0" * 42 + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, 46, 30, 0)


def gzip_bytes():
    import gzip

    return gzip.compress(b"some text " * 50, mtime=0)


ALL = {
    "image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "application/pdf": PDF, "application/zip": ZIP,
    "application/gzip": gzip_bytes(), "audio/wav": M.store_wave(b"abc"),
}


@pytest.mark.parametrize("kind", ALL)
def test_each_format_is_found_with_its_length(kind):
    signatures = M.automaton()
    value = ALL[kind]
    assert M.media_in(value, signatures)[0] == (kind, 0, len(value))
    assert (kind, 5, len(value)) in M.media_in(b"12345" + value + b"tail", signatures)
    if kind not in ("image/jpeg", "application/pdf"):
        assert not [x for x in M.media_in(value[:-1], signatures) if x[0] == kind and x[1] == 0]


def test_magic_without_structure_is_no_medium():
    signatures = M.automaton()
    for magic, _, _ in M.MAGIC:
        assert M.media_in(magic + b" just text that goes on for a while and has no structure at all", signatures) == []


def test_sniffing_corrects_declared_types_and_carves(spark):
    rows = [(1, "image/jpeg", png()), (2, "text/plain", b"header" + GIF + b"between" + png() + b"end"), (3, "image/png", b"not an image"), (4, None, None), (5, "image/gif", b"")]
    df = spark.createDataFrame([(i, d, bytearray(c) if c is not None else None) for i, d, c in rows], "id bigint, declared string, content binary")
    got = {r.id: r for r in M.sniff_media(df, "id", "content", "declared").collect()}
    assert (got[1].type, got[1].valid) == ("image/png", True)
    assert (got[2].type, got[2].valid) == ("text/plain", False)
    assert [(m.type, m.start, m.sha256) for m in got[2].media] == [("image/gif", 6, hashlib.sha256(GIF).hexdigest()), ("image/png", 13 + len(GIF), hashlib.sha256(png()).hexdigest())]
    assert (got[3].type, got[3].media, got[4].type, got[5].media) == ("image/png", [], None, [])


def test_query_against_brute_force(spark, data, small):
    from lanewise.llm.queries import op5_media_sniffing

    got = {r.doc_id: r for r in op5_media_sniffing(spark, data).collect()}
    for doc, text in small:
        raw = text.encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        stored = M.store_wave(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_edge_cases(docs, rows, none):
    got = M.text_as_media(docs).collect()
    assert len(got) == len(rows)
    assert {r.payload_bytes for r in got if r.n_bytes == 0} == {64}
    assert all(M.read_wave(bytes(r.media), M.automaton())[: r.n_bytes] is not None for r in got)
    assert M.text_as_media(none).count() == 0


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


OGG = b"OggS\0\0" + b"\0" * 20 + b"\0"
FRAME = GIF[:-1]

CHAINS = {
    "ogg": (OGG, b""),
    "png": (chunk(b"teXt", b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13)), b""),
    "jpeg": (b"\xff\xd8\xff\xda\x00\x02ab", b""),
    "gif": (b"GIF89a" + b"\0" * 7, b""),
    "gif blocks": (b"GIF89a\0\0\0\0\0\0\0\x21\xfe\x05abcde", b"\x05"),
    "pdf": (b"%PDF-", b""),
    "zip": (b"PK\x03\x04", b""),
    "zip ends": (b"PK\x03\x04PK\x05\x06", b"\xff" * 18),
    "flac": (b"fLaC\0\0\0\x22" + b"\0" * 34, b""),
    "gzip": (b"\x1f\x8b\x08", b""),
    "bmp": (b"BM", b""),
}


@pytest.mark.parametrize("name", CHAINS)
def test_long_chains_of_signatures_take_linear_time(name):
    import time

    signatures = M.automaton()
    one, more = CHAINS[name]
    took = []
    for n in (5_000, 40_000):
        value = (one + more) * n
        start = time.process_time()
        M.media_in(value, signatures)
        took.append(time.process_time() - start)
    assert took[1] < 40 * took[0] + 0.5


def test_gzip_headers_with_fields():
    import gzip
    import io

    signatures = M.automaton()
    out = io.BytesIO()
    with gzip.GzipFile("a name", "wb", fileobj=out, mtime=0) as f:
        f.write(b"some text " * 200_000)
    value = out.getvalue()
    assert M.media_in(value, signatures) == [("application/gzip", 0, len(value))]
    body = gzip_bytes()[10:]
    every = b"\x1f\x8b\x08\x1f\0\0\0\0\0\xff" + b"\x03\0abc" + b"name\0" + b"comment\0" + b"\x12\x34" + body
    assert M.media_in(b"x" + every + b"y", signatures) == [("application/gzip", 1, len(every))]
    broken = every[:-5] + bytes([every[-5] ^ 1]) + every[-4:]
    assert M.media_in(broken, signatures) == [] and M.media_in(every[:-1], signatures) == []


def test_a_chain_that_ends_is_found_from_each_of_its_pages():
    signatures = M.automaton()
    last = OGG[:5] + b"\4" + OGG[6:]
    assert M.media_in(b"x" + OGG * 3 + last + OGG + last, signatures) == [("audio/ogg", 1, 108), ("audio/ogg", 109, 54)]
    assert M.media_in(OGG * 2 + last, signatures) == [("audio/ogg", 0, 81), ("audio/ogg", 27, 54)]
    assert M.media_in(OGG * 5, signatures) == []


def test_stored_bytes_stay_with_the_worker_unless_asked_for(docs):
    with_, without = M.text_as_media(docs), M.text_as_media(docs, with_media=False)
    assert all(r.media is None for r in without.collect())
    key = lambda r: (r.id is None, r.id, r.media_sha256)
    assert sorted(map(key, with_.collect())) == sorted(map(key, without.collect()))


def test_media_inside_a_text_are_carved(spark):
    rows = [(1, "see " + PDF.decode() + " and " + PDF.decode()), (2, PDF.decode()), (3, "%PDF- but no more"), (4, None), (5, "ü" + PDF.decode())]
    got = {r.id: r.carved for r in M.text_as_media(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    one, kind = len(PDF), "application/pdf"
    assert got == {1: f"{kind}:4:{one},{kind}:{4 + one + 5}:{one}", 2: f"{kind}:0:{one}", 3: "", 4: "", 5: f"{kind}:2:{one}"}


def test_features_in_chunks(monkeypatch):
    """By plain loops, over chunks of any size, and in memory that a text doesn't set."""
    import random
    import tracemalloc

    from lanewise.llm import media as M

    r = random.Random(1)
    for n in (1, 2, 63, 64, 65, 500):
        x = bytes(r.choice([0, 127, 128, 255, r.randrange(256)]) for _ in range(n))
        bands = [sum(v // 32 == k for v in x) for k in range(8)]
        want = [n, sum(x), sum(v * v for v in x), min(x), max(x), sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:])), *bands]
        for chunk in (1, 7, 64, 1 << 20):
            monkeypatch.setattr(M, "CHUNK", chunk)
            assert M.wave_features(x).split(";")[1] == ",".join(map(str, want))
    monkeypatch.setattr(M, "CHUNK", 1 << 20)
    x = bytes(60_000_000)
    tracemalloc.start()
    M.wave_features(x)
    assert tracemalloc.get_traced_memory()[1] < 30_000_000
    tracemalloc.stop()


def test_signatures_over_the_ends_of_chunks(monkeypatch):
    from lanewise.llm import media as M

    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\x0dIHDR" + bytes(13) + bytes(4)
    value = b"..GIF89a" + png * 3 + b"%PDF-1.4 PK\x03\x04 fLaC RIFF....WAVE OggS" + b"z" * 50
    signatures = M.automaton()
    whole = M.media_in(value, signatures)
    for chunk in (1, 5, 8, 13):
        monkeypatch.setattr(M, "CHUNK", chunk)
        assert M.media_in(value, signatures) == whole

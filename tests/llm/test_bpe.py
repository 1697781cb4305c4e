"""Byte-level BPE against the tiktoken library, and back."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.errors import PythonException

from lanewise.llm import bpe as B


@pytest.fixture(scope="module")
def lines():
    with open(B.default_vocabulary(), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def encoder(lines):
    return B.Encoder(lines, B.code_point_classes())


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def ids_of(encoder, texts):
    ids, _, cut = encoder.encode([t.encode() for t in texts])
    return [ids[a:b].tolist() for a, b in zip(cut, cut[1:])]


def test_random_texts_as_the_library_has_them(encoder, library):
    r = random.Random(5)
    some = ["'", "'", "s", "t", "r", "e", "v", "l", "m", "d", "L", " ", " ", "\n", "\t", "\r", "a", "Z", "9", "1", "!", ".", "é", "漢", "　", " ", "😀", "́", "²", "ª", "\0", "\x1c", "\x85", "᠎", "﻿", "<|endoftext|>"]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 30))) for _ in range(8000)]
    texts += ["x" * 3000, "ab" * 2000, "'" * 999, "", "\0", " " * 3000, "'re'll've'm 's", "é" * 2000]
    assert ids_of(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_every_code_point(encoder, library):
    """In runs of unlike neighbours, so that each class is seen."""
    every = [*range(0xD800), *range(0xE000, 0x110000, 7)]
    random.Random(1).shuffle(every)
    texts = ["".join(map(chr, every[i : i + 500])) for i in range(0, len(every), 500)]
    assert ids_of(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_scan_is_the_automaton_step_by_step():
    r = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 65, 1000, 4099):
        kinds = r.integers(0, B.BREAK + 1, n)
        after = B._FROM[B.scan(B._OF[kinds])]
        state, want = B.FRESH, []
        for k in kinds.tolist():
            state = B.step(state, k)[0]
            want.append(state)
        assert after.tolist() == want


def test_composition_is_associative():
    n, t = B._SIDE, B._THEN
    a, b, c = np.meshgrid(*[np.arange(n)] * 3, indexing="ij")
    assert (t[t[a, b], c] == t[a, t[b, c]]).all()


def test_both_ways_of_merging_agree(encoder):
    r = random.Random(2)
    for _ in range(300):
        piece = "".join(r.choice("abeinrst ") for _ in range(r.randint(2, 60))).encode()
        if piece not in encoder.ranks:
            assert B.merge(piece, encoder.ranks) == B.merge_long(piece, encoder.ranks)


def test_long_texts_in_segments(encoder, library):
    text = " it's  a\n word " * 400 + "'re" + " end" * 3000
    parts = list(B.segments(text.encode(), 700))
    assert b"".join(parts) == text.encode() and len(parts) > 5
    whole = library.encode_ordinary(text)
    assert [i for p in parts for i in library.encode_ordinary(p.decode())] == whole
    ids, offsets, cut = encoder.encode_long(text.encode())
    assert ids.tolist() == whole and offsets[0] == 0 and cut.tolist() == [0, len(whole)]
    assert list(B.segments(b"x" * 5000, 700)) == [b"x" * 5000]


def test_query_round_trip(spark, data, small, library):
    from lanewise.llm.queries import op12_byte_bpe

    got = {r.doc_id: r for r in op12_byte_bpe(spark, data).collect()}
    assert len(got) == len(small)
    for doc, text in small:
        ids = library.encode_ordinary(text or "")
        assert got[doc].n_tokens == len(ids)
        assert got[doc].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_edge_cases(spark, docs, rows, none):
    encoded = B.encode_documents(docs).cache()
    assert encoded.columns == ["id", "ids", "offsets"]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    decoded = [(r.id, bytes(r.data)) for r in B.decode_tokens(encoded).collect()]
    assert sorted(decoded, key=key) == sorted([(r[0], (r[1] or "").encode()) for r in rows], key=key)
    assert B.encode_documents(none).count() == 0 and B.decode_tokens(B.encode_documents(none)).count() == 0


def test_offsets_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, [10, 11], [0, 7])], "id bigint, ids array<int>, offsets array<bigint>")
    with pytest.raises(PythonException, match="belong together"):
        B.decode_tokens(df).collect()
    empty = spark.createDataFrame([(1, None, None), (2, [], [])], "id bigint, ids array<int>, offsets array<bigint>")
    assert [bytes(r.data) for r in B.decode_tokens(empty).collect()] == [b"", b""]

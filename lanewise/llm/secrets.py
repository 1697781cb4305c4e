"""Secret scans: fixed patterns plus a token-efficiency test.

A byte-pair vocabulary learnt from natural text spends few tokens on words and
many on random strings. A run of key-like characters is cut into the pieces between
its separators, so that a path or a name before a key isn't averaged with it. A
piece, or a row of pieces none of which is a word, whose characters per token stay at
or under a limit is reported, after digests of known lengths, UUIDs and other
identifiers are excluded. The fixed patterns are reported in any case.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from functools import lru_cache
from string import ascii_lowercase

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# The patterns of the base kinds, in the order in which ties sort.
BASE = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: Kind of the spans that the token-efficiency test adds.
RANDOM = "random"
KINDS = (*(k for k, *_ in BASE), RANDOM)

_HEX24 = re.compile(r"[0-9a-f]{24,}")
#: Least length of a string that the token-efficiency test may report.
LEAST = 20
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_UUID = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])")
_PIECE = re.compile(r"[A-Za-z0-9+]+")
_ONE_CASE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hex.
DIGESTS = frozenset({32, 40, 56, 64, 96, 128})
_IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9]+([-/_=+][0-9]+)*"  # numbers, dates
    r"|=+|-+|_+|/+|\++"
    r"|[A-Za-z]([-/_=+]+[A-Za-z])*"  # spelt out, letter by letter
)
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


def default_vocabulary() -> str:
    """Path of the public byte-level vocabulary (tiktoken ranks)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_encoding(ranks_file: bytes):
    """The encoding of a file of tiktoken ranks."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(candidate: str) -> bool:
    """A digest of a known length, a UUID, a number, a rule or an alphabet."""
    return bool(_IDENTIFIER.fullmatch(candidate)) or candidate.lower() in ascii_lowercase or (len(candidate) in DIGESTS and bool(_HEX.fullmatch(candidate)))


def is_random(candidate: str, tokens: int, most_chars_per_token: float) -> bool:
    """A low ratio. With hardly any letters it is a date or a list of numbers,
    whose digits take many tokens too."""
    return sum(c.isalpha() for c in candidate) >= 3 and len(candidate) <= most_chars_per_token * tokens


def random_spans(run: str, count, most_chars_per_token: float) -> list[tuple[int, int]]:
    """Where a run of key-like characters has random strings of ``LEAST`` characters
    or more: pieces between separators that pass by themselves; else rows of pieces
    none of which is a word (a key in base64 has separators of its own). UUIDs and
    digests end a row and are in none."""
    def passes(a: int, b: int) -> bool:
        c = run[a:b]
        return len(c) >= LEAST and not known(c) and is_random(c, count(c), most_chars_per_token)

    out: list[tuple[int, int]] = []
    row: list[tuple[int, int]] = []

    def close() -> None:
        if row:
            a, b = row[0][0], row[-1][1]
            # padding belongs to what it ends
            while b < len(run) and run[b] == "=":
                b += 1
            if passes(a, b):
                out.append((a, b))
            row.clear()

    taken = [m.span() for m in _UUID.finditer(run)]
    for m in _PIECE.finditer(run):
        a, b = m.span()
        c = m[0]
        if any(x < b and a < y for x, y in taken) or (len(c) in DIGESTS and _HEX.fullmatch(c)):
            close()
        elif passes(a, b):
            close()
            out.append((a, b))
        elif len(c) > 3 and len(c) > most_chars_per_token * count(c) * (1 if _ONE_CASE.fullmatch(c) else 1.5):
            close()  # a word; letters of mixed case and digits have to be more like one
        else:
            row.append((a, b))
    close()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds by start, then kind."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        # runs of 24 or more hex digits are the runs of any length that pass
        for m in (_HEX24 if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    most_chars_per_token: float = 2.0,
) -> DataFrame:
    """One row per row of ``docs``: ``(id, spans, base, digest)``.

    ``spans`` is an array of ``(kind, start, end, secret)`` by start, then kind
    (code points, end exclusive); of a run of key-like characters that meets base
    spans, what they leave is tested. ``base`` counts the base kinds in order, ``digest`` is the
    SHA-256 of the base spans as ``kind:start:end``. Null and empty texts have
    no spans; repeated rows are kept; an empty table gives an empty one.
    """
    # the file is read here and sent: executors need not have it
    with open(vocabulary or default_vocabulary(), "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rank = {k: i for i, k in enumerate(KINDS)}
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())])

    def make():
        encoding = load_encoding(ranks.value)

        @lru_cache(maxsize=1 << 16)
        def count(candidate: str) -> int:
            return len(encoding.encode_ordinary(candidate))

        def tokens(candidate: str) -> int:
            return count(candidate) if len(candidate) <= 512 else len(encoding.encode_ordinary(candidate))

        def spans(text: str):
            base = base_spans(text)
            taken = sorted((a, b) for _, a, b in base)
            more, at = [], 0
            for m in _CANDIDATE.finditer(text):
                a, b = m.span()
                while at < len(taken) and taken[at][1] <= a:
                    at += 1
                # what the base spans leave of the run
                for x, y in [*taken[at : bisect_left(taken, (b,), at)], (b, b)]:
                    if x - a >= LEAST:
                        more += [(RANDOM, a + i, a + j) for i, j in random_spans(text[a:x], tokens, most_chars_per_token)]
                    a = max(a, y)
            return base, sorted([*base, *more], key=lambda s: (s[1], rank[s[0]]))

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            every, counts, digests = [], [], []
            for text in batch.column(1).to_pylist():
                base, all_ = spans(text or "")
                every.append([{"kind": k, "start": a, "end": b, "secret": text[a:b]} for k, a, b in all_])
                kinds = [k for k, _, _ in base]
                counts.append([kinds.count(k) for k, *_ in BASE])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(every, pa.list_(span)), pa.array(counts, pa.list_(pa.int64())), pa.array(digests, pa.string())],
                ["id", "spans", "base", "digest"],
            )

        return apply

    kind = picked.schema["id"].dataType.simpleString()
    return map_batches(
        picked, make, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,secret:string>>, base array<bigint>, digest string"
    )

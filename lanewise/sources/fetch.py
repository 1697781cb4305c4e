"""Fetching tiles: paced, retried, validated, and checked as a capture.

The transport is a function from a URL to ``(status, bytes)``, so any client
will do and tests need no network.
"""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tiles import coverage, gap_tiles, missing_tiles
from . import png

Transport = Callable[[str], tuple[int, bytes]]
BLOCKED, SLOWER = 403, (429, 503)
RETRY = (408, 429, 500, 502, 503, 504)
RESULT = "x bigint, y bigint, content binary, reason string, tries int"


@dataclass
class Pace:
    """A jittered gap between requests of one task; halves its rate when told to,
    up to four times."""

    rate: float
    slowed: int = 0
    next_at: float = 0.0

    def wait(self, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic) -> None:
        t = now()
        if t < self.next_at:
            sleep(self.next_at - t)
        self.next_at = max(t, self.next_at) + random.uniform(0.8, 1.2) / self.rate

    def slow(self) -> None:
        if self.slowed < 4:
            self.slowed += 1
            self.rate /= 2


class Blocked(RuntimeError):
    """Too many refusals in a row."""


@dataclass
class Streak:
    limit: int = 25
    run: int = 0

    def see(self, status: int) -> None:
        self.run = self.run + 1 if status == BLOCKED else 0
        if self.run >= self.limit:
            raise Blocked(f"{self.run} refusals in a row")


def verdict(data: bytes, tile_px: int = 256) -> str:
    """'ok' or why a tile is refused."""
    if len(data) < 67:
        return "too_small"
    if data[:8] != png.MAGIC:
        return "not_png"
    if not data.endswith(b"IEND\xaeB`\x82"):
        return "truncated"
    image = png.decode(data)
    if image is None:
        return "decode_error"
    h, w = image.shape[:2]
    if (w, h) != (tile_px, tile_px):
        return f"size_{w}x{h}"
    return "opaque" if image[..., 3].min() > 128 else "ok"


def fetch_tiles(
    targets: DataFrame, url: str, transport: Transport, rate: float = 12.0, retries: int = 4, tile_px: int = 256, block_limit: int = 25,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """``targets(x, y)`` fetched in parallel: ``(x, y, content, reason, tries)``.

    ``rate`` is per task. Overload statuses slow the task and are tried again
    after a growing pause, other refusals are final; a run of 403s fails the task
    and with it the job. Content is null unless the tile is valid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace, streak = Pace(rate), Streak(block_limit)

        def one(x: int, y: int) -> tuple[bytes | None, str, int]:
            reason = "none"
            for n in range(retries + 1):
                pace.wait(sleep)
                try:
                    status, data = transport(url.format(x=x, y=y))
                except OSError as e:
                    status, data, reason = 503, b"", type(e).__name__
                streak.see(status)
                if status == 200:
                    reason = verdict(data, tile_px)
                    if reason == "ok":
                        return data, reason, n + 1
                else:
                    reason = f"http_{status}"
                    if status in SLOWER:
                        pace.slow()
                    if status not in RETRY:
                        return None, reason, n + 1
                if n < retries:
                    sleep(min(8.0, 2.0**n) + random.random())
            return None, reason, retries + 1

        for batch in batches:
            xs, ys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [one(x, y) for x, y in zip(xs, ys)]
            c, r, n = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c, pa.binary()), pa.array(r, pa.string()), pa.array(n, pa.int32())], ["x", "y", "content", "reason", "tries"])

    return targets.select(F.col("x").cast("bigint"), F.col("y").cast("bigint")).mapInArrow(run, RESULT)


def capture(expected: DataFrame, sweep: Callable[[DataFrame], DataFrame], traffic: Callable[[DataFrame], DataFrame], passes: int = 2) -> tuple[DataFrame, dict]:
    """Sweep, sweep again what is missing, then what lies between tiles with
    traffic; the tiles and the checks of a manifest.

    ``sweep`` fetches targets, ``traffic`` keeps tiles that show some."""
    from ..materialise import cut

    got = cut(sweep(expected).where("content IS NOT NULL"))
    for _ in range(passes - 1):
        left = missing_tiles(expected, got)
        if left.isEmpty():
            break
        got = cut(got.unionByName(sweep(left).where("content IS NOT NULL")))
    gaps = gap_tiles(missing_tiles(expected, got), traffic(got))
    if not gaps.isEmpty():
        got = cut(got.unionByName(sweep(gaps.select("x", "y")).where("content IS NOT NULL")))
    c = coverage(expected, got).first()
    checks = {"coverage_full": c["missing"] == 0, "some_tiles": c["received"] > 0}
    status = "failed" if not checks["some_tiles"] else "ok" if checks["coverage_full"] else "partial"
    return got, {"expected_tiles": c["expected"], "received_tiles": c["received"], "coverage_pct": c["coverage_pct"], "checks": checks, "status": status}


def tampered(stored: DataFrame, audit: DataFrame) -> DataFrame:
    """Tiles whose bytes differ from their audit's digest."""
    now = stored.select("x", "y", F.sha2("content", 256).alias("now"))
    return audit.where("sha256 IS NOT NULL").join(now, ["x", "y"], "left").where(~F.col("sha256").eqNullSafe(F.col("now"))).select("x", "y")


def pending(captures: DataFrame, done: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Captures in a range of days that aren't done, newest first."""
    out = captures.join(done.select("name").distinct(), "name", "left_anti")
    day = F.to_date("ts")
    if first:
        out = out.where(day >= F.lit(first).cast("date"))
    if last:
        out = out.where(day <= F.lit(last).cast("date"))
    return out.orderBy(F.desc("ts"), F.desc("name"))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

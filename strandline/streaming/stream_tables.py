"""Stream tables: per-user event logs whose rows expire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import versions as V

HOUR_MS = 3_600_000
#: The bucket of a log by its time to live: up to a day, a week, 30 days, and beyond.
BUCKETS = ((86_400, "hour", HOUR_MS), (7 * 86_400, "day", 24 * HOUR_MS), (30 * 86_400, "week", 7 * 24 * HOUR_MS), (float("inf"), "month", 30 * 24 * HOUR_MS))


def bucket(ttl_seconds: int) -> tuple[str, int]:
    """Name and length in milliseconds of the buckets for a time to live."""
    return next((name, ms) for most, name, ms in BUCKETS if ttl_seconds <= most)


def bucket_start(seq: Column, ttl_seconds: int) -> Column:
    size = bucket(ttl_seconds)[1]
    ms = ids.seq_ms(seq)
    return ms - F.pmod(ms, F.lit(size))


def alive(seq: Column, ttl_seconds: int, now_ms: int) -> Column:
    return ids.seq_ms(seq) + ttl_seconds * 1000 > now_ms


def scan(log: DataFrame, ttl_seconds: int, now_ms: int, since: int | None = None, most: int | None = None) -> DataFrame:
    """Rows that have not expired, by _seq; a cap only if one is asked for."""
    out = log.filter(alive(F.col(V.SEQ), ttl_seconds, now_ms))
    if since is not None:
        out = out.filter(F.col(V.SEQ) > since)
    out = out.orderBy(V.SEQ)
    return out if most is None else out.limit(most)


def time_range(log: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Rows of a time range; the bounds are bounds of _seq, so they reach the scan."""
    return log.filter((F.col(V.SEQ) >= ids.seq_floor(start_ms)) & (F.col(V.SEQ) < ids.seq_floor(end_ms)))

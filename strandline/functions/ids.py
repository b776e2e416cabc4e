"""Identifiers made by JVM expressions: version ids, Snowflake ids, UUIDv7, ULID."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Version ids count milliseconds from 2024-01-01 UTC; SNOWFLAKE_ID() counts them from 1970.
SEQ_EPOCH_MS = 1_704_067_200_000
TIME_SHIFT, WORKER_SHIFT, SEQUENCE_BITS = 22, 12, 12
#: Fixed value: the digits of base 32 in ULIDs.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def seq_ms(seq: Column) -> Column:
    """Unix milliseconds of a version id."""
    return F.shiftright(seq, TIME_SHIFT) + F.lit(SEQ_EPOCH_MS)


def seq_floor(ms: int) -> int:
    """The least version id of a millisecond."""
    return max(0, ms - SEQ_EPOCH_MS) << TIME_SHIFT


def seq_ceiling(ms: int) -> int:
    """The greatest version id of a millisecond: the boundary of a snapshot taken then."""
    return seq_floor(ms) | ((1 << TIME_SHIFT) - 1)


def row_ids(ms: int, epoch_ms: int = 0) -> Column:
    """A unique, time-ordered 64-bit id for each row of a batch that starts at ``ms``.

    The partition is the worker (10 bits), the row's place in it the sequence (12 bits); each further 4096 rows take the next
    millisecond. Every further 1024 partitions start 2**20 ms later. No global counter, no shuffle."""
    m = F.monotonically_increasing_id()
    part, row = F.shiftright(m, 33), m.bitwiseAND(F.lit((1 << 33) - 1))
    time = F.lit(ms - epoch_ms) + F.shiftright(row, SEQUENCE_BITS) + F.shiftleft(F.shiftright(part, 10), 20)
    return F.shiftleft(time, TIME_SHIFT) + F.shiftleft(part % 1024, WORKER_SHIFT) + row.bitwiseAND(F.lit((1 << SEQUENCE_BITS) - 1))


def snowflake_id() -> Column:
    """A Snowflake id with the Unix epoch."""
    m = F.monotonically_increasing_id()
    part, row = F.shiftright(m, 33), m.bitwiseAND(F.lit((1 << 33) - 1))
    time = F.unix_millis(F.current_timestamp()) + F.shiftright(row, SEQUENCE_BITS) + F.shiftleft(F.shiftright(part, 10), 20)
    return F.shiftleft(time, TIME_SHIFT) + F.shiftleft(part % 1024, WORKER_SHIFT) + row.bitwiseAND(F.lit((1 << SEQUENCE_BITS) - 1))


def uuid_v7() -> Column:
    """A time-ordered UUID: 48 bits of milliseconds, then the random bits of a version 4 UUID."""
    time = F.lower(F.lpad(F.hex(F.unix_millis(F.current_timestamp())), 12, "0"))
    return F.element_at(F.transform(F.array(F.uuid()), lambda u: F.concat(F.substring(time, 1, 8), F.lit("-"), F.substring(time, 9, 4), F.lit("-7"), F.substring(u, 16, 3), F.lit("-"), F.substring(u, 20, 4), F.lit("-"), F.substring(u, 25, 12))), 1)


def ulid() -> Column:
    """A ULID: 48 bits of milliseconds and 80 random bits in base 32."""
    time = F.unix_millis(F.current_timestamp())
    digit = lambda v, k: F.substring(F.lit(CROCKFORD), (F.shiftright(v, 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    draw = lambda: F.floor(F.rand() * (1 << 40)).cast("long")
    low = F.element_at(F.transform(F.array(F.struct(draw().alias("a"), draw().alias("b"))), lambda r: F.concat(*(digit(r["a"], k) for k in range(7, -1, -1)), *(digit(r["b"], k) for k in range(7, -1, -1)))), 1)
    return F.concat(*(digit(time, k) for k in range(9, -1, -1)), low)

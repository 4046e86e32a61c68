"""Column expressions of the record engine: everything here stays inside generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import invalid

#: Bytes of a block header and of a record envelope.
BLOCK_HEADER, ENVELOPE = 128, 32
#: Aggregate flags of a block.
ANOMALY, UNSYNCHRONIZED = 1, 2
APPLICATION_FLAGS = 0xFFFF0000
U64 = "decimal(20,0)"


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c.cast("timestamp_ntz"))


def may_be_in(ts: str, begin: int, end: int) -> Column:
    """Bounds in whole microseconds that hold for every timestamp of [begin, end) in nanoseconds.

    A comparison of the bare column, which reaches the scan's row groups; the exact filter stays on top.
    """
    at = lambda us: F.expr(f"TIMESTAMPADD(MICROSECOND, {us}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    clamp = lambda us: max(-62_135_596_800_000_000, min(253_402_300_799_999_999, us))
    return (F.col(ts) >= at(clamp(begin // 1000))) & (F.col(ts) <= at(clamp(-(-end // 1000))))


def unsigned(bits: Column) -> Column:
    """A signed 64-bit pattern as the unsigned number it stands for."""
    d = bits.cast(U64)
    return F.when(bits < 0, d + F.lit("18446744073709551616").cast(U64)).otherwise(d).cast(U64)


def signed(number: Column) -> Column:
    """An unsigned number as its signed 64-bit pattern."""
    d = number.cast(U64)
    half = F.lit("9223372036854775808").cast(U64)
    return F.when(d >= half, d - F.lit("18446744073709551616").cast("decimal(21,0)")).otherwise(d).cast("long")


def check_range(begin: int, end: int) -> None:
    if not -(1 << 63) <= begin < end <= (1 << 63) - 1:
        raise invalid(f"[{begin}, {end}) is no time range")


def check_domain(domain: int) -> None:
    if not 0 < domain < 1 << 64:
        raise invalid(f"{domain} is no time domain")


def in_range(time: str, begin: int, end: int) -> Column:
    """begin <= time < end."""
    check_range(begin, end)
    return (F.col(time) >= begin) & (F.col(time) < end)


def meets_range(begin: int, end: int, lo: str = "min_time_ns", hi: str = "max_time_ns") -> Column:
    """Whether a closed block envelope meets the half-open range: no record in range is lost by it."""
    check_range(begin, end)
    return (F.col(lo) < end) & (F.col(hi) >= begin)


def one_of(selector: str, wanted: Iterable[int]) -> Column:
    """Membership in a set of selectors; an empty set filters nothing."""
    some = sorted(set(wanted))
    return F.col(selector).isin(some) if some else F.lit(True)


def distance(a: Column, b: Column) -> Column:
    """|a - b| of two longs, which can exceed a long."""
    return F.abs(a.cast(U64) - b.cast(U64))


def has_bit(flags: str | Column, mask: int) -> Column:
    c = F.col(flags) if isinstance(flags, str) else flags
    return c.bitwiseAND(F.lit(mask)) != 0


def block_flags(flags: str | Column) -> Column:
    """What a record's flags add to its block's: the unsynchronized bit and the application's."""
    c = F.col(flags) if isinstance(flags, str) else flags
    c = c.cast("long")
    return F.when(c.bitwiseAND(F.lit(1)) != 0, UNSYNCHRONIZED).otherwise(0).cast("long").bitwiseOR(c.bitwiseAND(F.lit(APPLICATION_FLAGS)))


def align_up(value: Column, quantum: int) -> Column:
    """The least multiple of quantum that isn't below value."""
    if quantum <= 0:
        raise invalid("the quantum must be positive")
    return (F.floor((value + (quantum - 1)) / quantum) * quantum).cast("long")


def frame_span(stored: Column, quantum: int) -> Column:
    return align_up(stored + BLOCK_HEADER, quantum)


def most_compressed(size: Column, codec: str) -> Column:
    """The largest encoding of `size` bytes."""
    bounds = {"none": size, "packbits": size + F.ceil(size / 128), "lz4_block": size + F.floor(size / 255) + 16}
    if codec not in bounds:
        raise invalid(f"no codec {codec!r}")
    return bounds[codec].cast("long")


def smallest(raw: Column, packed: Column) -> Column:
    """The packed bytes only where they are strictly fewer."""
    return F.when(F.octet_length(packed) < F.octet_length(raw), packed).otherwise(raw)


def hex_preview(data: Column, most: int = 64) -> Column:
    short = F.lower(F.hex(F.substring(data, F.lit(1), F.lit(most))))
    return F.when(F.octet_length(data) > most, F.concat(short, F.lit("..."))).otherwise(short)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def status_name(code: Column) -> Column:
    from ..errors import STATUS

    known = F.element_at(F.array(*map(F.lit, STATUS)), (code + 1).cast("int"))
    return F.when((code >= 0) & (code < len(STATUS)), known).otherwise(F.lit("unknown"))

"""Byte codecs and checksums, in plain Python and NumPy, and their Arrow functions.

Each codec is exact: its encoder gives one canonical output, its decoder is bounded by
the expected size and rejects whatever the grammar does.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf, pandas_udf

from ..errors import RingError

# Reflected CRC32C polynomial; the hash of the LZ4 search, its table size and its limits.
CRC_POLYNOMIAL = 0x82F63B78
LZ4_MULTIPLIER, LZ4_TABLE_BITS = 2654435761, 12
LZ4_LEAST_MATCH, LZ4_LAST_LITERALS, LZ4_FIND_LIMIT, LZ4_LAST_MATCH, LZ4_WINDOW = 4, 5, 13, 12, 65535


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CRC_POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table()
_LIST = _TABLE.tolist()
#: Bytes of a message whose checksum is one gather of _PLACES, and messages shorter than which a plain loop is faster.
_CHUNK, _SHORT = 1024, 40


def _places() -> np.ndarray:
    """What each byte at each place of a chunk adds to the checksum of the whole: the table, advanced by the zeros after it."""
    out = np.empty((_CHUNK, 256), np.uint32)
    t = _TABLE.copy()
    for k in reversed(range(_CHUNK)):
        out[k] = t
        t = _TABLE[t & 0xFF] ^ (t >> 8)
    return out


_PLACES = _places().ravel()
_BASES = np.arange(_CHUNK, dtype=np.int64) * 256
#: Bytes that are looked up at once, in buffers that stay in a core's cache.
_AT_ONCE = 1 << 15
_buffers = threading.local()


def _gathered(m: np.ndarray) -> np.ndarray:
    """Of each row of up to a chunk of bytes, what it adds to the checksum."""
    n, width = m.shape
    bases = _BASES[_CHUNK - width :]
    if not hasattr(_buffers, "at"):
        _buffers.at, _buffers.got = np.empty(_AT_ONCE, np.int64), np.empty(_AT_ONCE, np.uint32)
    step = _AT_ONCE // width
    out = np.empty(n, np.uint32)
    for i in range(0, n, step):
        part = m[i : i + step]
        at, got = (b[: part.size].reshape(part.shape) for b in (_buffers.at, _buffers.got))
        np.add(part, bases, out=at)
        np.take(_PLACES, at, out=got, mode="clip")
        np.bitwise_xor.reduce(got, axis=1, out=out[i : i + step])
    return out


def _advance() -> list[list[int]]:
    """By each byte of a state, what it becomes after a chunk of zeros."""
    out = []
    for k in range(4):
        t = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(_CHUNK):
            t = _TABLE[t & 0xFF] ^ (t >> 8)
        out.append(t.tolist())
    return out


_AFTER = _advance()


def _rows_crc(m: np.ndarray) -> np.ndarray:
    """The linear part of the checksum of each row: of zero state, without the final inversion."""
    width = m.shape[1]
    out = np.zeros(len(m), np.uint32)
    for at in range(width % _CHUNK - _CHUNK if width % _CHUNK else 0, width, _CHUNK):
        part = m[:, max(at, 0) : at + _CHUNK]
        if at > 0:
            tables = [np.array(t, np.uint32) for t in _AFTER]
            out = tables[0][out & 0xFF] ^ tables[1][out >> 8 & 0xFF] ^ tables[2][out >> 16 & 0xFF] ^ tables[3][out >> 24]
        out = out ^ _gathered(part)
    return out


def crc32c(data: bytes, crc: int = 0) -> int:
    """CRC32C; pass the result for what came before to go on from it."""
    crc ^= 0xFFFFFFFF
    n = len(data)
    if n < _SHORT:
        table = _LIST
        for b in data:
            crc = table[(crc ^ b) & 0xFF] ^ (crc >> 8)
        return crc ^ 0xFFFFFFFF
    # a state is the same as so many bits of the message's beginning; zeros before a message change nothing
    m = np.zeros(-(-n // _CHUNK) * _CHUNK if n > _CHUNK else n, np.uint8)
    m[len(m) - n :] = np.frombuffer(data, np.uint8)
    m[len(m) - n : len(m) - n + 4] ^= np.frombuffer(crc.to_bytes(4, "little"), np.uint8)
    if n <= _CHUNK:
        return int(_gathered(m[None, :])[0]) ^ 0xFFFFFFFF
    parts = _gathered(m.reshape(-1, _CHUNK)).tolist()
    a, b, c, d = _AFTER
    crc = 0
    for x in parts:
        crc = a[crc & 0xFF] ^ b[crc >> 8 & 0xFF] ^ c[crc >> 16 & 0xFF] ^ d[crc >> 24] ^ x
    return crc ^ 0xFFFFFFFF


def crc32c_zeroed(data: bytes, at: int) -> int:
    """CRC32C with the four bytes at `at` taken as zero."""
    return crc32c(bytes(data[:at]) + bytes(4) + bytes(data[at + 4 :]))


def crc32c_rows(m: np.ndarray) -> np.ndarray:
    """CRC32C of each row of a matrix of bytes, of four bytes at least."""
    m = m.copy()
    m[:, :4] ^= np.uint8(0xFF)
    return _rows_crc(m) ^ np.uint32(0xFFFFFFFF)


def crc32c_spans(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC32C of spans of an array of bytes: a matrix for each power of two that sizes fall under, aligned to the right."""
    out = np.empty(len(sizes), np.uint32)
    for i in np.flatnonzero(sizes < 4):
        out[i] = crc32c(flat[starts[i] : starts[i] + sizes[i]].tobytes())
    bucket = np.ceil(np.log2(np.maximum(sizes, 4))).astype(np.int64)
    bucket[sizes < 4] = -1
    for k in np.unique(bucket[bucket >= 0]):
        here, width = np.flatnonzero(bucket == k), 1 << int(k)
        # every row is cut out by its end, with what stands before it set to zero
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(width, np.uint8), flat)), width)
        for at in range(0, len(here), max(1, (1 << 24) // width)):
            some = here[at : at + max(1, (1 << 24) // width)]
            pad = (width - sizes[some]).astype(np.int32)
            m = rows[starts[some] + sizes[some]]
            m *= np.arange(width, dtype=np.int32) >= pad[:, None]
            m[np.arange(len(some))[:, None], pad[:, None] + np.arange(4)] ^= np.uint8(0xFF)
            out[some] = _rows_crc(m) ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c_many(blobs: list[bytes]) -> np.ndarray:
    """CRC32C of many byte strings."""
    n = np.array([len(b) for b in blobs], np.int64)
    return crc32c_spans(np.frombuffer(b"".join(blobs), np.uint8), np.cumsum(n) - n, n).astype(np.int64)


def _corrupt(message: str) -> RingError:
    return RingError("corrupt", message)


#: Bytes of a text that an encoder has tables of at a time, which take many times as much.
_PIECE = 1 << 16


# ---- PackBits: literals of 1 to 128 bytes, runs of 3 to 130


def _long_runs(raw: bytes) -> Iterator[tuple[int, int]]:
    """Start and size of each run of three or more equal bytes, found a piece at a time; a run may go over many pieces."""
    x, start = np.frombuffer(raw, np.uint8), 0
    for at in range(0, len(x), _PIECE):
        part = x[at : at + _PIECE + 1]
        bounds = np.concatenate(([start], np.flatnonzero(part[1:] != part[:-1]) + (at + 1), [len(x)] * (at + _PIECE >= len(x)))).astype(np.int64)
        sizes = np.diff(bounds)
        long_ = np.flatnonzero(sizes >= 3)
        yield from zip(bounds[long_].tolist(), sizes[long_].tolist(), strict=True)
        start = int(bounds[-1])


def packbits_encode(raw: bytes) -> bytes:
    """Only runs of three or more bytes are walked."""
    out, literal = bytearray(), 0

    def flush(end: int) -> None:
        for at in range(literal, end, 128):
            part = raw[at : min(end, at + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for at, run in _long_runs(raw):
        flush(at)
        whole, rest = divmod(run, 130)
        out += bytes((255, raw[at])) * whole
        if rest >= 3:
            out += bytes((128 | (rest - 3), raw[at]))
            rest = 0
        literal = at + run - rest
    flush(len(raw))
    return bytes(out)


def packbits_decode(stored: bytes, raw_size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(stored):
        token = stored[i]
        i += 1
        if token < 128:
            part = stored[i : i + token + 1]
            if len(part) <= token:
                raise _corrupt("a literal is missing")
            i += len(part)
        else:
            if i >= len(stored):
                raise _corrupt("a repeated byte is missing")
            part = stored[i : i + 1] * ((token & 127) + 3)
            i += 1
        if len(out) + len(part) > raw_size:
            raise _corrupt("longer than the raw size")
        out += part
    if len(out) != raw_size:
        raise _corrupt("shorter than the raw size")
    return bytes(out)


# ---- LZ4 raw blocks


def _extended(out: bytearray, left: int) -> None:
    out += b"\xff" * (left // 255)
    out.append(left % 255)


def _sequence(out: bytearray, literals: bytes, offset: int = 0, match: int = LZ4_LEAST_MATCH) -> None:
    n, m = len(literals), match - LZ4_LEAST_MATCH
    out.append(min(n, 15) << 4 | min(m, 15))
    if n >= 15:
        _extended(out, n - 15)
    out += literals
    if offset:
        out += offset.to_bytes(2, "little")
        if m >= 15:
            _extended(out, m - 15)


def lz4_encode(raw: bytes) -> bytes:
    """Greedy search over the last place of each hash of four bytes; the hashes of a piece of the text are made at once.

    Within a piece, places count from the begin of the window before it.
    """
    out, anchor = bytearray(), 0
    at, last_start, last_byte = 0, len(raw) - LZ4_FIND_LIMIT, len(raw) - LZ4_LAST_LITERALS
    base, seen = 0, [-1] * (1 << LZ4_TABLE_BITS) if last_start > 0 else []
    while at < last_start:
        if (begin := max(0, at - LZ4_WINDOW)) > base:
            # what falls below zero is out of the window of all later places
            seen, base = [x - (begin - base) for x in seen], begin
        stop = min(at + _PIECE, last_start) - base
        x = np.frombuffer(raw, np.uint8, stop + 3, base).astype(np.uint32)
        four = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
        slots = (four * np.uint32(LZ4_MULTIPLIER) >> np.uint32(32 - LZ4_TABLE_BITS)).tolist()
        words = four.tolist()
        at -= base
        while at < stop:
            slot = slots[at]
            before = seen[slot]
            seen[slot] = at
            if before < 0 or words[before] != words[at] or at - before > LZ4_WINDOW:
                at += 1
                continue
            end = at + LZ4_LEAST_MATCH
            shift = at - before
            while end < stop and words[end] == words[end - shift]:  # four bytes from before stop end before last_byte
                end += 4
            at += base
            end += base
            if end >= stop + base:  # a match goes on after the piece
                while end + 256 <= last_byte and raw[end : end + 256] == raw[end - shift : end - shift + 256]:
                    end += 256
            while end < last_byte and raw[end] == raw[end - shift]:
                end += 1
            n, m = at - anchor, end - at - LZ4_LEAST_MATCH
            if n < 15 and m < 15:
                out.append(n << 4 | m)
                out += raw[anchor:at]
                out += bytes((shift & 255, shift >> 8))
            else:
                _sequence(out, raw[anchor:at], shift, end - at)
            anchor = end
            at = end - base
        at += base
    _sequence(out, raw[anchor:])
    return bytes(out)


def lz4_decode(stored: bytes, raw_size: int) -> bytes:
    out, i, n, last_match = bytearray(), 0, len(stored), -1

    def length(nibble: int, most: int) -> int:
        nonlocal i
        total = nibble
        if nibble == 15:
            while True:
                if i >= n:
                    raise _corrupt("a length doesn't end")
                total += stored[i]
                i += 1
                if total > most:
                    raise _corrupt("a length exceeds the raw size")
                if stored[i - 1] != 255:
                    break
        if total > most:
            raise _corrupt("a length exceeds the raw size")
        return total

    tail = 0
    while True:
        if i >= n:
            raise _corrupt("a token is missing")
        token = stored[i]
        i += 1
        tail = token >> 4
        if tail == 15 or tail > raw_size - len(out):
            tail = length(tail, raw_size - len(out))
        if i + tail > n:
            raise _corrupt("literals are missing")
        out += stored[i : i + tail]
        i += tail
        if i == n:
            if token & 15:
                raise _corrupt("the last token announces a match")
            break
        if i + 2 > n:
            raise _corrupt("an offset is missing")
        offset = stored[i] | stored[i + 1] << 8
        i += 2
        last_match = len(out)
        if not 0 < offset <= last_match:
            raise _corrupt("an offset points outside")
        left = raw_size - last_match
        if left < LZ4_LEAST_MATCH:
            raise _corrupt("a match exceeds the raw size")
        size = token & 15
        if size == 15 or size > left - LZ4_LEAST_MATCH:
            size = length(size, left - LZ4_LEAST_MATCH)
        size += LZ4_LEAST_MATCH
        begin = last_match - offset
        if size <= offset:
            out += out[begin : begin + size]
        else:
            out += (bytes(out[begin:]) * (size // offset + 1))[:size]
    if len(out) != raw_size:
        raise _corrupt("not the raw size")
    if last_match >= 0 and (tail < LZ4_LAST_LITERALS or raw_size - last_match < LZ4_LAST_MATCH):
        raise _corrupt("a match reaches too near to the end")
    return bytes(out)


def _same_size(stored: bytes, raw_size: int) -> bytes:
    if len(stored) != raw_size:
        raise _corrupt("not the raw size")
    return stored


@dataclass(frozen=True)
class Codec:
    """encode(raw), decode(stored, raw_size), and the most bytes that an encoding takes."""

    id: int
    version: int
    encode: Callable[[bytes], bytes]
    decode: Callable[[bytes, int], bytes]
    bound: Callable[[int], int]


NONE = Codec(0, 1, bytes, _same_size, lambda n: n)
PACKBITS = Codec(1, 1, packbits_encode, packbits_decode, lambda n: n + -(-n // 128))
LZ4 = Codec(2, 1, lz4_encode, lz4_decode, lambda n: n + n // 255 + 16)
#: By (id, version); a reader or writer may be given more.
CODECS: dict[tuple[int, int], Codec] = {(c.id, c.version): c for c in (NONE, PACKBITS, LZ4)}
NAMES = {"none": NONE, "packbits": PACKBITS, "lz4_block": LZ4}


def codec(key: tuple[int, int], registry: dict[tuple[int, int], Codec] | None = None) -> Codec:
    found = (CODECS | (registry or {})).get(key)
    if found is None:
        raise RingError("unsupported", f"codec {key[0]}:{key[1]}")
    return found


def choose(raw: bytes, wanted: Codec) -> tuple[Codec, bytes]:
    """The wanted codec's bytes if they are strictly fewer, else the raw ones."""
    packed = wanted.encode(raw)
    if wanted is not NONE and (not packed or len(packed) > wanted.bound(len(raw))):
        raise RingError("internal_error", "a codec broke its bound")
    return (wanted, packed) if len(packed) < len(raw) else (NONE, raw)


# ---- digests and generators


def fnv1a(data: bytes, state: int = 0xCBF29CE484222325) -> int:
    for b in data:
        state = (state ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return state


def fnv1a_many(blobs: list[bytes]) -> np.ndarray:
    """FNV-1a-64 of many byte strings: one step for each byte place, over all that are as long."""
    n = np.array([len(b) for b in blobs], np.int64)
    order = np.argsort(-n, kind="stable")
    sizes = n[order]
    starts = (np.cumsum(n) - n)[order]
    flat = np.frombuffer(b"".join(blobs), np.uint8)
    h = np.full(len(blobs), 0xCBF29CE484222325, np.uint64)
    live = len(blobs)
    for i in range(int(n.max(initial=0))):
        while live and sizes[live - 1] <= i:
            live -= 1
        h[:live] = (h[:live] ^ flat[starts[:live] + i]) * np.uint64(0x100000001B3)
    out = np.empty(len(blobs), np.uint64)
    out[order] = h
    return out


def splitmix64(x: np.ndarray) -> np.ndarray:
    """The mixed value of each unsigned 64-bit number."""
    z = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


# ---- Arrow functions

#: Bytes of an Arrow batch that a worker is sent, and bytes of values that it works on before it answers with them.
BATCH_BYTES = 1 << 22


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bytes of an Arrow batch to BATCH_BYTES, where they are more: rows alone don't bound long values."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def _lengths(values: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(sizes: np.ndarray, most: int = BATCH_BYTES) -> Iterator[slice]:
    """Stretches of rows of up to `most` bytes; a longer row is one of its own."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        yield slice(at, to)
        at = to


def _bytes_udf(one: Callable[[bytes], bytes]):
    """An iterator's batches may be answered in smaller ones, so a worker never holds the results of a whole batch."""

    @arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            for part in _parts(_lengths(a)):
                yield pa.array([one(x.as_py()) if x.is_valid else None for x in a[part]], a.type)

    return run


def _many(many: Callable[[list[bytes]], np.ndarray]):
    @arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            for part in _parts(_lengths(a)):
                some = a[part].is_valid().to_numpy(zero_copy_only=False)
                out = np.zeros(len(some), np.int64)
                if some.any():
                    out[some] = many(a[part].drop_null().to_pylist()).view(np.int64)
                yield pa.array(out, mask=~some)

    return run


def crc32c_of(data: Column) -> Column:
    return _many(crc32c_many)(data)


def encoded(data: Column, name: str) -> Column:
    return _bytes_udf(NAMES[name].encode)(data)


def decoded(stored: Column, raw_size: Column, name: str) -> Column:
    c = NAMES[name]

    @arrow_udf("binary")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for s, n in batches:
            for part in _parts(_lengths(s) + pc.fill_null(n, 0).to_numpy(zero_copy_only=False)):
                yield pa.array([c.decode(x.as_py(), k.as_py()) if x.is_valid else None for x, k in zip(s[part], n[part], strict=True)], s.type)

    return run(stored, raw_size.cast("long"))


def round_tripped(data: Column, name: str) -> Column:
    """What the codec decodes from what it encoded, as decoded(encoded()) has it, but by one worker a task instead of two."""
    c = NAMES[name]
    return _bytes_udf(lambda x: c.decode(c.encode(x), len(x)))(data)


def fnv1a_of(data: Column) -> Column:
    """FNV-1a-64 as a signed long."""
    return _many(fnv1a_many)(data)


def fnv1a_of_longs(numbers: Column) -> Column:
    """FNV-1a-64, as a signed long, of the little-endian bytes of an array of longs."""

    @pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(fnv1a_many([np.asarray(x, "<i8").tobytes() for x in s]).view(np.int64), index=s.index)

    return run(numbers)


def splitmix64_of(number: Column) -> Column:
    @pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(splitmix64(s.to_numpy(np.int64).view(np.uint64)).view(np.int64), index=s.index)

    return run(number.cast("long"))

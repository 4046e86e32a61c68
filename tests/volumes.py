"""Volumes for the tests, made as the published digests of the format describe them."""

from __future__ import annotations

import struct

from tidering.functions.codecs import crc32c_zeroed
from tidering.sources.media import FRAMED_PROFILE, Options
from tidering.sources.storage import MemoryStorage
from tidering.sources.volume import Writer, format_volume

# The sizes, ids, times and payloads below make the published images byte by byte.
PREFIX, PARTITION = 8192, 65536


def patched(image: bytes, *changes: tuple[int, str, int], crc: tuple[int, int, int] | None = None) -> bytes:
    out = bytearray(image)
    for at, code, value in changes:
        struct.pack_into("<" + code, out, at, value)
    if crc:
        begin, size, at = crc
        struct.pack_into("<I", out, begin + at, crc32c_zeroed(bytes(out[begin : begin + size]), at))
    return bytes(out)


def valid_mixed() -> bytes:
    s = MemoryStorage(PREFIX + 2 * PARTITION)
    format_volume(s, PARTITION, 4096, 256, 512, -2, (0x0102030405060708, 0x1112131415161718))
    first = Options(1, 1, *FRAMED_PROFILE, 42, 50, 500)
    w = Writer(s, first, (0x2122232425262728, 0x3132333435363738))
    for t, selector, flags, payload in ((-100, 10, 1, b"A" * 120), (0, 11, 0, b"B" * 17), (1000, 10, 0, b"C" * 120), (900, 12, 0, b"D" * 9), (1600, 13, 0, b"E" * 120)):
        w.append_framed(t, selector, flags, payload)
    w.checkpoint()
    w.rotate(Options(0, 1, *FRAMED_PROFILE, 43, -1, -1))
    for t, selector, payload in ((2000, 20, b"x" * 3), (1500, 21, b"y" * 64), (2500, 20, b"z" * 5)):
        w.append_framed(t, selector, 0, payload)
    w.close()
    return bytes(s.durable)


def with_feature(base: bytes, flags: int, start: int, length: int) -> bytes:
    at = PREFIX + 128 + 4 * 40
    base = bytearray(base)
    base[at : at + 40] = bytes(40)
    return patched(bytes(base), (PREFIX + 88, "H", 5), (at, "H", 0x7001), (at + 2, "H", flags), (at + 8, "H", 1), (at + 24, "Q", start), (at + 32, "Q", length), crc=(PREFIX, 1024, 104))


def huge_partitions(base: bytes) -> bytes:
    for copy in (0, 4096):
        base = patched(base, (copy + 40, "Q", 2**64 - 512), crc=(copy, 256, 72))
    return base


def _blocks(w: Writer, *blocks: tuple[bytes, int]) -> None:
    for payload, t in blocks:
        w.append(payload, t)
        w.checkpoint()


def stale_chain() -> bytes:
    s = MemoryStorage(PREFIX + 3 * PARTITION)
    format_volume(s, PARTITION, 4096, 256, 512, 0, (0x4142434445464748, 0x5152535455565758))
    w = Writer(s, Options(), (0x1111, 0x2222))
    _blocks(w, (b"A" * 200, 1))
    for c, t in ((b"B", 2), (b"C", 3)):
        w.append(c * 200, t)
        w.publish()
    s = s.crash([(1, 0, 64), (2, 0, 328)])
    _blocks(Writer(s, Options(), (0x3333, 0x4444)), (b"D" * 200, 4))
    return bytes(s.durable)


def live_rotation() -> list[bytes]:
    s = MemoryStorage(PREFIX + 2 * PARTITION)
    format_volume(s, PARTITION, 4096, 256, 512, 0, (0x6162636465666768, 0x7172737475767778))
    w = Writer(s, Options(), (0x8182, 0x8384))
    out = []
    _blocks(w, (b"A" * 200, 1))
    w.rotate(Options())
    _blocks(w, (b"B" * 200, 2))
    out.append(bytes(s.durable))
    w.rotate(Options())
    out.append(bytes(s.durable))
    _blocks(w, (b"C" * 200, 3))
    out.append(bytes(s.durable))
    return out


def lz4_blocks() -> bytes:
    s = MemoryStorage(PREFIX + 2 * PARTITION)
    format_volume(s, PARTITION, 4096, 4096, 512, -7, (0x4C5A34424C4B3031, 0x0102030405060708))
    w = Writer(s, Options(2, 1, time_domain_id=44), (0x6162636465666768, 0x7172737475767778))
    state, noise = 0x1234567, bytearray()
    for _ in range(1500):
        state = (state * 1103515245 + 12345) & 0xFFFFFFFF
        noise.append(state >> 16 & 255)
    long = bytes((i * 7 + 1) & 255 for i in range(40)) + bytes(i % 4 for i in range(1200))
    _blocks(w, (bytes([0x2A]) * 2000, 0), (long, 100), (bytes((i % 16 + i // 64) & 255 for i in range(1500)), 200), (bytes(noise), 300))
    w.close()
    return bytes(s.durable)


def unknown_codec_version(base: bytes) -> bytes:
    return patched(base, (PREFIX + 128 + 8, "H", 2), crc=(PREFIX, 1024, 104))

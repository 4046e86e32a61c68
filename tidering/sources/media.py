"""The structures of a volume, as bytes: each is a table of fields at fixed offsets.

A structure begins with its magic, version and exact size and holds a CRC32C of itself
with that field as zero. Decoding checks all of these; what a structure must mean on top
is checked where it is used.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from ..errors import RingError
from ..functions.codecs import Codec, codec, crc32c, crc32c_rows, crc32c_spans, crc32c_zeroed

# Fixed values of the format: magics, version, sizes, feature kinds, the framed record profile.
MAGIC = {"volume": b"TFDBVOL1", "partition": b"TFDBPAR1", "block": b"TFDBBLK1", "footer": b"TFDBFTR1"}
MAJOR, MINOR = 1, 0
SIZE = {"volume": 256, "partition": 1024, "block": 128, "footer": 256}
CRC_AT = {"volume": 72, "partition": 104, "block": 72, "footer": 100}
COPY, PREFIX, REGION, ENTRY, ENVELOPE = 4096, 8192, 4096, 48, 32
FEATURE_AT, FEATURE_SIZE, CONFIG_AT, CONFIG_SIZE = 128, 40, 512, 16
COMPRESSION, TIME_INDEX, PROFILE, INTEGRITY = 1, 2, 3, 4
FRAMED_PROFILE = (0x5446444252465631, 1)
U64 = (1 << 64) - 1

# Fields after the common prefix: (name, offset, struct code).
FIELDS = {
    "volume": [("volume_id_high", 16, "Q"), ("volume_id_low", 24, "Q"), ("volume_size", 32, "Q"), ("partition_size", 40, "Q"), ("partition_count", 48, "I"), ("index_region_size", 52, "I"), ("max_block_payload", 56, "I"), ("persistence_quantum", 60, "I"), ("created_time_ns", 64, "q")],
    "partition": [("volume_id_high", 16, "Q"), ("volume_id_low", 24, "Q"), ("generation", 32, "Q"), ("slot", 40, "I"), ("created_time_ns", 48, "q"), ("max_block_payload", 56, "I"), ("persistence_quantum", 60, "I"), ("allowed_backward_skew_ns", 64, "q"), ("allowed_forward_step_ns", 72, "q"), ("time_domain_id", 80, "Q"), ("feature_count", 88, "H"), ("feature_size", 90, "H"), ("feature_at", 92, "I"), ("config_at", 96, "I"), ("config_size", 100, "I"), ("record_format_id", 512, "Q")],
    "block": [("generation", 16, "Q"), ("sequence", 24, "I"), ("flags", 28, "I"), ("record_count", 32, "I"), ("stored_size", 36, "I"), ("raw_size", 40, "I"), ("frame_span", 44, "I"), ("min_time_ns", 48, "q"), ("max_time_ns", 56, "q"), ("compression", 64, "H"), ("compression_version", 66, "H"), ("payload_crc", 68, "I"), ("slot", 76, "I"), ("volume_id_low", 80, "Q"), ("volume_id_high", 88, "Q"), ("writer_high", 96, "Q"), ("writer_low", 104, "Q"), ("previous_high", 112, "Q"), ("previous_low", 120, "Q")],
    "footer": [("volume_id_high", 16, "Q"), ("volume_id_low", 24, "Q"), ("generation", 32, "Q"), ("slot", 40, "I"), ("flags", 44, "I"), ("block_count", 48, "I"), ("entry_size", 52, "I"), ("index_at", 56, "Q"), ("index_size", 64, "I"), ("data_end", 72, "Q"), ("min_time_ns", 80, "q"), ("max_time_ns", 88, "q"), ("index_crc", 96, "I")],
}
ENTRY_FIELDS = ("offset", "frame_size", "frame_span", "sequence", "record_count", "min_time_ns", "max_time_ns", "flags", "raw_size")
_ENTRY = struct.Struct("<QIIIIqqII")
_FEATURE = struct.Struct("<HHIHHIIIQQ")
_FRAME = struct.Struct("<IHHqQII")
_SIZE = struct.Struct("<I")


def corrupt(message: str) -> RingError:
    return RingError("corrupt", message)


def encode(kind: str, values: dict[str, int], patch: dict[int, bytes] | None = None) -> bytes:
    out = bytearray(SIZE[kind])
    struct.pack_into("<8sHHI", out, 0, MAGIC[kind], MAJOR, MINOR, SIZE[kind])
    for name, at, code in FIELDS[kind]:
        struct.pack_into("<" + code, out, at, values[name])
    for at, data in (patch or {}).items():
        out[at : at + len(data)] = data
    struct.pack_into("<I", out, CRC_AT[kind], crc32c_zeroed(bytes(out), CRC_AT[kind]))
    return bytes(out)


def decode(kind: str, data: bytes) -> dict[str, int]:
    if len(data) != SIZE[kind]:
        raise corrupt(f"{kind}: not its size")
    magic, major, minor, size = struct.unpack_from("<8sHHI", data)
    if magic != MAGIC[kind]:
        raise corrupt(f"{kind}: not its magic")
    if major != MAJOR or minor > MINOR:
        raise RingError("unsupported", f"{kind}: version {major}.{minor}")
    if size != SIZE[kind]:
        raise RingError("unsupported", f"{kind}: encoded size {size}")
    if crc32c_zeroed(data, CRC_AT[kind]) != struct.unpack_from("<I", data, CRC_AT[kind])[0]:
        raise corrupt(f"{kind}: checksum")
    return {name: struct.unpack_from("<" + code, data, at)[0] for name, at, code in FIELDS[kind]}


def align_up(value: int, quantum: int) -> int:
    if quantum <= 0:
        raise RingError("invalid_argument", "quantum")
    return -(-value // quantum) * quantum


# ---- the volume


@dataclass(frozen=True)
class Volume:
    volume_id_high: int
    volume_id_low: int
    volume_size: int
    partition_size: int
    partition_count: int
    index_region_size: int
    max_block_payload: int
    persistence_quantum: int
    created_time_ns: int = 0

    @property
    def id(self) -> str:
        return f"{self.volume_id_high:016x}{self.volume_id_low:016x}"

    @property
    def index_begin(self) -> int:
        return self.partition_size - REGION - self.index_region_size

    @property
    def footer_begin(self) -> int:
        return self.partition_size - REGION

    @property
    def worst_span(self) -> int:
        return align_up(SIZE["block"] + self.max_block_payload, self.persistence_quantum)

    def base(self, slot: int) -> int:
        return PREFIX + slot * self.partition_size

    def encode(self) -> bytes:
        return encode("volume", self.__dict__)

    def problem(self, backend_size: int) -> str | None:
        """What is wrong with the geometry on a backend of that size, if anything is."""
        q = self.persistence_quantum
        if not (self.volume_id_high or self.volume_id_low):
            return "the volume has no id"
        if not PREFIX <= self.volume_size <= backend_size:
            return "the recorded size doesn't fit the backend"
        if self.partition_count < 2:
            return "fewer than two partitions"
        if not 0 < q <= COPY or q & (q - 1):
            return "the quantum is no power of two up to 4096"
        if self.partition_size % q or self.index_region_size % q:
            return "sizes are no multiples of the quantum"
        if not self.max_block_payload or self.index_region_size < ENTRY:
            return "no room for a block or an index entry"
        room = self.partition_size - 2 * REGION - self.index_region_size
        if room < q:
            return "a partition has no data region"
        if PREFIX + self.partition_count * self.partition_size > self.volume_size:
            return "the partitions exceed the volume"
        if self.worst_span > room:
            return "a block doesn't fit a partition"
        return None


def decode_volume(data: bytes) -> Volume:
    return Volume(**decode("volume", data))


# ---- partitions


@dataclass(frozen=True)
class Options:
    """What a partition is created with; it never changes."""

    compression: int = 0
    compression_version: int = 1
    record_format_id: int = 0
    record_format_version: int = 0
    time_domain_id: int = 1
    allowed_backward_skew_ns: int = -1
    allowed_forward_step_ns: int = -1

    def check(self, registry: dict[tuple[int, int], Codec] | None = None) -> None:
        if not 0 < self.time_domain_id <= U64:
            raise RingError("invalid_argument", "time domain 0 is reserved")
        if bool(self.record_format_id) != bool(self.record_format_version):
            raise RingError("invalid_argument", "a profile needs both id and version")
        codec((self.compression, self.compression_version), registry)


@dataclass(frozen=True)
class Partition:
    generation: int
    slot: int
    options: Options = field(default_factory=Options)


def encode_partition(v: Volume, p: Partition) -> bytes:
    o = p.options
    features = [
        (COMPRESSION, 1, o.compression, o.compression_version, 0, 0, 0, 0),
        (TIME_INDEX, 1, 1, 1, 0, 0, v.index_begin, v.index_region_size),
        (PROFILE, 0, 0, o.record_format_version, CONFIG_AT, 8, 0, 0),
        (INTEGRITY, 1, 1, 1, 0, 0, 0, 0),
    ]
    area = b"".join(_FEATURE.pack(kind, flags, algorithm, version, 0, at, n, 0, start, length) for kind, flags, algorithm, version, at, n, start, length in features)
    values = v.__dict__ | o.__dict__ | p.__dict__ | {"created_time_ns": 0, "feature_count": 4, "feature_size": FEATURE_SIZE, "feature_at": FEATURE_AT, "config_at": CONFIG_AT, "config_size": CONFIG_SIZE}
    return encode("partition", values, {FEATURE_AT: area})


def decode_partition(v: Volume, slot: int, data: bytes, registry: dict[tuple[int, int], Codec] | None = None) -> Partition:
    """The partition in a slot of the volume; bounds before meaning, so damage is told apart from what is new."""
    h = decode("partition", data)
    if (h["volume_id_high"], h["volume_id_low"]) != (v.volume_id_high, v.volume_id_low) or h["slot"] != slot:
        raise corrupt("partition: of another volume or slot")
    if (h["max_block_payload"], h["persistence_quantum"]) != (v.max_block_payload, v.persistence_quantum):
        raise corrupt("partition: other geometry than the volume's")
    if not h["time_domain_id"]:
        raise corrupt("partition: time domain 0")
    if not 4 <= h["feature_count"] <= 8 or (h["feature_size"], h["feature_at"], h["config_at"], h["config_size"]) != (FEATURE_SIZE, FEATURE_AT, CONFIG_AT, CONFIG_SIZE):
        raise corrupt("partition: feature directory")
    known: dict[int, tuple] = {}
    slices: list[tuple[int, int]] = []
    unknown = []
    for i in range(h["feature_count"]):
        kind, flags, algorithm, version, _, at, n, _, start, length = _FEATURE.unpack_from(data, FEATURE_AT + i * FEATURE_SIZE)
        if n == 0 and at or n and not CONFIG_AT <= at <= at + n <= CONFIG_AT + CONFIG_SIZE:
            raise corrupt("partition: configuration slice")
        if n:
            if any(at < b and a < at + n for a, b in slices):
                raise corrupt("partition: configuration slices overlap")
            slices.append((at, at + n))
        if start + length > v.partition_size or (start and not length):
            raise corrupt("partition: reserved region")
        if kind in (COMPRESSION, TIME_INDEX, PROFILE, INTEGRITY):
            if kind in known:
                raise corrupt("partition: feature twice")
            known[kind] = (flags & 1, algorithm, version, at, n, start, length)
        else:
            unknown.append((flags & 1, length))
    if len(known) < 4:
        raise corrupt("partition: a core feature is missing")
    if any(required or length for required, length in unknown):
        raise RingError("unsupported", "partition: unknown feature")
    packing, index, profile, integrity = (known[k] for k in (COMPRESSION, TIME_INDEX, PROFILE, INTEGRITY))
    if packing[1] > 0xFFFF:
        raise corrupt("partition: codec id")
    if index[1:3] != (1, 1) or integrity[1:3] != (1, 1):
        raise RingError("unsupported", "partition: time index or integrity")
    if index[5:] != (v.index_begin, v.index_region_size) or profile[3:5] != (CONFIG_AT, 8):
        raise corrupt("partition: index region or profile slice")
    if bool(h["record_format_id"]) != bool(profile[2]):
        raise corrupt("partition: profile id without version, or the reverse")
    codec((packing[1], packing[2]), registry)
    o = Options(packing[1], packing[2], h["record_format_id"], profile[2], h["time_domain_id"], h["allowed_backward_skew_ns"], h["allowed_forward_step_ns"])
    return Partition(h["generation"], slot, o)


def encode_entries(entries: list[dict]) -> bytes:
    return b"".join(_ENTRY.pack(*(e[k] for k in ENTRY_FIELDS)) for e in entries)


def decode_entries(data: bytes) -> list[dict]:
    return [dict(zip(ENTRY_FIELDS, row, strict=True)) for row in _ENTRY.iter_unpack(data)]


# ---- framed records

_HEAD = np.dtype([("size", "<u4"), ("header", "<u2"), ("flags", "<u2"), ("time_ns", "<i8"), ("selector", "<u8"), ("payload", "<u4"), ("crc", "<u4")])


@dataclass(frozen=True)
class Frames:
    """The records of a block by columns; starts and sizes are their places in data, envelopes included."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    times: np.ndarray
    selectors: np.ndarray
    flags: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def encoded(self, some: np.ndarray | None = None) -> pa.Array:
        """The records as they are stored, all or those of the given numbers."""
        return _spans(self.data, self.starts if some is None else self.starts[some], self.sizes if some is None else self.sizes[some])

    def payloads(self, some: np.ndarray | None = None) -> pa.Array:
        starts, sizes = (self.starts, self.sizes) if some is None else (self.starts[some], self.sizes[some])
        return _spans(self.data, starts + ENVELOPE, sizes - ENVELOPE)


def _spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Spans of an array of bytes as a binary column."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if len(starts) and int(starts[-1] + sizes[-1] - starts[0]) == total:
        flat = data[int(starts[0]) : int(starts[0]) + total]
    else:
        flat = data[np.repeat(starts - ends + sizes, sizes) + np.arange(total)]
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def frames_encode(times: np.ndarray, selectors: np.ndarray, flags: np.ndarray, payload_sizes: np.ndarray, payloads: np.ndarray) -> Frames:
    """Framed records from columns; payloads is the bytes of all of them, one after the other."""
    n, sizes = len(times), payload_sizes.astype(np.int64) + ENVELOPE
    starts = np.cumsum(sizes) - sizes
    data = np.empty(int(sizes.sum()), np.uint8)
    head = np.zeros(n, _HEAD)
    for name, values in (("size", sizes), ("header", ENVELOPE), ("flags", flags), ("time_ns", times), ("selector", selectors), ("payload", payload_sizes)):
        head[name] = values
    same = n and bool((sizes == sizes[0]).all())
    if same:
        m = data.reshape(n, int(sizes[0]))
        m[:, :ENVELOPE], m[:, ENVELOPE:] = head.view(np.uint8).reshape(n, ENVELOPE), payloads.reshape(n, -1)
        crc = crc32c_rows(m)
        m[:, 28:32] = crc.astype("<u4").view(np.uint8).reshape(n, 4)
    elif n:
        at = starts[:, None] + np.arange(ENVELOPE)
        held = np.ones(len(data), bool)
        held[at] = False
        data[at], data[held] = head.view(np.uint8).reshape(n, ENVELOPE), payloads
        data[starts[:, None] + np.arange(28, 32)] = crc32c_spans(data, starts, sizes).astype("<u4").view(np.uint8).reshape(n, 4)
    return Frames(data, starts, sizes, times, selectors, flags)


def frames_decode(block: bytes) -> Frames:
    """The records of a block, all of them or an error."""
    data = np.frombuffer(block, np.uint8)
    total = len(data)
    if not total:
        none = np.empty(0, np.int64)
        return Frames(data, none, none, none, none.astype(np.uint64), none.astype(np.uint16))
    if total < ENVELOPE:
        raise corrupt("record: a suffix shorter than an envelope")
    first = int.from_bytes(block[:4], "little")
    head = None
    if first >= ENVELOPE and total % first == 0:
        m = data.reshape(-1, first)
        head = np.ascontiguousarray(m[:, :ENVELOPE]).view(_HEAD).ravel()
        if (head["size"] != first).any():
            head = None
    if head is not None:
        starts = np.arange(0, total, first, dtype=np.int64)
    else:
        at, places, size_at = 0, [], _SIZE.unpack_from
        try:
            while at < total:
                places.append(at)
                size = size_at(block, at)[0]
                if size < ENVELOPE:
                    raise corrupt("record: sizes")
                at += size
        except struct.error:
            at = -1
        if at != total or total - places[-1] < ENVELOPE:
            raise corrupt("record: a suffix shorter than an envelope, or sizes")
        starts = np.array(places, np.int64)
        head = np.ascontiguousarray(data[starts[:, None] + np.arange(ENVELOPE)]).view(_HEAD).ravel()
    sizes = head["size"].astype(np.int64)
    if ((head["header"] != ENVELOPE) | (head["payload"].astype(np.int64) != sizes - ENVELOPE)).any():
        raise corrupt("record: sizes")
    if (sizes == sizes[0]).all():
        m = data.reshape(-1, int(sizes[0])).copy()
        m[:, 28:32] = 0
        crc = crc32c_rows(m)
    else:
        cleared = data.copy()
        cleared[starts[:, None] + np.arange(28, 32)] = 0
        crc = crc32c_spans(cleared, starts, sizes)
    if (crc != head["crc"]).any():
        raise corrupt("record: checksum")
    return Frames(data, starts, sizes, head["time_ns"].astype(np.int64), head["selector"].astype(np.uint64), head["flags"].astype(np.uint16))


def frame_encode(time_ns: int, selector: int, flags: int, payload: bytes) -> bytes:
    head = _FRAME.pack(ENVELOPE + len(payload), ENVELOPE, flags, time_ns, selector, len(payload), 0)
    return head[:28] + crc32c(head + payload).to_bytes(4, "little") + payload


def frame_decode(block: bytes) -> list[tuple[int, int, int, bytes, bytes]]:
    """(time, selector, flags, payload, encoded) of each record; all of a block or an error."""
    f = frames_decode(block)
    return list(zip(f.times.tolist(), f.selectors.tolist(), f.flags.tolist(), f.payloads().to_pylist(), f.encoded().to_pylist(), strict=True))

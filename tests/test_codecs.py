"""Checksums and byte codecs against their published vectors, and their strictness."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidering.errors import RingError
from tidering.functions import codecs as K
from tidering.plans import catalogue
from tidering.sources import media as M

H = bytes.fromhex
# Published vectors.
LZ4 = [(b"", "00"), (b"a", "1061"), (b"a" * 13, "d0" + "61" * 13), (b"a" * 20, "1a610100506161616161"), (bytes(range(0x14)) + bytes(range(4)) * 10, "f005000102030405060708090a0b0c0d0e0f1011121314000f04000c500300010203")]
RECORD = "23000000200007000000000000000080887766554433221103000000e8c1198a6c6f67"


def test_vectors():
    assert K.crc32c(b"123456789") == 0xE3069283
    for raw, stored in LZ4:
        assert K.lz4_encode(raw) == H(stored) and K.lz4_decode(H(stored), len(raw)) == raw
    assert M.frame_encode(-(2**63), 0x1122334455667788, 7, b"log") == H(RECORD)
    assert M.frame_decode(H(RECORD)) == [(-(2**63), 0x1122334455667788, 7, b"log", H(RECORD))]


@pytest.mark.parametrize("name", ["none", "packbits", "lz4_block"])
@given(st.one_of(st.binary(max_size=600), st.lists(st.sampled_from([b"a", b"bb", b"abc" * 9, b"\0" * 140]), max_size=12).map(b"".join)))
@settings(max_examples=150, deadline=None)
def test_round_trips_within_bounds(name, raw):
    c = K.NAMES[name]
    packed = c.encode(raw)
    assert c.decode(packed, len(raw)) == raw and len(packed) <= max(c.bound(len(raw)), 1)


@given(st.binary(max_size=60), st.integers(0, 90))
@settings(max_examples=500, deadline=None)
def test_decoders_reject_or_give_the_size(stored, size):
    for c in (K.PACKBITS, K.LZ4):
        try:
            assert len(c.decode(stored, size)) == size
        except RingError as e:
            assert e.code == "corrupt"


@pytest.mark.parametrize("stored, size", [("", 0), ("f0", 20), ("1061", 2), ("1161", 1), ("1061ff", 1), ("1a610000506161616161", 20), ("1a610200506161616161", 20), ("1f6101000040" + "61" * 4, 24)])
def test_bad_lz4(stored, size):
    with pytest.raises(RingError, match="corrupt"):
        K.lz4_decode(H(stored), size)


@given(st.lists(st.binary(max_size=40), max_size=20))
@settings(max_examples=100, deadline=None)
def test_checksums_of_many(blobs):
    assert K.crc32c_many(blobs).tolist() == [K.crc32c(b) for b in blobs]


def test_choice_and_registry():
    assert K.choose(b"\0" * 400, K.PACKBITS)[0] is K.PACKBITS and K.choose(b"abc", K.PACKBITS) == (K.NONE, b"abc")
    with pytest.raises(RingError, match="unsupported"):
        K.codec((9, 1))
    own = K.Codec(9, 1, lambda b: b[::-1], lambda b, n: b[::-1], lambda n: n)
    assert K.codec((9, 1), {(9, 1): own}) is own
    assert K.fnv1a(b"") == 0xCBF29CE484222325


@pytest.mark.parametrize("kind", ["volume", "partition", "block", "footer"])
def test_every_flipped_bit_is_seen(kind):
    good = M.encode(kind, {n: 1 for n, _, _ in M.FIELDS[kind]})
    M.decode(kind, good)
    for bit in range(0, len(good) * 8, 7):
        bad = bytearray(good)
        bad[bit // 8] ^= 1 << bit % 8
        with pytest.raises(RingError):
            M.decode(kind, bytes(bad))
    for n in (0, 1, len(good) - 1):
        with pytest.raises(RingError):
            M.decode(kind, good[:n])


def test_every_cut_of_a_record_is_seen():
    for n in range(1, len(H(RECORD))):
        with pytest.raises(RingError):
            M.frame_decode(H(RECORD)[:n])


def _peak(f, raw: bytes) -> tuple[bytes, int]:
    tracemalloc.start()
    try:
        return f(raw), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def _long_text() -> bytes:
    """Of many pieces, with matches and runs over their edges."""
    r, n = random.Random(5), K._PIECE
    words = [r.randbytes(r.randint(2, 9)) for _ in range(3000)]
    text = b"".join(r.choices(words, k=120_000))
    return text[: n - 7] + b"r" * 300 + text + b"s" * (3 * n + 5) + text[-n:] + b"t" * 5 * n


def test_lz4_takes_memory_by_the_piece():
    raw = _long_text()
    packed, peak = _peak(K.lz4_encode, raw)
    assert K.lz4_decode(packed, len(raw)) == raw and len(packed) < len(raw) * 0.9
    assert peak < 24 << 20, peak


@pytest.mark.parametrize("raw", [b"a" * 200_000, b"ab" * 70_000 + b"c" * 70_000, random.Random(1).randbytes(66_000) * 2, random.Random(2).randbytes(1 << 16) + b"xyzw" * 9])
def test_lz4_pieces_do_not_show(raw, monkeypatch):
    want = K.lz4_encode(raw)
    for piece in (1000, 1 << 20):
        monkeypatch.setattr(K, "_PIECE", piece)
        assert K.lz4_encode(raw) == want
    assert K.lz4_decode(want, len(raw)) == raw


@given(st.lists(st.integers(0, 12), max_size=30), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_parts_are_all_rows_within_the_bound(sizes, most):
    got = [list(range(*p.indices(len(sizes)))) for p in K._parts(np.array(sizes, np.int64), most)]
    assert [i for p in got for i in p] == list(range(len(sizes)))
    assert all(p and (len(p) == 1 or sum(sizes[i] for i in p) <= most) for p in got)


@pytest.mark.parametrize("name", ["packbits", "lz4_block"])
def test_arrow_functions_answer_every_row(spark, name):
    big = b"0123456789abcdef" * (K.BATCH_BYTES // 16) + b"z" * 99
    rows = [None, b"", b"a", big, b"a" * 500, None, *(bytes([i % 256]) * i for i in range(300))]
    t = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(rows)], "i int, raw binary").coalesce(1)
    packed = K.encoded(F.col("raw"), name)
    back, trip = K.decoded(F.col("packed"), F.octet_length("raw"), name), K.round_tripped(F.col("raw"), name)
    got = t.withColumn("packed", packed).select("i", F.sha2("packed", 256), F.sha2(back, 256), F.sha2(trip, 256), K.crc32c_of(F.col("raw"))).orderBy("i").collect()
    sha = lambda x: None if x is None else hashlib.sha256(x).hexdigest()
    encode = lambda x: None if x is None else K.NAMES[name].encode(x)
    assert [tuple(r) for r in got] == [(i, sha(encode(x)), sha(x), sha(x), None if x is None else K.crc32c(x)) for i, x in enumerate(rows)]


def test_workers_are_sent_bounded_bytes(spark):
    @arrow_udf("long")
    def sent(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([a.get_total_buffer_size()] * len(a))

    catalogue.queries()["lz4_roundtrip"](spark, "/root/testdata/sf0.001")
    t = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 5000).cast("binary").alias("raw"))
    assert t.select(F.max(sent("raw"))).first()[0] < 1.1 * K.BATCH_BYTES


@pytest.mark.parametrize("name", ["packbits_roundtrip", "lz4_roundtrip"])
def test_a_round_trip_takes_one_worker(spark, name):
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_packbits_takes_memory_by_the_piece():
    raw = _long_text()
    packed, peak = _peak(K.packbits_encode, raw)
    assert K.packbits_decode(packed, len(raw)) == raw
    assert peak < 6 << 20, peak


@pytest.mark.parametrize("raw", [b"a" * 1000, b"aabbb" * 60, b"abc" * 99 + b"d" * 133, b"x" * 132 + b"yy"])
@pytest.mark.parametrize("piece", [1, 2, 7, 131])
def test_packbits_pieces_do_not_show(raw, piece, monkeypatch):
    want = K.packbits_encode(raw)
    monkeypatch.setattr(K, "_PIECE", piece)
    assert K.packbits_encode(raw) == want

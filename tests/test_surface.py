"""What callers use around volumes: options, locks, counters, health, hooks, numbers, and a model of the ring that writes are held against."""

from __future__ import annotations

import io
import os
import random
import threading

import numpy as np
import pytest
import volumes as V

import tidering
from tidering import cli
from tidering.errors import RingError
from tidering.functions import codecs as K
from tidering.sources import media as M
from tidering.sources import ringvol
from tidering.sources.media import FRAMED_PROFILE, Options
from tidering.sources.storage import Counting, FileStorage, MemoryStorage
from tidering.sources.volume import Snapshot, Writer, format_volume, query_records, summarised
from tidering.streaming.ingest import AsyncWriter

FRAMED = Options(record_format_id=FRAMED_PROFILE[0], record_format_version=1)


def memory(slots=3, partition=16384, index=4096, block=1024, quantum=512) -> MemoryStorage:
    s = MemoryStorage(8192 + slots * partition)
    format_volume(s, partition, index, block, quantum)
    return s


def test_published_vectors_of_digests_and_generators():
    # Published vectors of FNV-1a-64 and splitmix64.
    assert [K.fnv1a(x) for x in (b"", b"a", b"foobar")] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    assert K.fnv1a_many([b"", b"a", b"foobar"]).tolist() == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    assert K.splitmix64(np.array([0], np.uint64)).tolist() == [0xE220A8397B1DCDAF]
    state, out = 1234567, []
    for _ in range(5):
        out.append(int(K.splitmix64(np.array([state], np.uint64))[0]))
        state = (state + 0x9E3779B97F4A7C15) % 2**64
    assert out == [6457827717110365317, 3203168211198807973, 9817491932198370423, 4593380528125082431, 16408922859458223821]
    assert K.crc32c(bytes(32)) == 0x8A9136AA and K.crc32c(b"\xff" * 32) == 0x62A8AB43 and K.crc32c(bytes(range(32))) == 0x46DD794E


def test_version():
    assert tidering.__version__.count(".") == 2


def test_frames_by_columns_are_the_frames_one_by_one():
    r = random.Random(4)
    for sizes in ([8] * 50, [r.randrange(0, 90) for _ in range(60)], [0], [5000, 1, 70]):
        rows = [(r.randrange(-(2**63), 2**63), r.randrange(2**64), r.randrange(2**16), r.randbytes(n)) for n in sizes]
        t, s, f, p = zip(*rows, strict=True)
        made = M.frames_encode(np.array(t, np.int64), np.array(s, np.uint64), np.array(f, np.uint16), np.array([len(x) for x in p]), np.frombuffer(b"".join(p), np.uint8))
        assert made.data.tobytes() == b"".join(M.frame_encode(*x) for x in rows)
        back = M.frames_decode(made.data.tobytes())
        some = np.array([0, len(rows) - 1])
        assert back.payloads().to_pylist() == list(p) and back.payloads(some).to_pylist() == [p[0], p[-1]]
        assert back.encoded().to_pylist() == [M.frame_encode(*x) for x in rows] and (back.times.tolist(), back.selectors.tolist(), back.flags.tolist()) == (list(t), list(s), list(f))


def test_appending_by_columns_is_appending_one_by_one():
    r = random.Random(9)
    for trial in range(12):
        rows = [(r.choice([i * 10, r.randrange(-(2**63), 2**63)]), r.randrange(2**64), r.randrange(4), r.randbytes(r.randrange(200))) for i in range(150)]
        options = Options(trial % 3, 1, *FRAMED_PROFILE, 7, r.choice([-1, 0, 2**62]), r.choice([-1, 5, 2**63 - 1]))
        images = []
        for whole in (False, True):
            s = MemoryStorage(8192 + 3 * 16384)
            format_volume(s, 16384, 4096, 1024, 512, 0, (1, 2))
            w = Writer(s, options, (3, 4))
            for at in range(0, 150, 50):
                if whole:
                    t, sel, f, p = zip(*rows[at : at + 50], strict=True)
                    w.append_frames(np.array(t, np.int64), np.array(sel, np.uint64), np.array(f), np.array([len(x) for x in p]), b"".join(p))
                else:
                    for x in rows[at : at + 50]:
                        w.append_framed(*x)
                w.checkpoint()
            w.close()
            images.append((bytes(s.durable), w.metrics.time_anomalies, w.metrics.accepted_records, w.metrics.rotations))
        assert images[0] == images[1]
    with pytest.raises(RingError, match="out_of_range"):
        Writer(memory(), FRAMED).append_frames(np.array([1, 2]), np.array([1, 1]), np.array([0, 0]), np.array([3, 2000]), bytes(2003))


def test_options_of_the_next_rotation():
    s = memory()
    w = Writer(s, FRAMED)
    w.set_next_options(Options(record_format_id=FRAMED_PROFILE[0], record_format_version=1, time_domain_id=9))
    while w.metrics.rotations == 0:
        w.append(b"x" * 900, 1)
    w.close()
    assert [st.partition.options.time_domain_id for st in Snapshot(s).states] == [1, 9]


def test_a_writer_that_is_opened_again_compares_with_nothing():
    s = memory()
    for t in (100, 5):
        w = Writer(s, Options(time_domain_id=1, allowed_backward_skew_ns=0))
        w.append(b"x", t)
        w.close()
        assert w.metrics.time_anomalies == 0
    w = Writer(s, Options(time_domain_id=1, allowed_backward_skew_ns=0))
    w.append(b"x", 100)
    w.append(b"x", 5)
    assert w.metrics.time_anomalies == 1


def test_one_writer_at_a_time(tmp_path):
    p = str(tmp_path / "v")
    s = FileStorage.create(p, 8192 + 2 * 16384)
    with pytest.raises(RingError, match="busy"):
        FileStorage(p, writable=True)
    FileStorage(p).close()
    s.close()
    FileStorage(p, writable=True).close()
    with pytest.raises(RingError, match="invalid_argument"):
        FileStorage.create(p, 100)
    assert os.stat(p).st_blocks * 512 >= 8192 + 2 * 16384  # there before it is written
    told = FileStorage(p, size=8192)
    assert told.size == 8192


def test_writes_are_exact(tmp_path, monkeypatch):
    s = FileStorage.create(str(tmp_path / "v"), 100)
    real, calls = os.pwrite, []

    def some(fd, data, offset):
        calls.append(len(data))
        if len(calls) == 2:
            raise InterruptedError
        return real(fd, data[:3], offset)

    monkeypatch.setattr(os, "pwrite", some)
    s.write_at(5, b"0123456789")
    assert s.read_at(5, 10) == b"0123456789" and calls == [10, 7, 7, 4, 1]
    for n in (0, 11):
        monkeypatch.setattr(os, "pwrite", lambda fd, data, offset, n=n: n)
        with pytest.raises(RingError, match="io_error"):
            s.write_at(0, b"0123456789")
    with pytest.raises(RingError, match="no_space"):
        s.write_at(95, b"0123456789")


def test_counting():
    s = Counting(memory())
    w = Writer(s, FRAMED)
    w.append_framed(1, 2, 0, b"abc")
    w.close()
    assert s.writes == 2 and s.flushes == 2 and s.written_bytes == 1024 + 128 + 35 and s.reads > 4 and s.read_bytes > 1024


def test_ids_of_volumes():
    ids = {format_volume(MemoryStorage(8192 + 2 * 16384), 16384, 4096, 1024, 512).id for _ in range(20)}
    assert len(ids) == 20 and "0" * 32 not in ids


def test_metrics_and_health():
    now = [0]
    s = memory()
    w = Writer(s, FRAMED, clock=lambda: now[0])
    w.append_framed(1, 2, 0, b"abc")
    now[0] = 70
    h = w.health()
    assert (h.writable, h.closed, h.faulted, h.fault_code, h.oldest_undurable_age_ns, h.sync_errors) == (True, False, False, "ok", 70, 0)
    assert w.snapshot_metrics().oldest_undurable_age_ns == 70
    seen = []

    def stall(when, name, offset, size):
        if (when, name) == ("before", "flush"):
            now[0] += 30
            seen.append(w.health())  # while the storage stalls

    s.hook = stall
    w.checkpoint()
    m = w.metrics
    assert seen[0].oldest_undurable_age_ns == 100 and m.max_accepted_to_durable_ns == 100 and m.last_sync_duration_ns == m.max_sync_duration_ns == 30
    assert (m.sync_calls, m.checkpoints, m.durable_records, m.durable_blocks, w.health().oldest_undurable_age_ns) == (2, 1, 1, 1, 0)
    s.faults.append(("flush", 4, "io_error"))
    w.append_framed(1, 2, 0, b"abc")
    with pytest.raises(RingError, match="io_error"):
        w.checkpoint()
    h = w.health()
    assert (h.writable, h.faulted, h.fault_code, h.sync_errors) == (False, True, "io_error", 1)
    w.close()
    assert w.health().closed


def test_hooks_log_and_corruption():
    s = memory()
    s.log.clear()
    w = Writer(s, FRAMED)
    w.append_framed(1, 2, 0, b"abc")
    w.checkpoint()
    assert [x[0] for x in s.log] == ["write", "flush", "write", "flush"]
    s.corrupt(8192 + 4096 + 130)
    assert not list(Snapshot(s).events())  # the tail ends before the damaged block
    s.corrupt(8192 + 4096 + 130)
    assert len(list(Snapshot(s.crash()).events())) == 1


def test_summary_and_rolling_digest():
    s = MemoryStorage(0, V.valid_mixed())
    events = list(Snapshot(s).events())
    digest = 0xCBF29CE484222325
    for e in events:
        parts = [x.to_bytes(8, "little") for x in (e.generation, e.block["sequence"], e.slot, e.block["flags"])]
        for byte in b"".join([*parts, *(whole for *_, whole in M.frame_decode(e.data))]):
            digest = (digest ^ byte) * 0x100000001B3 % 2**64
    got = summarised(Snapshot(s))
    assert (got.records, got.blocks, got.raw_bytes, got.gaps, got.digest) == (8, 4, 714, 0, digest)
    s.corrupt(12416)
    assert summarised(Snapshot(s)).gaps == 1 and summarised(Snapshot(s)).digest != digest


def test_generations_end():
    s = memory()
    w = Writer(s, FRAMED)
    w.partition = M.Partition(M.U64, w.partition.slot, w.partition.options)
    with pytest.raises(RingError, match="generation_exhausted"):
        w.rotate()


def test_numbers_of_commands():
    assert [cli.unsigned(x) for x in ("0", "10", "0x1F", "017", "18446744073709551615")] == [0, 10, 31, 15, 2**64 - 1]
    assert [cli.signed(x) for x in ("-5", "-0x10", "9223372036854775807", "-9223372036854775808", "+3")] == [-5, -16, 2**63 - 1, -(2**63), 3]
    for f, bad in ((cli.unsigned, ("1_000", "-5", "", "0x", "5x", "18446744073709551616", "08", "1.0", "٣")), (cli.signed, ("1_000", "9223372036854775808", "-9223372036854775809", "--5", "0b1"))):
        for x in bad:
            with pytest.raises(Exception, match="number|range|negative"):
                f(x)


class _Out(io.StringIO):
    def __init__(self):
        super().__init__()
        self.buffer = io.BytesIO()


def test_dump_of_raw_blocks_and_gaps(tmp_path):
    p = tmp_path / "v"
    p.write_bytes(V.valid_mixed())
    out = _Out()
    assert cli.main(["dump", str(p), "--raw-blocks"], out) == 0
    data, at, blocks = out.buffer.getvalue(), 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        blocks.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    assert blocks == [e.data for e in Snapshot(MemoryStorage(0, V.valid_mixed())).events()]
    p.write_bytes(V.patched(V.valid_mixed(), (8192, "B", 0x58)))
    assert cli.main(["dump", str(p)], io.StringIO()) == 3
    assert cli.main(["dump", str(p), "--from", "-5x"], io.StringIO()) == 1


def test_a_gap_is_delivered_before_it_fails(tmp_path):
    p = tmp_path / "v"
    p.write_bytes(V.patched(V.valid_mixed(), (12416, "B", 1)))
    reader = ringvol.Reader({"path": str(p), "on_gap": "fail", "verify_payload_crc": "false"})
    kinds = []
    with pytest.raises(RingError, match="corrupt"):
        for part in reader.partitions():
            for b in reader.read(part):
                kinds += b.column("kind").to_pylist()
    assert kinds[-1] == "corrupt_gap"


def test_checked_submits_and_timed_checkpoints():
    now = [0]
    s = memory()
    a = AsyncWriter(Writer(s, FRAMED), interval_ns=1000, clock=lambda: now[0]).start()
    a.submit(M.frame_encode(1, 2, 0, b"x"), 1, 0, (*FRAMED_PROFILE, 1))
    until = lambda f: all(not f() and not threading.Event().wait(0.01) for _ in range(500)) or True
    until(lambda: a.metrics.appended == 1)
    assert a.durable_sequence == 0
    now[0] = 1000
    until(lambda: a.durable_sequence == 1)
    assert a.durable_sequence == 1 and a.metrics.max_accepted_to_durable_ns == 1000
    a.submit(b"x", 1, 0, (5, 1, 1))  # the active partition has another profile
    with pytest.raises(RingError, match="unsupported"):
        a.checkpoint(20)
    with pytest.raises(RingError, match="unsupported"):
        a.stop()


class Model:
    """The ring in plain Python: which records each block and generation must hold. It shares no code with the writer."""

    def __init__(self, slots, data, entries, most, quantum):
        self.slots, self.data, self.entries, self.most, self.quantum = slots, data, entries, most, quantum
        self.partitions = [(1, [])]
        self.open: list = []
        self.bytes = 0
        self.durable: list = []

    def span(self, n):
        return -(-(128 + n) // self.quantum) * self.quantum

    def append(self, record):
        n = 32 + len(record[3])
        if self.bytes + n > self.most:
            self.publish()
        if not self.open:
            generation, blocks = self.partitions[-1]
            if sum(self.span(b) for b, _ in blocks) + self.span(self.most) > self.data or len(blocks) >= self.entries:
                self.rotate()
        self.open.append(record)
        self.bytes += n

    def publish(self):
        if self.open:
            self.partitions[-1][1].append((self.bytes, self.open))
            self.open, self.bytes = [], 0

    def checkpoint(self):
        self.publish()
        self.durable = [(g, list(b)) for g, b in self.partitions]

    def rotate(self):
        self.publish()
        self.partitions.append((self.partitions[-1][0] + 1, []))
        self.partitions = self.partitions[-self.slots :]
        self.durable = [(g, list(b)) for g, b in self.partitions]

    def rows(self, partitions):
        return [(g, n, k, *r) for g, blocks in partitions for n, (_, records) in enumerate(blocks) for k, r in enumerate(records)]


@pytest.mark.parametrize("seed", range(8))
def test_writes_equal_the_model(seed):
    """Random appends, publishes, checkpoints, rotations, reopenings and crashes: readers see what the model holds."""
    r = random.Random(seed)
    s = memory()
    m = Model(3, 16384 - 8192 - 4096, 4096 // 48, 1024, 512)
    w = Writer(s, FRAMED)
    rows = lambda storage: [tuple(x) for x in query_records(Snapshot(storage), -(2**62), 2**62, 1)]
    for n in range(400):
        step = r.random()
        if step < 0.85:
            record = (n * 5 - 300, r.randrange(2**64), r.randrange(8), r.randbytes(r.randrange(300)))
            w.append_framed(*record)
            m.append(record)
        elif step < 0.9:
            w.publish()
            m.publish()
        elif step < 0.95:
            w.checkpoint()
            m.checkpoint()
            assert rows(s.crash()) == m.rows(m.durable)
        elif step < 0.97:
            w.rotate()
            m.rotate()
        else:
            w.close()
            m.checkpoint()
            w = Writer(s, FRAMED)
        if n % 40 == 0:
            assert rows(s) == m.rows(m.partitions)
    w.close()
    m.checkpoint()
    assert rows(s) == m.rows(m.partitions) and rows(s.crash()) == m.rows(m.partitions)
    Snapshot(s, strict=True)


def test_readers_beside_a_live_writer():
    """Whatever moment a reader opens at: a run of ordinals without a hole, of whole records, or gaps that say overwritten."""
    s = memory(slots=4)
    stop, failures, read = threading.Event(), [], [0]

    def follow():
        while not stop.is_set():
            try:
                snap = Snapshot(s)
                for st in snap.states:
                    seen = []
                    for e in snap.partition_events(st):
                        if e.kind == "overwritten_gap":
                            break
                        if e.kind != "data":
                            # only the tail that is being written may be cut off
                            assert not st.sealed, e
                            break
                        seen += [(t, p) for t, _, _, p, _ in M.frame_decode(e.data)]
                    assert [t for t, _ in seen] == list(range(seen[0][0], seen[0][0] + len(seen))) if seen else True
                    assert all(p == b"%d" % t * 20 for t, p in seen)
                    read[0] += len(seen)
            except RingError as e:
                if e.code not in ("corrupt", "overwritten"):
                    failures.append(e)
            except AssertionError as e:
                failures.append(e)
                return

    readers = [threading.Thread(target=follow) for _ in range(3)]
    for t in readers:
        t.start()
    w = Writer(s, FRAMED)
    for n in range(6000):
        w.append_framed(n, 1, 0, b"%d" % n * 20)
        if n % 20 == 0:
            w.checkpoint()
    w.close()
    stop.set()
    for t in readers:
        t.join()
    assert not failures and w.metrics.rotations > 20 and read[0] > 0

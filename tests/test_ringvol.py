"""The data source, its stream and sinks, ingest and the commands."""

from __future__ import annotations

import io
import os

import numpy as np
import pytest
import volumes as V
from pyspark.sql import functions as F

from tidering import cli
from tidering.errors import RingError
from tidering.functions.codecs import Codec
from tidering.sources import media as M
from tidering.sources import ringvol
from tidering.sources.media import FRAMED_PROFILE, Options
from tidering.sources.storage import FileStorage, MemoryStorage
from tidering.sources.volume import Snapshot, Writer, format_volume, query_records
from tidering.streaming.ingest import AsyncWriter


@pytest.fixture
def mixed(tmp_path):
    p = tmp_path / "mixed"
    p.write_bytes(V.valid_mixed())
    return str(p)


def _read(spark, path, **options):
    ringvol.register(spark)
    return spark.read.format("ringvol").options(**options).load(path)


def test_tables(spark, mixed):
    assert _read(spark, mixed, mode="volume").first()["volume_id"] == "01020304050607081112131415161718"
    parts = _read(spark, mixed, mode="partitions").orderBy("generation").collect()
    assert [(p["sealed"], p["block_count"], int(p["time_domain_id"])) for p in parts] == [(True, 3, 42), (False, 1, 43)]
    blocks = _read(spark, mixed, mode="blocks").orderBy("event_order").collect()
    assert [(b["block_sequence"], b["min_time_ns"], b["max_time_ns"], b["flags"], b["raw_size"]) for b in blocks] == [(0, -100, 0, 2, 201), (1, 900, 1000, 1, 193), (2, 1600, 1600, 1, 152), (0, 1500, 2500, 0, 168)]
    assert _read(spark, mixed).where("kind = 'data'").count() == 8


def test_filters_reach_the_source_and_stay_exact(spark, mixed):
    q = _read(spark, mixed).where((F.col("index_time_ns") >= 950) & (F.col("index_time_ns") < 1700) & (F.col("time_domain_id") == 42))
    assert sorted(r["index_time_ns"] for r in q.collect()) == [1000, 1600]
    q = _read(spark, mixed, begin="-200", end="1700", time_domain="42").where(F.col("selector").isin(10))
    assert [(r["record_position"], r["index_time_ns"]) for r in q.orderBy("event_order", "record_position").collect()] == [(0, -100), (0, 1000)]


def test_gaps(spark, tmp_path):
    p = tmp_path / "bad"
    p.write_bytes(V.patched(V.valid_mixed(), (8192, "B", 0x58)))
    kinds = [r["kind"] for r in _read(spark, str(p), begin="0", end="10", time_domain="7").orderBy("event_order").collect()]
    assert kinds == ["corrupt_gap"]
    assert _read(spark, str(p), mode="gaps").count() == 1
    with pytest.raises(Exception, match="corrupt"):
        _read(spark, str(p), on_gap="fail").collect()
    with pytest.raises(Exception, match="corrupt"):
        _read(spark, str(p), verify="strict").collect()


def test_folder_of_volumes(spark, tmp_path, mixed):
    (tmp_path / "other").write_bytes(V.lz4_blocks())
    assert _read(spark, str(tmp_path), mode="blocks").groupBy().agg(F.sum("raw_size")).first()[0] == 714 + 6240


def _volume(path, slots=4):
    s = FileStorage.create(str(path), 8192 + slots * 65536)
    format_volume(s, 65536, 4096, 4096, 512)
    s.close()
    return str(path)


def test_batch_sink_appends_in_order(spark, tmp_path):
    ringvol.register(spark)
    p = _volume(tmp_path / "v")
    rows = spark.range(500).select(F.col("id").alias("ordinal"), (F.col("id") * 10).alias("index_time_ns"), (F.col("id") % 7).alias("selector"), F.lit(0).alias("flags"), F.encode(F.col("id").cast("string"), "utf-8").alias("payload"))
    for part in (rows.where("id < 300"), rows.where("id >= 300")):
        part.repartition(3).write.format("ringvol").option("compression", "lz4_block").mode("append").save(p)
    got = [int(r[6]) for r in query_records(Snapshot(FileStorage(p)), 0, 10**9, 1)]
    assert got == list(range(500))
    assert not list(tmp_path.glob("*.staged-*"))


def _filled(path, times, **options):
    w = Writer(FileStorage(path, writable=True), Options(record_format_id=FRAMED_PROFILE[0], record_format_version=1, **options))
    for t in times:
        w.append_framed(t, 1, 0, b"%d" % t)
        w.publish()
    w.close()


def test_extreme_times_pass_every_bound(spark, tmp_path):
    least, most = -(2**63), 2**63 - 1
    p = _volume(tmp_path / "v")
    _filled(p, [least, 5, most])
    q = _read(spark, p).where("kind = 'data'")
    times = lambda df: sorted(r["index_time_ns"] for r in df.collect())
    assert times(q) == [least, 5, most]
    t = F.col("index_time_ns")
    assert times(q.where(t >= 5)) == [5, most] and times(q.where(t > 5)) == [most] and times(q.where(t == most)) == [most] and times(q.where(t <= least)) == [least] and times(q.where((t >= least) & (t <= most))) == [least, 5, most]
    assert times(q.where(t < least)) == [] and times(q.where(t > most)) == []


def test_a_read_is_of_the_snapshot_it_was_planned_on(spark, tmp_path):
    """Neither a record that is appended after planning nor a rotation changes what its tasks read, however often they do."""
    p = _volume(tmp_path / "v")
    _filled(p, range(5))
    reader = ringvol.Reader({"path": p})
    parts = reader.partitions()
    read = lambda: [t for part in parts for b in reader.read(part) for t in b.column("index_time_ns").to_pylist()]
    assert read() == list(range(5))
    _filled(p, range(5, 9))
    assert read() == list(range(5))
    w = Writer(FileStorage(p, writable=True))
    w.rotate()
    w.close()
    assert read() == list(range(5)) and _read(spark, p).where("kind = 'data'").count() == 9
    for _ in range(4):  # the slot is used again
        w = Writer(FileStorage(p, writable=True))
        w.append(b"x", 0)
        w.rotate()
        w.close()
    assert [k for part in parts for b in reader.read(part) for k in b.column("kind").to_pylist()] == ["overwritten_gap"]


def test_tasks_read_their_partition_only(tmp_path, monkeypatch):
    p = _volume(tmp_path / "v")
    for n in range(3):
        _filled(p, [n])
        w = Writer(FileStorage(p, writable=True))
        w.rotate(Options(record_format_id=FRAMED_PROFILE[0], record_format_version=1))
        w.close()
    reader = ringvol.Reader({"path": p})
    parts = reader.partitions()
    seen = []
    real = FileStorage.read_at
    monkeypatch.setattr(FileStorage, "read_at", lambda self, offset, size: seen.append(offset) or real(self, offset, size))
    for part in parts:
        seen.clear()
        list(reader.read(part))
        begin = 8192 + part.state.partition.slot * 65536
        assert seen and all(begin <= x < begin + 65536 for x in seen)


REVERSED = {(9, 1): Codec(9, 1, lambda b: b[::-1][: len(b) - 1] if len(set(b[:1] + b[-1:])) == 1 else b, lambda b, n: b[:1] + b[::-1] if len(b) < n else b, lambda n: n)}


def _lines(block: bytes):
    """A record profile of its own: lines of `time selector text`."""
    rows = [x.split(b" ", 2) for x in block.splitlines()]
    data = np.frombuffer(b"".join(bytes(32) + r[2] for r in rows), np.uint8)
    sizes = np.array([32 + len(r[2]) for r in rows], np.int64)
    return M.Frames(data, np.cumsum(sizes) - sizes, sizes, np.array([int(r[0]) for r in rows], np.int64), np.array([int(r[1]) for r in rows], np.uint64), np.zeros(len(rows), np.uint16))


LINES = {(77, 1): _lines}


def test_profiles_and_codecs_are_options(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("PYTHONPATH", f"{os.path.dirname(__file__)}{os.pathsep}{os.environ.get('PYTHONPATH', '')}")
    p = _volume(tmp_path / "v")
    _filled(p, [1, 2])
    w = Writer(FileStorage(p, writable=True), registry=REVERSED)
    w.rotate(Options(9, 1, record_format_id=77, record_format_version=1))
    w.append(b"10 4 hello\n", 10, contract=(77, 1, 1))
    w.append(b"11 5 all\n", 11, contract=(77, 1, 1))
    w.close()
    here = f"{__name__}:"
    with pytest.raises(RingError, match="unsupported"):
        list(ringvol.Reader({"path": p}).partitions())
    reader = ringvol.Reader({"path": p, "codecs": here + "REVERSED", "profiles": here + "LINES"})
    got = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert [(r["index_time_ns"], int(r["selector"]), r["payload"]) for r in got] == [(1, 1, b"1"), (2, 1, b"2"), (10, 4, b"hello"), (11, 5, b"all")]
    skipping = ringvol.Reader({"path": p, "codecs": here + "REVERSED", "other_profiles": "skip"})
    assert [t for part in skipping.partitions() for b in skipping.read(part) for t in b.column("index_time_ns").to_pylist()] == [1, 2]
    failing = ringvol.Reader({"path": p, "codecs": here + "REVERSED"})
    with pytest.raises(RingError, match="unsupported"):
        [list(failing.read(part)) for part in failing.partitions()]
    with pytest.raises(RingError, match="registry"):
        ringvol.Reader({"path": p, "codecs": "no.such:thing"})


def test_a_repeated_commit_writes_nothing_twice(tmp_path, monkeypatch):
    """The first commit fails at every point in turn, between the note, the appends and the note after them; the second makes up for it."""
    import pyarrow as pa

    def staged(sink, n):
        files = []
        for k in range(2):
            files.append(f"{sink.path}.staged-{n}-{k}")
            rows = [(i, i, 1, 0, b"%d" % i) for i in range(n * 50, n * 50 + 50) if i % 2 == k]
            table = pa.table({c: pa.array(v, t) for (c, t), v in zip({"ordinal": pa.int64(), "t": pa.int64(), "s": pa.uint64(), "f": pa.int32(), "p": pa.binary()}.items(), zip(*rows, strict=True), strict=True)})
            with pa.OSFile(files[-1], "wb") as out, pa.ipc.new_file(out, table.schema) as w:
                w.write_table(table)
        return [ringvol.Staged(0, files)]

    class Crash(Exception):
        pass

    for point in range(24):
        p = _volume(tmp_path / f"v{point}")
        sink = ringvol.StreamWriter({"path": p, "checkpoint_every": "7"})
        sink.commit(staged(sink, 0), 0)
        left = [point]

        def maybe(left=left):
            left[0] -= 1
            if left[0] < 0:
                raise Crash

        with monkeypatch.context() as m:
            for cls, name in ((FileStorage, "write_at"), (FileStorage, "flush"), (ringvol.StreamWriter, "_note")):
                real = getattr(cls, name)
                m.setattr(cls, name, lambda self, *a, real=real: (maybe(), real(self, *a))[1])
            try:
                sink.commit(staged(sink, 1), 1)
            except Crash:
                pass
        again = ringvol.StreamWriter({"path": p, "checkpoint_every": "7"})
        again.commit(staged(again, 1), 1)
        again.commit(staged(again, 1), 1)
        again.commit(staged(again, 2), 2)
        assert [r[3] for r in query_records(Snapshot(FileStorage(p)), 0, 10**9, 1)] == list(range(150)), point


def test_streams(spark, tmp_path):
    ringvol.register(spark)
    source, target = _volume(tmp_path / "s"), _volume(tmp_path / "t")

    def fill(a, b):
        w = Writer(FileStorage(source, writable=True), Options(record_format_id=FRAMED_PROFILE[0], record_format_version=1))
        for i in range(a, b):
            w.append_framed(i, i, 0, b"%d" % i)
        w.close()

    def follow():
        df = spark.readStream.format("ringvol").load(source).where("kind = 'data'")
        df = df.select(F.col("index_time_ns").alias("ordinal"), "index_time_ns", F.col("selector").cast("long").alias("selector"), F.col("record_flags").alias("flags"), "payload")
        q = df.writeStream.format("ringvol").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(target)
        q.awaitTermination(120)
        assert q.exception() is None

    fill(0, 40)
    follow()
    fill(40, 100)
    follow()
    assert [r[3] for r in query_records(Snapshot(FileStorage(target)), 0, 10**9, 1)] == list(range(100))


def test_stream_reports_what_was_overwritten(tmp_path):
    p = _volume(tmp_path / "v", slots=2)
    w = Writer(FileStorage(p, writable=True))
    for t in range(4):
        w.append(b"x", t)
        w.rotate()
    w.close()
    r = ringvol.StreamReader({"path": p, "mode": "blocks"})
    parts = r.partitions({"generation": 1, "sequence": 0}, r.latestOffset())
    kinds = [k for part in parts for b in r.read(part) for k in b.column(0).to_pylist()]
    assert kinds.count("overwritten_gap") == 3 and kinds.count("data") == 1


def test_folder_sink_writes_a_volume_a_task(spark, tmp_path):
    ringvol.register(spark)
    p = str(tmp_path / "f")
    rows = spark.range(3000).select(F.col("id").alias("ordinal"), (F.col("id") * 10).alias("index_time_ns"), (F.col("id") % 7).alias("selector"), F.lit(0).alias("flags"), F.encode(F.repeat(F.col("id").cast("string"), F.lit(30)), "utf-8").alias("payload"))
    options = {"layout": "folder", "compression": "packbits", "partition_size": "65536", "index_size": "4096", "block": "4096", "quantum": "512"}
    rows.repartition(3).write.format("ringvol").options(**options).mode("append").save(p)
    assert len(ringvol.volumes_of(p)) == 3 and len(os.listdir(p)) == 3
    got = _read(spark, p).where("kind = 'data'")
    assert got.count() == 3000 and got.agg(F.sum("index_time_ns")).first()[0] == 10 * 2999 * 3000 // 2
    assert _read(spark, p, mode="gaps").count() == 0
    sink = ringvol.StreamWriter(options | {"path": p})
    for n in range(2):  # the commit of a batch, and the same again
        made = tmp_path / "f" / f".x{n}"
        made.write_bytes(open(ringvol.volumes_of(p)[0], "rb").read())
        sink.commit([ringvol.Staged(0, [], str(made))], 5)
    assert len(os.listdir(p)) == 4
    with pytest.raises(RingError, match="layout"):
        ringvol.BatchWriter({"path": p, "layout": "other"})


def test_ingest_queue():
    s = MemoryStorage(8192 + 2 * 65536)
    format_volume(s, 65536, 4096, 4096, 512)
    a = AsyncWriter(Writer(s), records=100, size=64, interval_ns=0).start()
    with pytest.raises(RingError, match="busy"):
        a.submit(b"x" * 65, 0)
    for i in range(20):
        while True:
            try:
                a.submit(b"abc", i)
                break
            except RingError:
                pass
    a.checkpoint(20)
    assert a.durable_sequence == 20 == a.metrics.durable
    m = a.snapshot_metrics()
    assert m.durable_sequence == 20 and m.checkpoints >= 1 and m.busy >= 1 and 3 <= m.max_queued_bytes <= 64 and 1 <= m.max_queued_records <= 21 and m.oldest_undurable_age_ns == 0
    a.stop()
    with pytest.raises(RingError, match="closed"):
        a.submit(b"x", 0)
    assert b"".join(e.data for e in Snapshot(s).events()) == b"abc" * 20


def test_ingest_failure_stays():
    s = MemoryStorage(8192 + 2 * 65536)
    format_volume(s, 65536, 4096, 4096, 512)
    a = AsyncWriter(Writer(s), interval_ns=0).start()
    s.fail_writes_after = s.writes
    a.submit(b"x", 1)
    with pytest.raises(RingError, match="io_error"):
        a.checkpoint(20)
    with pytest.raises(RingError, match="io_error"):
        a.submit(b"y", 2)
    assert a.snapshot_metrics().errors == 1


def test_commands(tmp_path, mixed):
    out = io.StringIO()
    assert cli.main(["inspect", mixed], out) == 0 and "generation=2 active blocks=1" in out.getvalue()
    out = io.StringIO()
    assert cli.main(["verify", mixed], out) == 0 and out.getvalue() == "blocks=4 records=8 raw_bytes=714 gaps=0\n"
    out = io.StringIO()
    assert cli.main(["dump", mixed, "--framed", "--from", "-200", "--to", "1700", "--selector", "0xa", "--time-domain", "42"], out) == 0
    assert [x.split()[2] for x in out.getvalue().splitlines()] == ["-100", "1000"]
    bad = tmp_path / "bad"
    bad.write_bytes(V.patched(V.valid_mixed(), (8192, "B", 0x58)))
    assert cli.main(["verify", str(bad)], io.StringIO()) == 3
    assert cli.main(["verify", str(bad), "--strict"], io.StringIO()) == 2
    assert cli.main(["dump", mixed, "--selector", "1"], io.StringIO()) == 2
    assert cli.main(["nothing"], io.StringIO()) == 1
    new = str(tmp_path / "new")
    args = ["format", new, "--size", "139264", "--partition-size", "65536", "--index-size", "4096", "--block", "256", "--quantum", "512"]
    assert cli.main(args, io.StringIO()) == 0 and cli.main(args, io.StringIO()) == 2
    assert cli.main(["inspect", new], io.StringIO()) == 0

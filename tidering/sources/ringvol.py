"""The data source `ringvol`: volumes as tables, streams and sinks.

    spark.dataSource.register(RingVolume)
    spark.read.format("ringvol").option("mode", "records").load(path)

path is a volume, a folder of volumes, or several separated by commas, on a file system
that driver and tasks share. Every partition of every volume is one task. Options:

mode          volume, partitions, blocks, records, gaps (default: records)
verify        lazy or strict (default: lazy)
on_gap        continue, or fail at the first gap (default: continue)
payload       false leaves blocks undecoded, for modes blocks and partitions
begin, end, time_domain   a range query; filters on the columns are pushed down as well
codecs, profiles   module:name of a dict of further codecs, or of decoders of record profiles, by (id, version)
other_profiles     fail at a block of a profile without a decoder, or skip it (default: fail)
size          of the volume, where the path is a device that doesn't tell
verify_payload_crc   taken and ignored: payloads are always verified

A read is of one snapshot, taken when it is planned: what is appended afterwards is not
in it, and tasks that are repeated read the same again. A range or domain never hides the gap of a damaged header. A filter on a column that
gaps don't have drops them, as SQL has it; mode gaps has them alone.
"""

from __future__ import annotations

import glob
import heapq
import importlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from .. import schema
from ..errors import RingError, invalid
from . import media as M
from .storage import FileStorage
from .volume import PROFILES, Event, Snapshot, State, Writer, chosen, format_volume, frames_of, summary

MODES = {"volume": schema.VOLUME, "partitions": schema.PARTITIONS, "blocks": schema.BLOCK_EVENTS, "gaps": schema.BLOCK_EVENTS, "records": schema.RECORD_EVENTS}
LEAST, MOST = -(1 << 63), (1 << 63) - 1


#: Rows in a batch of a sink, and in a run that a sink's task sorts.
BATCH_ROWS, RUN_ROWS = 4096, 100_000
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "decimal(20,0)": pa.decimal128(20, 0)}


def _schema(mode: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in MODES[mode].split(", ")])


def _unsigned(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit numbers as decimals, which have 16 bytes each."""
    wide = np.zeros((len(x), 2), np.uint64)
    wide[:, 0] = x
    return pa.Array.from_buffers(pa.decimal128(20, 0), len(x), [None, pa.py_buffer(wide)])


def _batch(mode: str, rows: list[tuple]) -> pa.RecordBatch:
    schema_ = _schema(mode)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema_, strict=True)], schema=schema_)


def named(path: str | None) -> dict | None:
    """The dict that module:name stands for."""
    if not path:
        return None
    module, _, name = path.partition(":")
    try:
        return dict(getattr(importlib.import_module(module), name))
    except (ImportError, AttributeError, TypeError, ValueError) as e:
        raise invalid(f"{path!r} names no registry: {e}") from e


def volumes_of(path: str) -> list[str]:
    out = []
    for p in path.split(","):
        p = p.removeprefix("file:")
        p = "/" + p.lstrip("/") if p.startswith("//") else p
        out += sorted(x for x in glob.glob(os.path.join(p, "*")) if os.path.isfile(x) and not os.path.basename(x).startswith((".", "_"))) if os.path.isdir(p) else [p]
    if not out:
        raise RingError("not_found", path)
    return out


class Part(InputPartition):
    """A partition of a volume as it was planned, or with state None what belongs to the whole volume.

    rows: what the plan knows already, of modes volume and partitions; damaged: slots whose headers are; gone: a generation
    that isn't there any more. after and upto bound the block sequences.
    """

    def __init__(self, path: str, volume: M.Volume | None = None, state: State | None = None, order: int = -1, after: int = -1, upto: int = M.U64, damaged: list[int] | None = None, rows: list[tuple] | None = None, gone: tuple[int, int] | None = None):
        super().__init__(None)
        self.path, self.volume, self.order, self.after, self.upto = path, volume, order, after, upto
        self.state = replace(state, index=None) if state else None
        self.damaged, self.rows, self.gone = damaged or [], rows or [], gone


class Request:
    """What is asked of a source: its options, and what its filters allow to skip."""

    def __init__(self, options: dict[str, str]):
        get = {k.lower(): v for k, v in options.items()}.get
        self.path = get("path") or ""
        self.mode, self.strict, self.fail = get("mode", "records"), get("verify", "lazy") == "strict", get("on_gap", "continue") == "fail"
        self.decode = get("payload", "true") != "false"
        if self.mode not in MODES:
            raise invalid(f"no mode {self.mode!r}")
        self.codecs, self.profiles = named(get("codecs")), named(get("profiles"))
        self.skip, self.size = get("other_profiles", "fail") == "skip", int(get("size"), 0) if get("size") else None
        if get("other_profiles", "fail") not in ("fail", "skip"):
            raise invalid("other_profiles is fail or skip")
        if get("verify", "lazy") not in ("lazy", "strict") or get("on_gap", "continue") not in ("continue", "fail"):
            raise invalid("verify is lazy or strict, on_gap continue or fail")
        self.domain = int(get("time_domain"), 0) if get("time_domain") else None
        begin, end = get("begin"), get("end")
        self.ranged = begin is not None or end is not None
        self.begin, self.end = int(begin, 0) if begin else LEAST, int(end, 0) if end else MOST
        if self.ranged and (not self.domain or self.begin >= self.end):
            raise invalid("a range needs begin < end and a time domain")
        #: what a block's envelope must meet, both ends included; and the selectors that count
        self.lo, self.hi, self.selectors = self.begin, self.end - self.ranged, None

    def narrow(self, f: Filter) -> None:
        """Takes a filter for skipping blocks; it is applied to the rows all the same."""
        name = f.attribute[-1] if hasattr(f, "attribute") else ""
        if self.mode == "records" and name == "index_time_ns":
            if isinstance(f, EqualTo):
                self.lo, self.hi = max(self.lo, f.value), min(self.hi, f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.hi = min(self.hi, f.value - isinstance(f, LessThan))
        elif self.mode == "records" and name == "selector" and isinstance(f, (EqualTo, In)):
            some = {int(v) for v in (f.value if isinstance(f, In) else [f.value])}
            self.selectors = some if self.selectors is None else self.selectors & some
        elif name == "time_domain_id" and isinstance(f, EqualTo) and self.domain is None:
            self.domain = int(f.value)

    def snapshot(self, path: str, strict: bool = False) -> Snapshot:
        s = FileStorage(path, size=self.size)
        try:
            return Snapshot(s, strict, self.codecs)
        finally:
            s.close()

    def plan(self) -> list[Part]:
        parts: list[Part] = []
        for path in volumes_of(self.path):
            snap = self.snapshot(path, self.strict)
            v = snap.volume
            if self.mode == "volume":
                parts.append(Part(path, rows=[(v.id, v.volume_size, v.partition_size, v.partition_count, v.index_region_size, v.max_block_payload, v.persistence_quantum, v.created_time_ns)]))
                continue
            if self.mode == "partitions":
                parts.append(Part(path, rows=[_partition(st) for st in snap.states]))
                continue
            if snap.damaged:
                parts.append(Part(path, v, damaged=snap.damaged))
            parts += [Part(path, v, st, n) for n, st in enumerate(snap.states) if self.domain is None or st.partition.options.time_domain_id == self.domain]
        return parts or [Part("")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.rows:
            yield _batch(self.mode, part.rows)
        if part.volume is None and not part.gone:
            return
        rows: list[tuple] = []
        size = 0
        for e in self._events(part):
            if e.kind != "data" and self.fail:  # the gap is delivered, then it fails
                yield _batch(self.mode, [*rows, self._row(part, e)])
                raise RingError("overwritten" if e.kind == "overwritten_gap" else "corrupt", e.error.message if e.error else e.kind)
            if self.mode == "records" and e.kind == "data":
                if rows:  # a gap that comes before
                    yield _batch(self.mode, rows)
                    rows = []
                if (batch := self._records(part, e)) is not None:
                    yield batch
            elif self.mode != "gaps" or e.kind != "data":
                rows.append(self._row(part, e))
                size += len(e.data or b"")
                if len(rows) >= BATCH_ROWS or size >= 16 << 20:
                    yield _batch(self.mode, rows)
                    rows, size = [], 0
        if rows:
            yield _batch(self.mode, rows)

    def _events(self, part: Part) -> Iterator[Event]:
        if part.gone:
            yield Event("overwritten_gap", *part.gone, error=RingError("overwritten", "reused since it was due"))
            return
        s = FileStorage(part.path, size=self.size)
        try:
            snap = Snapshot.planned(s, part.volume, [part.state] if part.state else [], part.damaged, self.codecs)
            yield from snap.gaps()
            if part.state is None or self.lo > self.hi:
                return
            whole = (self.lo, self.hi) == (LEAST, MOST)
            for e in snap.partition_events(part.state, None if whole else (self.lo, self.hi), self.decode or self.mode in ("records", "gaps")):
                if e.block is None or part.after < e.block["sequence"] <= part.upto:
                    yield e
        finally:
            s.close()

    def _order(self, part: Part, e: Event) -> int:
        return (part.order << 32) + (e.block["sequence"] + 1 if e.block else 0) if part.state or part.gone else e.slot - (1 << 32)

    def _records(self, part: Part, e: Event) -> pa.RecordBatch | None:
        """The records of a data event that are asked for."""
        o = e.partition.options
        if self.skip and (key := (o.record_format_id, o.record_format_version)) not in (self.profiles or {}) and key not in PROFILES:
            return None
        f = frames_of(e, self.profiles)
        some = chosen(f, self.lo, self.hi, None if self.selectors is None else np.array(sorted(x for x in self.selectors if 0 <= x <= M.U64), np.uint64))
        numbers = np.arange(len(f)) if some is None else some
        n = len(numbers)
        if not n:
            return None
        same = lambda value, kind: pa.nulls(n, kind) if value is None else pa.repeat(pa.scalar(value, kind), n)
        long_ = pa.int64()
        cols = [
            same(e.kind, pa.string()), same(e.slot, pa.int32()), _unsigned(np.full(n, e.generation, np.uint64)), same(e.block["sequence"], long_), pa.array(numbers, long_), pa.array(f.times[numbers]),
            _unsigned(f.selectors[numbers]), pa.array(f.flags[numbers].astype(np.int32)), f.payloads(some), f.encoded(some), _unsigned(np.full(n, o.time_domain_id, np.uint64)), same(None, pa.string()), same(None, pa.string()), same(self._order(part, e), long_),
        ]
        return pa.RecordBatch.from_arrays(cols, schema=_schema("records"))

    def _row(self, part: Part, e: Event) -> tuple:
        b, o, order = e.block or {}, e.partition.options if e.partition else None, self._order(part, e)
        code, message = (e.error.code, e.error.message) if e.error else (None, None)
        domain = o.time_domain_id if o else None
        if self.mode == "records":
            return e.kind, e.slot, e.generation, b.get("sequence"), None, None, None, None, None, None, domain, code, message, order
        return (e.kind, e.slot, e.generation, b.get("sequence"), b.get("record_count"), b.get("min_time_ns"), b.get("max_time_ns"), b.get("flags"), b.get("compression"), b.get("stored_size"), b.get("raw_size"), b.get("offset"),
                o.record_format_id if o else None, o.record_format_version if o else None, domain, e.data, code, message, order)


def _partition(st: State) -> tuple:
    p, o, f = st.partition, st.partition.options, st.footer
    count, (flags, lo, hi) = (f["block_count"], (f["flags"], f["min_time_ns"], f["max_time_ns"])) if f else (len(st.index), summary(st.index))
    return p.slot, p.generation, st.sealed, count, st.data_end - M.REGION, lo, hi, flags, o.compression, o.compression_version, o.record_format_id, o.record_format_version, o.time_domain_id, o.allowed_backward_skew_ns, o.allowed_forward_step_ns


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.request = Request(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.request.narrow(f)
            yield f  # blocks are skipped by it; rows still need it

    def partitions(self) -> list[Part]:
        return self.request.plan()

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.request.read(partition)


class StreamReader(DataSourceStreamReader):
    """Follows one volume. The offset is (generation, sequence); what was overwritten before it was read is a gap."""

    def __init__(self, options: dict[str, str]):
        self.request = Request(options)
        if self.request.mode not in ("blocks", "records"):
            raise invalid("a stream reads blocks or records")
        (self.path,) = volumes_of(self.request.path)

    def initialOffset(self) -> dict:
        return {"generation": 0, "sequence": -1}

    def latestOffset(self) -> dict:
        states = self.request.snapshot(self.path).states
        if not states:
            return self.initialOffset()
        last = states[-1]
        n = last.footer["block_count"] if last.sealed else len(last.index)
        return {"generation": last.partition.generation, "sequence": n - 1}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        snap = self.request.snapshot(self.path)
        states = {s.partition.generation: s for s in snap.states}
        out, first = [], max(1, start["generation"])
        for g in range(min(first, end["generation"]), end["generation"] + 1) if states else ():
            after = start["sequence"] if g == start["generation"] else -1
            upto = end["sequence"] if g == end["generation"] else M.U64
            if upto <= after:
                continue
            if g in states:
                out.append(Part(self.path, snap.volume, states[g], g, after, upto))
            elif start["generation"] or g >= min(states):  # gone since it was due
                out.append(Part(self.path, order=g, gone=((g - 1) % snap.volume.partition_count, g)))
        return out or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.request.read(partition)

    def commit(self, end: dict) -> None:
        pass


class Staged(WriterCommitMessage):
    """The runs that a task has staged, or the volume that it has written."""

    def __init__(self, number: int, files: list[str], volume: str | None = None):
        self.number, self.files, self.volume = number, files, volume


class _Sink:
    """Tasks stage their rows beside the volume, in sorted runs; the commit merges them by ordinal into one writer.

    A task may be repeated or run twice without a record being written twice. A volume has
    one writer, so all rows of a commit go through the driver, a batch at a time. With the
    option layout=folder the path is a folder, in which each task writes a volume of its own, as large as its rows
    need, and the commit only gives them their names; the folder is read as one table.
    """

    def __init__(self, options: dict[str, str]):
        get = {k.lower(): v for k, v in options.items()}.get
        (self.path,) = (get("path") or "").split(",")
        self.path = "/" + self.path.removeprefix("file:").lstrip("/") if self.path.startswith("file:") else self.path
        self.domain, self.every = int(get("time_domain", "1"), 0), int(get("checkpoint_every", "1000"))
        self.codecs = named(get("codecs"))
        if get("layout", "volume") not in ("volume", "folder"):
            raise invalid("layout is volume or folder")
        self.folder = get("layout") == "folder"
        self.geometry = [int(get(name, default), 0) for name, default in (("partition_size", "4194304"), ("index_size", "262144"), ("block", "32768"), ("quantum", "4096"))]
        known = {"none": (0, 1), "packbits": (1, 1), "lz4_block": (2, 1)}
        packing = get("compression", "none")
        key = known.get(packing) or tuple(int(x, 0) for x in packing.split(":"))
        self.options = M.Options(*key, *M.FRAMED_PROFILE, self.domain, int(get("allowed_backward_skew_ns", "-1")), int(get("allowed_forward_step_ns", "-1")))

    def stage(self, rows: Iterator) -> Staged:
        from pyspark import TaskContext

        files = []
        made = ((int(r["ordinal"]), int(r["index_time_ns"]), int(r["selector"]) & M.U64, int(r["flags"]), bytes(r["payload"] or b"")) for r in rows)
        while run := sorted(islice(made, RUN_ROWS)):
            if self.folder:
                os.makedirs(self.path, exist_ok=True)
            files.append(os.path.join(self.path, f".staged-{uuid.uuid4().hex}") if self.folder else f"{self.path}.staged-{uuid.uuid4().hex}")
            kinds = {"ordinal": pa.int64(), "t": pa.int64(), "s": pa.uint64(), "f": pa.int32(), "p": pa.binary()}
            table = pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), zip(*run, strict=True), strict=True)})
            with pa.OSFile(files[-1], "wb") as out, pa.ipc.new_file(out, table.schema) as w:
                w.write_table(table, max_chunksize=BATCH_ROWS)
        number = TaskContext.get().partitionId()
        return self._own(number, files) if self.folder and files else Staged(number, files)

    def _own(self, number: int, files: list[str]) -> Staged:
        """The runs of a task in a volume of its own, hidden until the commit."""
        size, index, block, quantum = self.geometry
        staged = Staged(number, files)
        # blocks that hold half of what they can, and one more partition than they need, so that none is overwritten
        rows = sum(os.path.getsize(f) for f in files)
        slots = max(2, 2 + 2 * rows // max(1, size - 2 * M.REGION - index - block))
        path = os.path.join(self.path, f".{uuid.uuid4().hex}")
        volume = FileStorage.create(path, M.PREFIX + slots * size)
        try:
            format_volume(volume, size, index, block, quantum)
            writer = Writer(volume, self.options, registry=self.codecs)
            self.append(writer, [staged])
            writer.close()
            if writer.partition.generation > slots:
                raise RingError("no_space", "a task's rows exceed its volume")
        except BaseException:
            volume.close()
            os.unlink(path)
            raise
        finally:
            self.drop([staged])
        return Staged(number, [], path)

    def _publish(self, messages: list[Staged], batch: str) -> None:
        """Names the tasks' volumes; one that has its name already is of a commit that is repeated."""
        for m in messages:
            if m and m.volume:
                name = os.path.join(self.path, f"{batch}-{m.number:06d}.ring")
                if os.path.exists(name):
                    os.unlink(m.volume)
                elif os.path.exists(m.volume):
                    os.rename(m.volume, name)

    def _writer(self) -> Writer:
        writer = Writer(FileStorage(self.path, writable=True), self.options, registry=self.codecs)
        if writer.partition.options != self.options:
            writer.rotate(self.options)
        return writer

    def append(self, writer: Writer, messages: list[Staged], skip: int = 0) -> int:
        """Merges the staged rows by ordinal, a batch of each run in memory at a time, and appends all but the first `skip`."""

        def rows(file: str):
            with pa.memory_map(file) as f:
                reader = pa.ipc.open_file(f)
                for i in range(reader.num_record_batches):
                    yield from zip(*(c.to_pylist() for c in reader.get_batch(i).columns), strict=True)

        merged = islice(heapq.merge(*(rows(x) for m in messages if m for x in m.files)), skip, None)
        n = 0
        while part := list(islice(merged, self.every - n % self.every if self.every > 0 else BATCH_ROWS)):
            _, t, s, f, p = zip(*part, strict=True)
            writer.append_frames(np.array(t, np.int64), np.array(s, np.uint64), np.array(f, np.int64).astype(np.uint16), np.array([len(x) for x in p], np.int64), b"".join(p))
            n += len(part)
            if self.every > 0 and n % self.every == 0:
                writer.checkpoint()
        return n

    def drop(self, messages: list[Staged]) -> None:
        for m in messages:
            for file in [*m.files, *([m.volume] if m.volume else [])] if m else ():
                if os.path.exists(file):
                    os.unlink(file)


class BatchWriter(DataSourceWriter, _Sink):
    """A write that fails while it commits leaves the rows that it had appended, in order; its error says so."""

    def __init__(self, options: dict[str, str]):
        _Sink.__init__(self, options)

    def write(self, iterator: Iterator) -> Staged:
        return self.stage(iterator)

    def commit(self, messages: list[Staged]) -> None:
        if self.folder:
            return self._publish(messages, uuid.uuid4().hex[:12])
        writer = self._writer()
        try:
            self.append(writer, messages)
            writer.close()
        except RingError as e:
            raise RingError(e.code, f"{writer.metrics.accepted_records} records went in before: {e.message}") from e
        finally:
            writer.storage.close()
            self.drop(messages)

    def abort(self, messages: list[Staged]) -> None:
        self.drop(messages)


class StreamWriter(DataSourceStreamWriter, _Sink):
    """Before a batch is appended, its number and where the volume ends are noted durably beside it.

    If the commit is repeated, whatever of the batch stands after that place is counted in
    the volume itself and left out, so each record is written once, wherever the first
    commit stopped. Should the ring have gone past the place meanwhile, that can't be told: an error.
    """

    def __init__(self, options: dict[str, str]):
        _Sink.__init__(self, options)

    def write(self, iterator: Iterator) -> Staged:
        return self.stage(iterator)

    def _noted(self) -> dict:
        try:
            with open(self.path + ".batches") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"batch": -1, "done": True}

    def _note(self, note: dict) -> None:
        file = self.path + ".batches"
        with open(file + ".new", "w") as f:
            json.dump(note, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(file + ".new", file)
        parent = os.open(os.path.dirname(os.path.abspath(file)), os.O_RDONLY)
        try:
            os.fsync(parent)
        finally:
            os.close(parent)

    def _end(self) -> dict:
        s = FileStorage(self.path)
        try:
            last = Snapshot(s, registry=self.codecs).states[-1]
        finally:
            s.close()
        return {"generation": last.partition.generation, "blocks": last.footer["block_count"] if last.sealed else len(last.index)}

    def _since(self, place: dict) -> int:
        """How many records stand after a place."""
        s = FileStorage(self.path)
        try:
            snap = Snapshot(s, registry=self.codecs)
            states = {st.partition.generation: st for st in snap.states}
            if place["generation"] not in states:
                raise RingError("overwritten", "the ring has gone past the beginning of the batch")
            n = 0
            for g, st in states.items():
                if g >= place["generation"]:
                    entries = snap.load_index(st) if st.sealed else st.index
                    n += sum(e["record_count"] for e in entries if g > place["generation"] or e["sequence"] >= place["blocks"])
            return n
        finally:
            s.close()

    def commit(self, messages: list[Staged], batchId: int) -> None:
        if self.folder:
            return self._publish(messages, f"batch-{batchId:09d}")
        note = self._noted()
        if batchId < note["batch"] or batchId == note["batch"] and note["done"]:
            self.drop(messages)
            return
        skip = 0
        if batchId == note["batch"]:
            skip = self._since(note)
        writer = self._writer()
        try:
            if batchId != note["batch"]:
                note = {"batch": batchId, "done": False} | self._end()
                self._note(note)
            self.append(writer, messages, skip)
            writer.close()
        finally:
            writer.storage.close()
        self._note(note | {"done": True})
        self.drop(messages)

    def abort(self, messages: list[Staged], batchId: int) -> None:
        self.drop(messages)


class RingVolume(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ringvol"

    def schema(self) -> str:
        return MODES[Request(dict(self.options)).mode]

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise invalid("a volume is appended to; format it to start anew")
        return BatchWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(dict(self.options))


def register(spark) -> None:
    """Registers the source, and turns on the push-down of filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RingVolume)

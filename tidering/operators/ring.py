"""Generations, slots, offsets and retention of blocks in a ring of partitions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import invalid
from ..functions import columns as C
from .ordering import running_sum

#: Bytes before the first slot, of a partition's header and footer regions, and of an index entry.
PREFIX, REGION, ENTRY = 8192, 4096, 48
#: Blocks in a stretch, within which rotations are followed by one task.
STRETCH = 1 << 16


@dataclass(frozen=True)
class Geometry:
    """Sizes of a ring: of a partition, its index, the largest raw block, the quantum, and the number of slots."""

    partition: int
    index: int
    block: int
    quantum: int
    slots: int

    @property
    def data(self) -> int:
        return self.partition - 2 * REGION - self.index

    def span(self, stored: int) -> int:
        return -(-(C.BLOCK_HEADER + stored) // self.quantum) * self.quantum

    def check(self) -> None:
        q = self.quantum
        if not (0 < q <= 4096 and q & (q - 1) == 0):
            raise invalid("the quantum must be a power of two up to 4096")
        if self.partition % q or self.index % q or self.index < ENTRY or self.block <= 0 or self.slots < 2:
            raise invalid("sizes must be multiples of the quantum, with an index entry, a block and two slots at least")
        if self.data < q or self.span(self.block) > self.data:
            raise invalid("a partition must hold a block")

    def blocks_of(self, span: int) -> int:
        """How many blocks of one span a partition takes: another goes in while the worst case fits and the index has an entry."""
        worst = self.span(self.block)
        return min(0 if self.data < worst else 1 + (self.data - worst) // span, self.index // ENTRY)

    @property
    def blocks_per_partition(self) -> int:
        """Of full blocks."""
        return self.blocks_of(self.span(self.block))


def numbered(blocks: DataFrame) -> DataFrame:
    """blocks with block, their number from 0 in append order, by segments' counts and the number within a segment."""
    per = blocks.groupBy("segment").agg((F.max("segment_block") + 1).alias("_n"))
    upto = running_sum(per, "_n", "_upto", order="segment").select(F.col("segment").alias("_s"), (F.col("_upto") - F.col("_n")).alias("_before"))
    return blocks.join(upto, F.col("segment") == F.col("_s")).withColumn("block", F.col("_before") + F.col("segment_block")).drop("_s", "_before")


def _nexts(before: np.ndarray, n: int, g: Geometry) -> np.ndarray:
    """Of a partition that starts at each of the first n blocks, where the next one starts.

    before: the spans before each block, and before the end of what is known. The next
    one starts at the first block whose worst case doesn't fit any more, or that has no index entry left.
    """
    at = np.arange(n)
    fits = np.searchsorted(before, before[:n] + (g.data - g.span(g.block)), side="right")
    return np.minimum(np.minimum(fits, at + g.index // ENTRY), len(before) - 1)


def _chains(g: Geometry):
    def run(group: pa.Table) -> pa.Table:
        """(stretch, entry, exit, starts, last, used) for each block of the stretch that a partition may start at first.

        exit: the first start after the stretch; starts: how many are within; last: the last of them, and the bytes used from it on.
        """
        group = group.sort_by("block")
        stretch, block, span = (group.column(c).to_numpy() for c in ("stretch", "block", "frame_span"))
        first = int(stretch[0]) * STRETCH
        n = int(np.count_nonzero(block < first + STRETCH))
        before = np.concatenate(([0], np.cumsum(span)))
        to = _nexts(before, n, g).tolist()
        leave, count, last = [0] * n, [0] * n, [0] * n
        for i in reversed(range(n)):
            j = to[i]
            leave[i], count[i], last[i] = (j, 1, i) if j >= n else (leave[j], count[j] + 1, last[j])
        entries = range(min(n, g.index // ENTRY + 1) if first else min(n, 1))
        cols = [[int(stretch[0])] * len(entries), [first + i for i in entries], [first + leave[i] for i in entries], [count[i] for i in entries], [first + last[i] for i in entries], [int(before[n] - before[last[i]]) for i in entries]]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("stretch", "entry", "exit", "starts", "last", "used"), cols, strict=True)})

    return run


def _stitched(table: pa.Table) -> pa.Table:
    """(stretch, entry, generation, start, used): where the first partition of each stretch starts, and the generation, start and bytes of the one before it."""
    rows = {(s, e): rest for s, e, *rest in zip(*(table.column(c).to_pylist() for c in ("stretch", "entry", "exit", "starts", "last", "used")), strict=True)}
    out, entry, generation, start, used = [], 0, 0, 0, 0
    for stretch in sorted({s for s, _ in rows}):
        out.append((stretch, entry, generation, start, used))
        if (stretch, entry) in rows:
            entry, starts, start, used = rows[stretch, entry]
            generation += starts
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("stretch", "entry", "generation", "start", "used"), zip(*out, strict=True), strict=True)})


def _placed(g: Geometry):
    def run(blocks: pa.Table, where: pa.Table) -> pa.Table:
        """(block, generation, sequence, physical_offset) of a stretch."""
        blocks = blocks.sort_by("block")
        block, span = (blocks.column(c).to_numpy() for c in ("block", "frame_span"))
        entry, generation, start, used = (where.column(c)[0].as_py() for c in ("entry", "generation", "start", "used"))
        before = np.concatenate(([0], np.cumsum(span)))
        n = len(block)
        to, i, starts = _nexts(before, n, g), entry - int(block[0]) if n else 0, []
        while i < n:
            starts.append(i)
            i = int(to[i]) if to[i] > i else n
        number = np.searchsorted(np.array(starts, np.int64), np.arange(n), side="right")  # 0: the partition from before
        at = np.array([start - int(block[0]) if n else 0, *starts], np.int64)
        base = np.array([-used, *before[starts]], np.int64)
        cols = (block, generation + number, np.arange(n) - at[number], REGION + before[:n] - base[number])
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("block", "generation", "sequence", "physical_offset"), cols, strict=True)})

    return run


def assigned(blocks: DataFrame, g: Geometry, start_slot: int = 0) -> DataFrame:
    """numbered blocks with generation (from 1), sequence, slot, frame_span and physical_offset.

    A partition rotates before a block whose worst case wouldn't fit, or for which its
    index has no entry. Where one ends depends on where it began, for blocks of any span;
    so each stretch of STRETCH blocks is followed from every block at which a partition
    can start first in it, one task stitches stretches together by a row for each of
    these (the index's entries, of STRETCH blocks), and each stretch then places its own blocks.
    """
    g.check()
    most = g.index // ENTRY
    if most >= STRETCH:
        raise invalid("more index entries than blocks in a stretch")
    stretch = F.floor(F.col("block") / STRETCH).cast("long")
    spans = blocks.select("block", C.frame_span(F.col("raw_size"), g.quantum).alias("frame_span"))
    ahead = (F.col("block") % STRETCH <= most) & (F.col("block") >= STRETCH)
    seen = spans.select("block", "frame_span", F.explode(F.when(ahead, F.array(stretch, stretch - 1)).otherwise(F.array(stretch))).alias("stretch"))
    chains = seen.groupBy("stretch").applyInArrow(_chains(g), "stretch long, entry long, exit long, starts long, last long, used long")
    where = chains.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_stitched, "stretch long, entry long, generation long, start long, used long")
    placed = spans.withColumn("stretch", stretch).groupBy("stretch").cogroup(where.groupBy("stretch")).applyInArrow(_placed(g), "block long, generation long, sequence long, physical_offset long")
    out = blocks.join(placed, "block").withColumn("slot", slot_of(F.col("generation"), g.slots, start_slot))
    return out.withColumn("frame_span", C.frame_span(F.col("raw_size"), g.quantum))


def slot_of(generation: Column, slots: int, start_slot: int = 0) -> Column:
    return F.pmod(start_slot + generation - 1, F.lit(slots)).cast("long")


def retained(blocks: DataFrame, slots: int) -> DataFrame:
    """Blocks of the last `slots` generations."""
    newest = blocks.agg(F.max("generation").alias("_newest"))
    return blocks.join(F.broadcast(newest)).where(F.col("generation") > F.col("_newest") - slots).drop("_newest")


def inspect(blocks: DataFrame) -> DataFrame:
    """One row a generation: blocks, records, envelope, flags, bytes of spans."""
    return blocks.groupBy("generation", "slot").agg(
        F.count(F.lit(1)).alias("block_count"), F.sum("record_count").alias("record_count"), F.min("min_time_ns").alias("min_time_ns"), F.max("max_time_ns").alias("max_time_ns"),
        F.bit_or("flags").alias("flags"), F.sum("frame_span").alias("data_bytes"),
    )


def active(partitions: DataFrame) -> DataFrame:
    """The partition of the newest generation."""
    row = F.max_by(F.struct(*partitions.columns), "generation").alias("p")
    return partitions.agg(row).where("p is not null").select("p.*")

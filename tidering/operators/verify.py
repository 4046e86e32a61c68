"""Integrity over tables of blocks, index entries and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What an index entry must share with its block.
AGREEING = ("record_count", "min_time_ns", "max_time_ns", "flags", "raw_size")


def valid_prefix(blocks: DataFrame, valid: str = "valid") -> DataFrame:
    """Of each generation, the blocks before the first one that isn't valid."""
    first = F.min(F.when(~F.col(valid), F.col("sequence"))).over(Window.partitionBy("generation"))
    return blocks.withColumn("_bad", first).where(F.col("_bad").isNull() | (F.col("sequence") < F.col("_bad"))).drop("_bad")


def mismatches(index: DataFrame, scanned: DataFrame) -> DataFrame:
    """(generation, sequence, problem) where index and scan disagree: a missing side or a differing attribute."""
    a = index.select("generation", "sequence", F.struct(*AGREEING).alias("i"))
    b = scanned.select("generation", "sequence", F.struct(*AGREEING).alias("s"))
    both = a.join(b, ["generation", "sequence"], "full_outer")
    problem = F.when(F.col("i").isNull(), "not_indexed").when(F.col("s").isNull(), "not_found").when(~F.col("i").eqNullSafe(F.col("s")), "differs")
    return both.select("generation", "sequence", problem.alias("problem")).where("problem is not null")


def looked_up(index: DataFrame, headers: DataFrame) -> DataFrame:
    """(generation, sequence, agrees) of each index entry whose block is there: whether it tells what the block's header does."""
    told = (*AGREEING, "frame_span", "physical_offset")
    a = index.select("generation", "sequence", F.struct(*told).alias("i"))
    b = headers.select("generation", "sequence", F.struct(*told).alias("s"))
    return a.join(b, ["generation", "sequence"]).select("generation", "sequence", F.col("i").eqNullSafe(F.col("s")).alias("agrees"))


def against_current(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """(slot, generation, kind): partitions of a snapshot as the headers stand now: data, overwritten by another generation, or corrupt without a header."""
    now = current.select("slot", F.col("generation").alias("_now"))
    kind = F.when(F.col("_now").isNull(), "corrupt_gap").when(F.col("_now") != F.col("generation"), "overwritten_gap").otherwise("data")
    return snapshot.select("slot", "generation").join(now, "slot", "left").select("slot", "generation", kind.alias("kind"))


def broken_chains(blocks: DataFrame) -> DataFrame:
    """Blocks (generation, sequence, writer, previous_writer) that don't name the writer of the block before them, 0 for the first."""
    w = Window.partitionBy("generation").orderBy("sequence")
    out = blocks.withColumns({"_writer": F.coalesce(F.lag("writer").over(w), F.lit(0)), "_seq": F.row_number().over(w) - 1})
    return out.where((F.col("previous_writer") != F.col("_writer")) | (F.col("sequence") != F.col("_seq"))).drop("_writer", "_seq")


def duplicates(partitions: DataFrame) -> DataFrame:
    """Generations that several partitions claim, or that are 0."""
    return partitions.groupBy("generation").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or generation = 0")


def totals(events: DataFrame) -> DataFrame:
    """blocks, records, raw_bytes and gaps of a stream of block events."""
    data = F.col("kind") == "data"
    return events.agg(F.count_if(data).alias("blocks"), F.coalesce(F.sum(F.when(data, F.col("record_count"))), F.lit(0)).alias("records"), F.coalesce(F.sum(F.when(data, F.col("raw_size"))), F.lit(0)).alias("raw_bytes"), F.count_if(~data).alias("gaps"))


def short_blocks(blocks: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks whose records are not as many as their header says; check before filtering records."""
    n = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return blocks.join(n, keys, "left").where(F.coalesce("_n", F.lit(0)) != F.col("record_count")).drop("_n")

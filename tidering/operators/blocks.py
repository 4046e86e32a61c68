"""Packing records into blocks, and the blocks' envelopes.

A block closes when the next record would overflow it, so where one starts depends on
where all before it did. Forced closes, at checkpoints, cut the stream into segments
that pack independently; a segment is one group of a bounded number of records, and
only block starts are walked within it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RingError
from ..functions import columns as C
from .records import encoded_size


def starts(sizes: np.ndarray, most: int) -> np.ndarray:
    """Of each record the number of its block, packing greedily up to `most` bytes a block."""
    upto = np.cumsum(sizes)
    block = np.empty(len(sizes), np.int64)
    at = n = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        block[at:end] = n
        at, n = end, n + 1
    return block


def _starts(most: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("ordinal")
        block = starts(group.column("size").to_numpy(), most)
        first = group.column("ordinal").to_numpy()[np.flatnonzero(np.diff(block, prepend=-1))]
        return pa.table({"_segment": group.column("segment")[:1], "_starts": pa.array([first.tolist()], pa.list_(pa.int64()))})

    return run


def pack(records: DataFrame, max_block: int, checkpoint_every: int) -> DataFrame:
    """records (with size) and segment, segment_block: the block of each within its checkpoint segment.

    checkpoint_every: ordinals between two checkpoints, each of which closes the block.
    A record larger than a block is an error, as on append. Only sizes go through the
    packing; the records meet one row a segment, the first ordinals of its blocks.
    """
    if max_block <= 0 or checkpoint_every <= 0:
        raise RingError("invalid_argument", "block and checkpoint sizes must be positive")
    sized = records.withColumn("size", encoded_size()).withColumn("segment", F.floor(F.col("ordinal") / checkpoint_every).cast("long"))
    fits = F.when(F.col("size") <= max_block, F.col("size")).otherwise(F.raise_error(F.lit("out_of_range: record larger than a block")).cast("long"))
    sized = sized.withColumn("size", fits)
    where = sized.select("segment", "ordinal", "size").groupBy("segment").applyInArrow(_starts(max_block), "_segment long, _starts array<long>")
    block = (F.size(F.filter("_starts", lambda x: x <= F.col("ordinal"))) - 1).cast("long")
    return sized.join(where, F.col("segment") == F.col("_segment")).withColumn("segment_block", block).drop("_segment", "_starts")


def summaries(packed: DataFrame) -> DataFrame:
    """One row a block: its records' count, first ordinal, envelope, flags and bytes. Needs anomaly only if present."""
    flags = C.block_flags("flags")
    if "anomaly" in packed.columns:
        flags = flags.bitwiseOR(F.when(F.col("anomaly"), C.ANOMALY).otherwise(0).cast("long"))
    return packed.groupBy("segment", "segment_block").agg(
        F.count(F.lit(1)).alias("record_count"), F.min("ordinal").alias("first_ordinal"), F.min("index_time_ns").alias("min_time_ns"), F.max("index_time_ns").alias("max_time_ns"),
        F.bit_or(flags).alias("flags"), F.sum("size").alias("raw_size"),
    )


def candidates(blocks: DataFrame, begin: int, end: int) -> DataFrame:
    """Blocks whose envelope meets [begin, end)."""
    return blocks.where(C.meets_range(begin, end))


def query_by_blocks(packed: DataFrame, begin: int, end: int) -> DataFrame:
    """Exact records of [begin, end), read from candidate blocks only; the exact filter stays."""
    some = candidates(summaries(packed), begin, end).select("segment", "segment_block")
    return packed.join(some, ["segment", "segment_block"], "left_semi").where(C.in_range("index_time_ns", begin, end))


def value_index(packed: DataFrame) -> DataFrame:
    """(segment, segment_block, selector): each selector that a block holds, once. A block has a bounded number of records."""
    return packed.select("segment", "segment_block", "selector").distinct()


def query_by_values(packed: DataFrame, index: DataFrame, selectors: DataFrame) -> DataFrame:
    """Exact records of some selectors, read only from blocks that the value index names for them."""
    some = index.join(selectors.select("selector").distinct(), "selector", "left_semi").select("segment", "segment_block").distinct()
    return packed.join(some, ["segment", "segment_block"], "left_semi").join(selectors.select("selector").distinct(), "selector", "left_semi").select(*packed.columns)


def rejected(records: DataFrame, max_block: int) -> DataFrame:
    """Records that no block can hold."""
    return records.where(encoded_size() > max_block)

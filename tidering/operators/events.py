"""Data and gaps in one stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERWRITTEN, CORRUPT = "overwritten_gap", "corrupt_gap"


def stream(header_gaps: DataFrame, gaps: DataFrame, data: DataFrame) -> DataFrame:
    """Events with gap_rank: gaps of damaged headers come before everything; the others stand where they are met.

    Order by (gap_rank, generation, sequence).
    """
    parts = [df.withColumns({"kind": F.lit(kind), "gap_rank": F.lit(rank)}) for df, kind, rank in ((header_gaps, CORRUPT, 0), (gaps, OVERWRITTEN, 1), (data, "data", 1))]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return out.unionByName(parts[2], allowMissingColumns=True)


def keeping_gaps(condition: Column) -> Column:
    """A filter on data that lets gaps through: no range or selector hides a gap."""
    return (F.col("kind") != "data") | condition


def failing_on_gaps(events: DataFrame) -> DataFrame:
    """events, with an error at the first gap that is read."""
    kind = F.when(F.col("kind") == "data", F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("corrupt: "), F.col("kind"))))
    return events.withColumn("kind", kind)


def overrun(offset_generation: int, partitions: DataFrame) -> DataFrame:
    """One overwritten gap for each generation from the offset's on that is no longer there."""
    least = partitions.agg(F.min("generation").alias("least"))
    gone = F.sequence(F.lit(offset_generation).cast("long"), F.col("least").cast("long") - 1)
    return least.where(F.col("least") > offset_generation).select(F.lit(OVERWRITTEN).alias("kind"), F.explode(gone).alias("generation"))

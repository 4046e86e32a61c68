"""Order-dependent columns over append order without a single-task window.

Append order is cut into stretches of STRETCH ordinals. Each stretch has its own window;
what a stretch takes from those before it is one row a stretch. So the window over
stretches, the only one that isn't split, has 1/65,536 of the rows at dense ordinals,
which append order has; ordinals as sparse as timestamps must be made dense first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 1 << 16


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew if its input comes in fewer partitions than there are cores, for work that costs much more than moving its rows.

    One file of one row group is read by one task, however small; a large table comes in many and isn't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def _stretches(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("_stretch", F.floor(F.col(order) / STRETCH).cast("long"))


def _joined(df: DataFrame, edge: DataFrame, stream: list[str]) -> DataFrame:
    keys = [*stream, "_stretch"]
    on = [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in keys]
    renamed = edge.select(*(F.col(k).alias(f"_e_{k}") for k in keys), "_edge")
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(renamed, cond, "left").drop(*(f"_e_{k}" for k in keys))


def previous(df: DataFrame, cols: list[str], order: str = "ordinal", stream: list[str] | None = None) -> DataFrame:
    """df with prev_<col>: the values in the row before, in the order of its stream."""
    stream = stream or []
    rows = _stretches(df, order)
    value = F.struct(*cols)
    last = rows.groupBy(*stream, "_stretch").agg(F.max_by(value, order).alias("_last"))
    edge = last.withColumn("_edge", F.lag("_last").over(Window.partitionBy(*stream).orderBy("_stretch")))
    own = F.lag(value).over(Window.partitionBy(*stream, "_stretch").orderBy(order))
    out = _joined(rows.withColumn("_own", own), edge, stream).withColumn("_before", F.coalesce("_own", "_edge"))
    return out.select(*df.columns, *(F.col(f"_before.{c}").alias(f"prev_{c}") for c in cols))


def running_sum(df: DataFrame, value: str, out: str, order: str = "ordinal", stream: list[str] | None = None) -> DataFrame:
    """df with out: the sum of value up to and with each row, in the order of its stream."""
    stream = stream or []
    rows = _stretches(df, order)
    total = rows.groupBy(*stream, "_stretch").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*stream).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    edge = total.withColumn("_edge", F.sum("_total").over(before))
    own = F.sum(value).over(Window.partitionBy(*stream, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = _joined(rows.withColumn("_own", own), edge, stream)
    return joined.withColumn(out, F.col("_own") + F.coalesce("_edge", F.lit(0))).select(*df.columns, out)


def nearest(df: DataFrame, marks: DataFrame, value: str, stream: list[str], order: str = "ordinal") -> DataFrame:
    """df with before and after: the value of the last mark at or before each row, and of the first one after it, in its stream.

    An as-of join both ways. Rows meet the marks of their own stretch, and one row a
    stretch with the nearest marks of the others.
    """
    cols = df.columns
    rows = _stretches(df, order)
    kind = marks.schema[value].dataType
    r = rows.select(*stream, "_stretch", F.col(order).alias("_at"), F.lit(None).cast(kind).alias("_mark"), F.lit(1).alias("_kind"), F.struct(*(F.col(c) for c in cols)).alias("_row"))
    m = _stretches(marks, order).select(*stream, "_stretch", F.col(order).alias("_at"), F.col(value).alias("_mark"), F.lit(0).alias("_kind"))
    both = r.unionByName(m.withColumn("_row", F.lit(None).cast(r.schema["_row"].dataType)))
    keys = [*stream, "_stretch"]
    own = Window.partitionBy(*keys).orderBy("_at", "_kind")
    back = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_kind"))  # a frame that only grows, unlike one to the end
    both = both.withColumns({
        "_before": F.last("_mark", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)),
        "_after": F.last("_mark", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)),
    })
    held = both.groupBy(*keys).agg(F.max_by("_mark", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_last"), F.min_by("_mark", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_first"))
    along, against = Window.partitionBy(*stream).orderBy("_stretch"), Window.partitionBy(*stream).orderBy(F.desc("_stretch"))
    edge = held.withColumn("_edge", F.struct(
        F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.last("_first", ignorenulls=True).over(against.rowsBetween(Window.unboundedPreceding, -1)).alias("after"),
    ))
    out = _joined(both.where("_kind = 1"), edge, stream)
    return out.select("_row.*", F.coalesce("_before", "_edge.before").alias("before"), F.coalesce("_after", "_edge.after").alias("after"))

"""Reconstruction of times by anchors, within segments of a clock. Nothing here rewrites stored times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import nearest, previous, running_sum


def segments(records: DataFrame, stream: list[str], max_step_ns: int, sequence: str | None = None, boot: str | None = None, most_per_second: float | None = None) -> DataFrame:
    """records with clock_segment: a new one where the clock can't be carried on.

    That is where time goes back, or forward by more than max_step_ns; where the source's
    sequence number, if there is one, falls; where its boot id changes; and where it
    counts more than most_per_second numbers to the second.
    """
    told = ["index_time_ns", *(c for c in (sequence, boot) if c)]
    out = previous(records, told, stream=stream)
    step = F.col("index_time_ns") - F.col("prev_index_time_ns")
    new = (step < 0) | (step > max_step_ns)
    if sequence:
        run = F.col(sequence) - F.col(f"prev_{sequence}")
        new = new | (run < 0)
        if most_per_second is not None:
            new = new | (run.cast("double") * 1e9 > step.cast("double") * most_per_second)
    if boot:
        new = new | (F.col("prev_index_time_ns").isNotNull() & ~F.col(boot).eqNullSafe(F.col(f"prev_{boot}")))
    out = out.withColumn("_new", F.coalesce(new.cast("long"), F.lit(0)))
    return running_sum(out, "_new", "clock_segment", stream=stream).drop("_new", *(f"prev_{c}" for c in told))


def nearest_anchors(records: DataFrame, anchors: DataFrame, stream: list[str]) -> DataFrame:
    """records with the last anchor at or before each and the first after it, within its stream.

    anchors: (stream, ordinal, trusted_ns). before and after are (at, trusted_ns).
    """
    marks = anchors.select(*stream, "ordinal", F.struct(F.col("ordinal").alias("at"), F.col("trusted_ns")).alias("anchor"))
    return nearest(records, marks, "anchor", stream)


def interpolated(at: Column, before: Column, after: Column) -> Column:
    """The time between two anchors, in whole nanoseconds; the nearer one's if there is only one."""
    span, part = after["at"] - before["at"], at - before["at"]
    whole = ((after["trusted_ns"] - before["trusted_ns"]).cast("decimal(38,0)") * part / F.when(span > 0, span)).cast("decimal(38,6)")
    return F.coalesce(before["trusted_ns"] + F.floor(whole).cast("long"), before["trusted_ns"], after["trusted_ns"])


def clock_models(pairs: DataFrame, by: list[str], slowest: float = 0.0) -> DataFrame:
    """An affine model for each group of (local_ns, trusted_ns): trusted = origin_trusted_ns + rate * (local - origin_local_ns).

    Fitted around the group's first pair, so that doubles keep their digits; n counts the
    pairs. A group of one pair, or of one local time, has rate 1. No rate is under
    `slowest`, so that mapped times don't go back; residual_ns is the largest distance of a pair from the model,
    and from_local_ns to to_local_ns what the pairs span.
    """
    first = F.min(F.struct("local_ns", "trusted_ns"))
    origin = pairs.groupBy(*by).agg(first.alias("_o"))
    on = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    rel = pairs.join(origin.select(*(F.col(c).alias(f"_b_{c}") for c in by), "_o"), cond)
    x, y = (F.col("local_ns") - F.col("_o.local_ns")).cast("double"), (F.col("trusted_ns") - F.col("_o.trusted_ns")).cast("double")
    rel = rel.withColumns({"_x": x, "_y": y})
    out = rel.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.first("_o.local_ns").alias("origin_local_ns"), F.first("_o.trusted_ns").alias("origin_trusted_ns"), F.regr_slope("_y", "_x").alias("_rate"),
        F.min("local_ns").alias("from_local_ns"), F.max("local_ns").alias("to_local_ns"),
    )
    out = out.withColumn("rate", F.greatest(F.coalesce("_rate", F.lit(1.0)), F.lit(float(slowest)))).drop("_rate")
    rates = out.select(*(F.col(c).alias(f"_r_{c}") for c in by), F.col("rate").alias("_rate"))
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    off = rel.join(rates, cond).groupBy(*by).agg(F.max(F.abs(F.col("_y") - F.col("_rate") * F.col("_x"))).alias("residual_ns"))
    back = off.select(*(F.col(c).alias(f"_r_{c}") for c in by), "residual_ns")
    return out.join(back, cond).drop(*(f"_r_{c}" for c in by))


def uncertainty(at: Column, model: dict[str, Column], drift_ppm: float, sampling_ns: int) -> Column:
    """How far a mapped time may be off: the model's residual, the drift over the distance from what its pairs span, and the sampling error."""
    away = F.greatest(model["from_local_ns"] - at, at - model["to_local_ns"], F.lit(0))
    return model["residual_ns"] + away.cast("double") * (drift_ppm / 1e6) + F.lit(float(sampling_ns))


# The quality classes.
QUALITIES = ("observed_trusted", "anchored", "extrapolated", "arrival_bounded", "order_only", "unrecoverable")


def quality(trusted: Column, has_before: Column, has_after: Column, bounded: Column, arrived: Column) -> Column:
    """How far a reconstructed time can be relied on."""
    trusted_, anchored, extrapolated, arrival, order, none = QUALITIES
    out = F.when(trusted, trusted_).when(has_before & has_after, anchored).when((has_before | has_after) & bounded, extrapolated)
    return out.when(arrived, arrival).when(has_before | has_after, order).otherwise(none)

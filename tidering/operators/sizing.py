"""Sizing formulas and summaries of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .ring import ENTRY, REGION


def frames_per_partition(partition: Column, index: Column, span: Column, worst: Column) -> Column:
    """Blocks of `span` bytes that a partition takes while the worst case must fit."""
    data = partition - 2 * REGION - index
    fit = F.when(data < worst, 0).otherwise(1 + F.floor((data - worst) / span))
    return F.least(fit, F.floor(index / ENTRY)).cast("long")


def retention_seconds(slots: Column, frames: Column, records_per_frame: Column, rate: Column) -> tuple[Column, Column]:
    """The longest and the shortest time that records stay: with all slots full, and just after a rotation."""
    per = C.ratio(frames * records_per_frame, rate)
    return slots * per, (slots - 1) * per


def written_bytes(bytes_per_second: Column, years: int, amplification: float) -> Column:
    return (bytes_per_second * (years * 365 * 86400) * amplification).cast("double")


def required_tbw(bytes_per_second: Column, years: int, amplification: float, margin: float) -> Column:
    """Terabytes that a device must take in over its life, by the interface at which its endurance is told."""
    return written_bytes(bytes_per_second, years, amplification) * margin / 1e12


def ram_bounds(block: Column, index: Column, codec: str, entry: int = 64) -> tuple[Column, Column]:
    """The most memory of a writer and of one reading query, without the allocator's own.

    block: the largest raw block; index: bytes of the index region, whose entries are `entry` bytes when decoded.
    """
    packed = C.most_compressed(block, codec)
    entries = F.floor(index / ENTRY) * entry
    candidate = F.lit(0) if codec == "none" else packed
    frame = C.BLOCK_HEADER + F.greatest(block, packed)
    return (block + candidate + frame + entries).cast("long"), (2 * block + index + 2 * entries).cast("long")


#: Ranks, as a share of the rows, that the bracket round a percentile spans to each side, and what is asked of the sketch for it.
_BRACKET, _ACCURACY = 1e-3, 20_000


def percentiles(df: DataFrame, value: str, by: list[str], fractions: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles, the value of rank ceil(f * n), with count and maximum.

    Exact without sorting a group in one place: a quantile sketch brackets each rank, one
    pass counts what lies under the bracket, and only the values within it (two thousandths of a
    group) are ordered, by their counts. A rank outside its bracket, which the sketch's
    error rules out, would be an error.
    """
    names, f = list(fractions), list(fractions.values())
    rows = df.select(*by, F.col(value).alias("_v")).where("_v is not null")
    asked = [x for q in f for x in (max(0.0, q - _BRACKET), min(1.0, q + _BRACKET))]
    facts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("_v").alias("max_value"), F.percentile_approx("_v", asked, _ACCURACY).alias("_q"))
    keyed = facts.select(*(F.col(c).alias(f"_k_{c}") for c in by), "_q")
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    near = rows.join(keyed, cond)
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.col("_q")[2 * i].alias("lo"), F.col("_q")[2 * i + 1].alias("hi")) for i in range(len(f))))
    each = near.select(*by, "_v", F.explode(F.filter(places, lambda p: F.col("_v") <= p["hi"])).alias("p"))
    counted = each.groupBy(*by, F.col("p.i").alias("_i"), F.when(F.col("_v") >= F.col("p.lo"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumn("_upto", upto)
    n = facts.select(*(F.col(c).alias(f"_k_{c}") for c in by), F.col("n").alias("_all"))
    rank = F.ceil(F.element_at(F.array(*map(F.lit, f)), F.col("_i") + 1) * F.col("_all"))
    hit = counted.join(n, cond).where((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank))
    found = hit.groupBy(*by).agg(*(F.max(F.when(F.col("_i") == i, F.struct("_v"))).alias(f"_{i}") for i in range(len(f))))
    found = found.select(*(F.col(c).alias(f"_k_{c}") for c in by), *(f"_{i}" for i in range(len(f))))
    sure = lambda i: F.when(F.col(f"_{i}._v").isNotNull(), F.col(f"_{i}._v")).otherwise(F.raise_error(F.lit("a percentile outside its bracket")).cast(df.schema[value].dataType))
    out = facts.drop("_q").join(found, cond)
    return out.select(*by, "n", *(sure(i).alias(name) for i, name in enumerate(names)), "max_value")


def reservoir(df: DataFrame, number: str, k: int) -> DataFrame:
    """The k rows that deterministic reservoir sampling keeps of observations numbered from 1 by `number`.

    Observation i takes the place i - 1 while there are free ones, then place splitmix64(i)
    mod i, if that is one of the k; of those that took a place the last stays. So each place
    is a maximum, and no order has to be followed.
    """
    from ..functions.codecs import splitmix64_of

    i = F.col(number)
    draw = C.unsigned(splitmix64_of(i))
    place = F.when(i <= k, i - 1).otherwise((draw % i.cast(C.U64)).cast("long"))
    kept = df.withColumn("place", place).where(F.col("place") < k)
    return kept.groupBy("place").agg(F.max_by(F.struct(*df.columns), number).alias("_r")).select("place", "_r.*")


def summary(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """records, first and last ordinal, blocks, bytes and gaps of a stream.

    blocks: one row a block or gap, gaps by a column kind that isn't `data`, if there is one.
    """
    data = F.col("kind") == "data" if "kind" in blocks.columns else F.lit(True)
    r = records.agg(F.count(F.lit(1)).alias("records"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"))
    b = blocks.agg(F.count_if(data).alias("blocks"), F.sum(F.when(data, F.col("raw_size"))).alias("raw_bytes"), F.count_if(~data).alias("gaps"))
    return r.join(F.broadcast(b))


def missing_ordinals(records: DataFrame) -> DataFrame:
    """(ordinal, prev_ordinal) where the ordinals of a retained stream are not contiguous."""
    from .ordering import previous

    return previous(records, ["ordinal"]).where(F.col("prev_ordinal") + 1 != F.col("ordinal")).select("ordinal", "prev_ordinal")


def durable(records: DataFrame, checkpoint_every: int, accepted: int) -> DataFrame:
    """records with durable: whether a checkpoint came after them, when `accepted` were taken in."""
    last = accepted // checkpoint_every * checkpoint_every
    return records.withColumn("durable", F.col("ordinal") < last)


def digests(values: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, digest) of rows (by, order, values array<long>): FNV-1a-64 over the groups' numbers in order, eight bytes each, little-endian.

    An order-dependent fold, so a group is one task's: a partition of a ring is of bounded size.
    """
    from ..functions.codecs import fnv1a_of_longs

    rows = F.array_sort(F.collect_list(F.struct(*order, "values")))
    one = values.groupBy(*by).agg(rows.alias("_rows"))
    return one.select(*by, fnv1a_of_longs(F.flatten("_rows.values")).alias("digest"))

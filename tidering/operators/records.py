"""Exact record queries and clock anomalies over tables of records.

A record table has ordinal (append order), index_time_ns, selector, flags, payload and
time_domain_id. Results carry ordinal and are in append order only after in_order():
nothing here sorts by time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import invalid
from ..functions import columns as C
from .ordering import previous, running_sum

COLUMNS = ("ordinal", "index_time_ns", "selector", "flags", "payload", "time_domain_id")
#: Selector sets of more values are joined instead of listed in the plan.
LISTED_SELECTORS = 1000


def events(spark: SparkSession, sf_dir: str, within: tuple[int, int] | None = None) -> DataFrame:
    """The events as records; within: a range outside which nothing will be asked for, so that the scan may skip it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    if within:
        e = e.where(C.may_be_in("ts", *within))
    return e.select(F.col("event_id").alias("ordinal"), (C.micros("ts") * 1000).alias("index_time_ns"), F.col("user_id").alias("selector"), (F.col("event_type") == "error").cast("int").alias("flags"), F.col("props").cast("binary").alias("payload"), F.lit(1).cast("long").alias("time_domain_id"))


def orders(spark: SparkSession, sf_dir: str, domain: Column | None = None, within: tuple[int, int] | None = None) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    if within:
        o = o.where(C.may_be_in("o_orderdate", *within))
    return o.select(F.col("o_orderkey").alias("ordinal"), (C.micros("o_orderdate") * 1000).alias("index_time_ns"), F.col("o_custkey").alias("selector"), F.lit(0).alias("flags"), F.col("o_orderpriority").cast("binary").alias("payload"), (F.lit(1) if domain is None else domain).cast("long").alias("time_domain_id"))


def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").alias("ordinal"), (F.col("doc_id") * 1_000_000).alias("index_time_ns"), F.ascii(F.coalesce("lang", F.lit(""))).cast("long").alias("selector"), F.lit(0).alias("flags"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"), F.lit(1).cast("long").alias("time_domain_id"))


def encoded_size(payload: str = "payload") -> Column:
    return (F.octet_length(payload) + C.ENVELOPE).cast("long")


def query(records: DataFrame, begin: int, end: int, selectors: Iterable[int] | DataFrame = (), domain: int = 1) -> DataFrame:
    """Records of [begin, end) in one time domain with one of the selectors; without selectors, with any.

    selectors may be values or a table with a column `selector`. A long list becomes a
    semi-join, whose strategy is left to the planner: it broadcasts by size only.
    """
    C.check_domain(domain)
    out = records.where((F.col("time_domain_id") == domain) & C.in_range("index_time_ns", begin, end))
    if isinstance(selectors, DataFrame):
        return out.join(selectors.select("selector").distinct(), "selector", "left_semi").select(*records.columns)
    wanted = sorted(set(selectors))
    if len(wanted) > LISTED_SELECTORS:
        some = records.sparkSession.createDataFrame([(w,) for w in wanted], "selector long")
        return out.join(some, "selector", "left_semi").select(*records.columns)
    return out.where(C.one_of("selector", wanted))


def in_order(df: DataFrame) -> DataFrame:
    return df.orderBy("ordinal")


def first_of_each(records: DataFrame, by: list[str], order: str = "ordinal") -> DataFrame:
    """Of records that agree in `by`, as those of redundant recorders do, the first in append order. Nothing else drops duplicates."""
    row = F.min_by(F.struct(*records.columns), order).alias("_r")
    return records.groupBy(*by).agg(row).select("_r.*")


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_a, only_b, in_both): rows by their counts, so that two readers agree if the first two are 0."""
    cols = a.columns
    sides = a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    n = sides.groupBy(*cols).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return n.agg(total(F.greatest(F.col("_a") - F.col("_b"), F.lit(0)), "only_a"), total(F.greatest(F.col("_b") - F.col("_a"), F.lit(0)), "only_b"), total(F.least("_a", "_b"), "in_both"))


def with_profiles(parts: dict[tuple[int, int], DataFrame], wanted: tuple[int, int] | None = None) -> DataFrame:
    """Records of several profiles (id, version) in one table, or those of one; another profile is then an error."""
    if wanted is not None and (other := set(parts) - {wanted}):
        from ..errors import RingError

        raise RingError("unsupported", f"profiles {sorted(other)} among {wanted}")
    out = None
    for (i, v), df in parts.items():
        df = df.withColumns({"record_format_id": F.lit(i).cast("long"), "record_format_version": F.lit(v)})
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise invalid("no profiles")
    return out


def domain_runs(records: DataFrame, stream: list[str] | None = None) -> DataFrame:
    """records with domain_run: a number that grows whenever the time domain changes in append order."""
    out = previous(records, ["time_domain_id"], stream=stream)
    out = out.withColumn("_new", F.coalesce((F.col("prev_time_domain_id") != F.col("time_domain_id")).cast("long"), F.lit(0)))
    return running_sum(out, "_new", "domain_run", stream=stream).drop("_new", "prev_time_domain_id")


def anomalies(records: DataFrame, backward: int, forward: int, stream: list[str] | None = None) -> DataFrame:
    """records with prev_time_ns, backward_anomaly, forward_anomaly and anomaly.

    Each record is compared with the one before it in append order, unless the time
    domain has just changed. A step is an anomaly if its distance is strictly more than
    the threshold; a negative threshold allows any. Records are flagged, never dropped.
    """
    out = previous(records, ["index_time_ns", "time_domain_id"], stream=stream)
    same = F.col("prev_time_domain_id") == F.col("time_domain_id")
    out = out.withColumn("prev_time_ns", F.when(same, F.col("prev_index_time_ns"))).drop("prev_index_time_ns", "prev_time_domain_id")
    t, p = F.col("index_time_ns"), F.col("prev_time_ns")
    over = lambda most: (C.distance(t, p) > F.lit(str(most)).cast(C.U64)) if most >= 0 else F.lit(False)
    out = out.withColumn("backward_anomaly", F.coalesce((t < p) & over(backward), F.lit(False)))
    out = out.withColumn("forward_anomaly", F.coalesce((t > p) & over(forward), F.lit(False)))
    return out.withColumn("anomaly", F.col("backward_anomaly") | F.col("forward_anomaly"))

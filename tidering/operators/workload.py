"""Deterministic workloads: records by profile, the same for the same seed wherever they are made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import invalid
from ..functions import columns as C
from ..functions.codecs import splitmix64_of

# The profiles, the line that logs repeat, and the time at which a clock is set.
PROFILES = ("tiny", "sparse", "mixed", "burst", "compressible", "incompressible", "logs", "bad-time", "hot-rotation", "concurrent-read")
LINE = "service=control level=info repeated telemetry log line "
EPOCH = 1_780_000_000_000_000_000
STEP_NS, SELECTORS = 1_000_000, 64


def payload_size(profile: str, ordinal: Column, draw: Column) -> Column:
    """Bytes of a payload; draw: an unsigned random number of the record."""
    upto = lambda least, n: least + (draw % n).cast("long")
    if profile in ("tiny", "sparse"):
        return upto(8, 25)
    if profile in ("mixed", "hot-rotation", "concurrent-read"):
        return F.when(ordinal % 100 == 0, upto(50, 101)).otherwise(upto(10, 40))
    if profile == "burst":
        return upto(16, 112)
    if profile == "logs":
        return upto(50, 300)
    return F.lit(32 if profile == "bad-time" else 128).cast("long")


def index_time(profile: str, ordinal: Column, records: int) -> Column:
    """Even steps; or, for bad-time, a clock that is set after a tenth, read once as 0 in the middle, and often steps back."""
    even = ordinal * STEP_NS
    if profile != "bad-time":
        return even
    late = F.lit(EPOCH) + even - F.when(ordinal % 7 == 0, 3 * STEP_NS).otherwise(0)
    return F.when(ordinal < records // 10, even).when(ordinal == records // 2, F.lit(0).cast("long")).otherwise(late)


def records(spark: SparkSession, profile: str, n: int, seed: int = 1) -> DataFrame:
    """n records (ordinal, index_time_ns, selector, flags, payload, time_domain_id).

    A payload begins with its ordinal, eight bytes little-endian. The rest is random bytes, one byte that
    changes every hundred records (compressible), or a line over and over (logs). Random
    numbers are splitmix64 of the seed and the ordinal, in place of a twister.
    """
    if profile not in PROFILES:
        raise invalid(f"no profile {profile!r}")
    i = F.col("ordinal")
    draw = C.unsigned(splitmix64_of(i.bitwiseXOR(F.lit(seed))))
    rows = spark.range(n).select(F.col("id").alias("ordinal")).withColumn("_draw", draw)
    rows = rows.withColumn("_size", payload_size(profile, i, F.col("_draw")).cast("int"))
    own = F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(i, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(8)))
    if profile == "logs":
        rest = F.hex(F.repeat(F.lit(LINE), 8))
        body = F.concat(own, F.substring(rest, 17, 100_000))
    elif profile == "compressible":
        body = F.concat(own, F.repeat(F.lpad(F.hex(F.floor(i / 100).cast("long").bitwiseAND(F.lit(3))), 2, "0"), 160))
    else:
        body = F.concat(own, F.sha2(F.concat_ws(" ", F.lit(seed), i), 512), F.sha2(F.concat_ws(" ", F.lit(seed), i, F.lit("on")), 512), F.sha2(F.concat_ws(" ", F.lit(seed), i, F.lit("end")), 256))
    payload = F.unhex(F.substring(body, F.lit(1), 2 * F.col("_size")))
    return rows.select("ordinal", index_time(profile, i, n).alias("index_time_ns"), (i % SELECTORS).alias("selector"), F.lit(0).alias("flags"), payload.alias("payload"), F.lit(1).cast("long").alias("time_domain_id"))

"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Sources share a budget of words by weight, none more than a multiple of its size; what
a full source leaves is shared again by weight, which comes to one level: a source gets
its weight times the level, or its cap. Complete epochs are taken first. For the rest
of its target, each document gets an exponential key, -ln(u) over its quality weight,
with u from a hash of its id and text; documents are taken in the order of the keys while the
prefix sum of their sizes stays within the rest, the last one if more than half of it
fits. So the taken words of a source miss its target by half a document at most.

The order runs through range partitions over (source, key), and prefix sums add one
total a partition, so a source of any share of the rows is spread over many tasks.

Null texts have size 0. Rows without source form a source of their own, ordered last.
A source whose documents are all empty has target 0. Rows without id and rows that
repeat one are documents of their own, told apart by their texts; rows equal in id,
source and text tie and are interchangeable. Documents without a quality label, and those without id, weigh UNLABELLED.
Texts of any length are measured whole, an empty table gives an empty result, and other
columns of the table are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_order, running_sum

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: The words mixed, as a share of all words, and the most a source or document is repeated.
SHARE, REPEATS = 1.5, 2
#: Quality weights by label, and without one.
QUALITY, UNLABELLED = {1: 1.0, 0: 0.25}, 0.5
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exponential(id_: Column, text_hash: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, with u in (0, 1) from the row; ascending order samples by weight without replacement."""
    u = (F.pmod(F.xxhash64(F.lit(seed), id_, text_hash), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def targets(scratch: Scratch, sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size): with target and before, the sizes of the sources ordered before."""
    by_name = [F.col("source").asc_nulls_last()]
    t = in_order(scratch, sizes.withColumn("one", F.lit(1)), by_name, "sources")
    t = running_sum(running_sum(t, by_name, "one", "rank"), by_name, "source_size", "upto")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    t = scratch.table(t.select("source", "source_size", (F.col("upto") - F.col("source_size")).alias("before"), weight.cast("long").alias("weight"), (REPEATS * F.col("source_size")).alias("cap")), "weights")
    all_ = t.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if all_["weight"] is None:
        return t.select("source", "source_size", "before", F.lit(0.0).alias("target"))
    # sources fill up in the order of cap / weight; the level is that at the first which doesn't
    ratio = F.col("cap") / F.col("weight")
    order = [ratio.asc(), F.col("source").asc_nulls_last()]
    r = in_order(scratch, t, order, "ratios")
    r = running_sum(running_sum(r, order, "cap", "caps"), order, "weight", "weights")
    level = (SHARE * all_["size"] - (F.col("caps") - F.col("cap"))) / (all_["weight"] - (F.col("weights") - F.col("weight")))
    lowest = r.where(level <= ratio).agg(F.min(F.struct(ratio.alias("ratio"), level.alias("level"))).alias("first")).first()["first"]
    target = F.col("cap").cast("double") if lowest is None else F.least(F.col("cap").cast("double"), F.lit(lowest["level"]) * F.col("weight"))
    return t.select("source", "source_size", "before", target.alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source, text_hash) for each row of docs.

    text_hash is xxhash64 of the text: (doc_id, source, text_hash) leads back to the row. quality: (doc_id, quality) labels 0 and 1; the greater counts if there are several.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("h"))
    weight = F.lit(UNLABELLED)
    if quality is not None:
        known = quality.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
        rows = rows.join(known, "doc_id", "left")
        for k, v in QUALITY.items():
            weight = F.when(F.col("_quality") == k, v).otherwise(weight)
    rows = rows.select("doc_id", "source", "size", "h", exponential(F.col("doc_id"), F.col("h"), weight, seed).alias("key"))
    order = [F.col("source").asc_nulls_last(), F.col("key").asc(), F.col("doc_id").asc_nulls_last(), F.col("h").asc(), F.col("size").asc()]
    rows = in_order(scratch, rows, order, "keys")
    sizes = scratch.table(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    wanted = scratch.table(targets(scratch, sizes).withColumnRenamed("source", "s"), "targets")
    rows = scratch.table(running_sum(rows, order, "size", "upto").select("doc_id", "source", "size", "h", "upto"), "upto")

    scratch.keep(rows, wanted)
    out = rows.join(wanted, F.col("source").eqNullSafe(F.col("s")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    drawn = (F.col("upto") - F.col("before") - F.col("size") / 2 <= rest) & (rest > 0)
    return out.withColumn("epochs", epochs).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + drawn.cast("long"))).cast("long").alias("taken"), (F.col("epochs") + drawn.cast("long")).cast("int").alias("copies"), "source", F.col("h").alias("text_hash"))

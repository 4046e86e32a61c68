"""What the training-data operators share: scratch tables and distributed ordering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folds of the labelled rows: remainder 0 is held out, the others may be learnt from.
FOLDS = 5

#: Rows of an Arrow batch at most: a batch is held by the JVM and by the worker, both ways, and texts are long.
BATCH_ROWS = 1000

_own_dir: str | None = None


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS, where they are more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, a temporary one on a local master only."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="tidering-")
    return _own_dir


class Scratch:
    """Tables written to the shared folder to cut lineage, dropped when the application ends or by drop().

    A written table survives lost executors, and is read with the schema that was
    written, so that no job runs to infer it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bounded_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.written: set[str] = set()
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.deleteOnExit(path)

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(_nullable(df.schema)).parquet(path)
        out._scratch_path = path
        self.written.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        self._delete({t._scratch_path for t in tables})

    def keep(self, *tables: DataFrame) -> None:
        """Drops all but the given ones, which are all that a result still reads."""
        self._delete(self.written - {t._scratch_path for t in tables})

    def _delete(self, paths: set[str]) -> None:
        for path in sorted(paths):
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        self.written -= paths


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id belongs to no fold that is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def disjoint(keep: list[str], made: list[str]) -> None:
    """An error if a kept column has the name of one that the operator makes."""
    if both := sorted({k.lower() for k in keep} & {m.lower() for m in made}):
        raise ValueError(f"kept columns clash with the result's: {', '.join(both)}")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_order(scratch: Scratch, df: DataFrame, order: list[Column], name: str = "order") -> DataFrame:
    """df range-partitioned by `order`, with _part (the partition, in order), written so that both stay fixed.

    The sort order of `order` must be total up to rows that are interchangeable.
    No partition depends on the size of one key when `order` ends in an id.
    """
    out = df.repartitionByRange(partitions(scratch.spark), *order).withColumn("_part", F.spark_partition_id())
    return scratch.table(out, name)


def running_sum(ordered: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Inclusive prefix sum of `value` along `order` over a table of in_order().

    Each partition is summed on its own; what came before it is added from one row a
    partition, so the broadcast side has as many rows as there are partitions.
    """
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ordered.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = totals.select(
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    return (
        ordered.withColumn("_in", F.sum(value).over(w))
        .join(F.broadcast(before), F.col("_part") == F.col("_p"), "left")
        .withColumn(out, F.col("_in") + F.col("_before"))
        .drop("_p", "_in", "_before")
    )

"""Exact top-k search by inner product over a vector-approximation file.

Vectors become integers, floor(64 * x), padded with zeros to the longest. The
approximation file is written once: of every vector one byte a component, the number of
its cell among CELLS of equal width between the component's least and greatest value.
Exact vectors stay in a table of their own, by row.

Scan: queries meet the approximations, never the exact vectors, in a grid of blocks of
bounded size, so that no task holds all of either and a common vector doesn't matter.
The lower edges of the cells and their widths bound every inner product from both
sides; a task keeps what reaches its k-th best lower bound, and over all tasks what
reaches the k-th best lower bound of the query stays. Read: the exact vectors of the k
best upper bounds are fetched by row; then of those others, in the order of upper bounds,
that reach the k-th exact score, after which no vector left can change the result.

Rows are candidates: rows that repeat a vec_id are candidates each, and, if the id is a
query's, queries each; a query is no candidate of its own, other rows of its id are.
Vectors that are null, empty or hold null or non-finite components take no part, nor do
rows without id. Ties go to the smaller id. Scores must fit in 62 bits: beyond, an error
is raised rather than a wrong order given. An empty table, and one without a query, give an empty
result; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Cells of a component: as many as a byte has.
SCALE, CELLS = 64.0, 256
#: Rows of a packed block, candidates and queries of one cell of the grid (on average), and queries whose bounds are held at once.
BLOCK, CANDIDATES, QUERIES, AT_ONCE = 1024, 16384, 2048, 64


def integers(v: pa.ListScalar, dims: int) -> np.ndarray:
    """floor(64 * x) of a vector, as doubles, padded."""
    x = np.zeros(dims)
    v = v.values.to_numpy(zero_copy_only=False)
    x[: len(v)] = np.floor(SCALE * v.astype(np.float64))
    return x


class Grid:
    """Cells of equal width over each component's range."""

    def __init__(self, lo: list[float], hi: list[float]):
        self.lo = np.array(lo)
        self.width = np.maximum(np.ceil((np.array(hi) - self.lo + 1) / CELLS), 1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.lo) // self.width).astype(np.uint8)

    def edges(self, cells: np.ndarray) -> np.ndarray:
        """The least integer of each cell; the greatest is width - 1 more."""
        return self.lo + cells * self.width


def _ranges(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(dim, lo, hi) of the vectors' integers."""
        lo, hi = np.full(dims, np.inf), np.full(dims, -np.inf)
        for batch in batches:
            for v in batch.column(0):
                x = integers(v, dims)
                lo, hi = np.minimum(lo, x), np.maximum(hi, x)
        if np.isfinite(lo).all():
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(lo), pa.array(hi)], names=["dim", "lo", "hi"])

    return run


def _packed(dims: int, grid: Grid | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, rows, data) of (row, values) in blocks of BLOCK: the cells as bytes, or without a grid the integers."""
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                x = np.stack([integers(v, dims) for v in b.column(1)])
                data = x.tobytes() if grid is None else grid.cells(x).tobytes()
                rows = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([(task << 24) + n], pa.int64()), pa.array([rows.tobytes()], pa.binary()), pa.array([data], pa.binary())], names=["block", "rows", "data"])
                n += 1

    return run


def bounds(q: np.ndarray, edges: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of queries (rows of q) and cells: the products with the lower edges, and what to add to them for lower and upper bounds."""
    return q @ edges.T, np.minimum(q, 0) @ slack, np.maximum(q, 0) @ slack


def _scanned(dims: int, grid: Grid, k: int, exact: str):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        """(query, row, lower, upper) of the candidates that reach the k-th best lower bound of this cell."""
        load = lambda t, dtype: (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in t.column("rows")]), np.concatenate([np.frombuffer(x.as_buffer(), dtype).reshape(-1, dims) for x in t.column("data")]))
        out: list[tuple] = []
        if queries.num_rows and candidates.num_rows:
            (qid, q), (rows, cells) = load(queries, np.float64), load(candidates, np.uint8)
            edges, slack, q = grid.edges(cells).astype(exact), (grid.width - 1).astype(exact), q.astype(exact)
            for at in range(0, len(qid), AT_ONCE):
                base, less, more = bounds(q[at : at + AT_ONCE], edges, slack)
                for i, own in enumerate(qid[at : at + AT_ONCE]):
                    others = np.flatnonzero(rows != own)
                    lower = base[i, others] + less[i]
                    least = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else -np.inf
                    some = base[i, others] + more[i] >= least
                    out.append((np.full(int(some.sum()), own), rows[others[some]], lower[some].astype(np.int64), (base[i, others[some]] + more[i]).astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query", "row", "lower", "upper"), cols, strict=True)})

    return run


def _scores(dims: int, exact: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query, row, vec_id, score) of (query, row, vec_id, v, w): exact inner products."""
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x, y = (np.stack([integers(v, dims) for v in b.column(c)]).astype(exact) for c in ("v", "w"))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array((x * y).sum(1).astype(np.int64), pa.int64())], names=["query", "row", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, rank from 1.

    is_query: a condition on the column `id`.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vafile")
    v = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # written, so that the numbers of rows are fixed
    rows = scratch.table(vectors.where(sound).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), v.alias("v")), "rows")
    asking = rows.where(is_query)
    total, asked, dims = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.max(F.size("v"))).first()
    if not asked:
        return spark.range(0).selectExpr("id as query_id", "cast(id as int) as rank", "id as vec_id", "id as score")
    found = rows.select("v").mapInArrow(_ranges(dims), "dim int, lo double, hi double").groupBy("dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("dim").collect()
    lo, hi = [r["lo"] for r in found], [r["hi"] for r in found]
    # what a sum of products can reach decides in which type it is exact; the cells' edges go up to a width beyond
    most = sum((max(abs(a), abs(b)) + 2 * (b - a) / CELLS + 2) ** 2 for a, b in zip(lo, hi, strict=True))
    if most >= 2**62:
        raise ArithmeticError(f"inner products of up to {most:.3g} don't fit in 62 bits")
    exact = "float32" if most < 2**23 else "float64" if most < 2**52 else "int64"
    grid = Grid(lo, hi)

    ddl = "block long, rows binary, data binary"
    cells = scratch.table(rows.select("row", "v").mapInArrow(_packed(dims, grid), ddl), "approximations")
    queries = scratch.table(asking.select("row", "v").mapInArrow(_packed(dims, None), ddl), "queries")
    wide, high = -(-total // CANDIDATES), -(-asked // QUERIES)
    cell = lambda n, at: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int").alias(at)
    q = queries.select("rows", "data", cell(high, "y"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("x"))
    c = cells.select("rows", "data", cell(wide, "x"), F.explode(F.sequence(F.lit(0), F.lit(high - 1))).alias("y"))
    near = q.groupBy("x", "y").cogroup(c.groupBy("x", "y")).applyInArrow(_scanned(dims, grid, k, exact), "query long, row long, lower long, upper long")
    near = scratch.table(near, "scanned")

    def kth(df: DataFrame, value: str, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(value)))
        return df.select("query", value).withColumn("_place", place).where(F.col("_place") == k).select("query", F.col(value).alias(name))

    near = near.join(kth(near, "lower", "least"), "query", "left").where("least is null or upper >= least")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("upper"), "row"))
    near = scratch.table(near.select("query", "row", "upper", place.alias("place")), "near")

    def read(some: DataFrame, name: str) -> DataFrame:
        """Exact scores of (query, row), their vectors fetched by row."""
        one, other = rows.select(F.col("row").alias("query"), "v"), rows.select("row", F.col("id").alias("vec_id"), F.col("v").alias("w"))
        both = some.select("query", "row").join(other, "row").join(one, "query").select("query", "row", "vec_id", "v", "w")
        return scratch.table(both.mapInArrow(_scores(dims, exact), "query long, row long, vec_id long, score long"), name)

    first = read(near.where(F.col("place") <= k), "first")
    rest = near.where(F.col("place") > k).join(kth(first, "score", "least"), "query").where("upper >= least")
    more = read(rest, "rest")
    scratch.keep(rows, first, more)
    scores = first.union(more)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    best = scores.withColumn("rank", rank).where(F.col("rank") <= k)
    out = best.join(asking.select(F.col("row").alias("query"), F.col("id").alias("query_id")), "query")
    return out.select("query_id", "rank", "vec_id", "score")

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidering.llm import vafile

DDL = "vec_id long, embedding array<float>"


def brute(rows, k, asks):
    """Sorted (query_id, rank, vec_id, score): rows that repeat an id are candidates, and queries, each."""
    sound = [(i, v) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    x = [(i, [int(np.floor(64.0 * float(np.float32(c)))) for c in v]) for i, v in sound]
    out = []
    for n, (q, v) in enumerate(x):
        if asks(q):
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for m, (i, w) in enumerate(x) if m != n)[:k]
            out += [(q, rank + 1, i, -a) for rank, (a, i) in enumerate(s)]
    return sorted(out)


def found(df, k=20):
    asks = F.col("id") % 20 == 0
    return sorted(tuple(r) for r in vafile.top_k(df, asks, k).collect())


def test_table_equals_brute_force(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], list(r["embedding"])) for r in e.collect()]
    assert found(e) == brute(rows, 20, lambda i: i % 20 == 0)


def test_ties_repeats_and_unsound_vectors(spark, monkeypatch):
    for name, n in (("BLOCK", 8), ("CANDIDATES", 30), ("QUERIES", 3)):
        monkeypatch.setattr(vafile, name, n)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(120)]
    rows += [(i, [0.5] * 6) for i in range(200, 320)] + [(7, [1.0] * 6), (40, [1.0] * 6), (40, [1.0] * 6), (None, [1.0] * 6), (400, None), (420, []), (440, [float("nan")] * 6), (460, [float("inf")] * 6), (480, [None, 1.0]), (500, [2.0, -1.0])]
    assert found(spark.createDataFrame(rows, DDL), k=9) == brute(rows, 9, lambda i: i % 20 == 0)


def test_few_rows_and_none(spark):
    assert found(spark.createDataFrame([(0, [1.0]), (1, [2.0])], DDL)) == [(0, 1, 1, 64 * 128)]
    assert found(spark.createDataFrame([(0, [1.0])], DDL)) == []
    assert vafile.top_k(spark.createDataFrame([], DDL), F.col("id") % 20 == 0).columns == ["query_id", "rank", "vec_id", "score"]


def test_large_values(spark):
    rows = [(i, [float(v), 3.0e4]) for i, v in enumerate((1e6, -2e6, 3e6, 5.0))]
    assert found(spark.createDataFrame(rows, DDL), k=3) == brute(rows, 3, lambda i: i % 20 == 0)
    with pytest.raises(ArithmeticError):
        found(spark.createDataFrame([(0, [1e30]), (1, [1.0])], DDL))


def test_other_columns_may_have_any_name(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, DDL)
    odd = df.withColumns({c: F.lit("x") for c in ("id", "row", "v", "query", "score", "rank", "query_id")})
    assert found(odd) == found(df)


def test_wide_ranges_make_coarse_cells(spark):
    """Where a cell is wide, the bounds are loose and exact vectors decide."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=5) * 4000]) for i in range(300)]
    df = spark.createDataFrame(rows, DDL)
    want = brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 20, lambda i: i % 20 == 0)
    assert found(df) == want
    grid = vafile.Grid([0.0, -500.0], [10.0, 100_000.0])
    x = np.array([[0.0, -500.0], [10.0, 100_000.0], [3.0, 7.0]])
    low = grid.edges(grid.cells(x))
    assert grid.cells(x).dtype == np.uint8 and (low <= x).all() and (x <= low + grid.width - 1).all()

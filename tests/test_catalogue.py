"""Every registered query against its SQL, and the properties behind them."""

from __future__ import annotations

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidering.errors import RingError
from tidering.functions import columns as C
from tidering.operators import blocks, records, ring
from tidering.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _norm(rows) -> list:
    return sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(f"select {', '.join(cols)} from ({catalogue.oracle_sql()[name]})").fetchall()
    assert _norm(df.select(cols).collect()) == _norm(want)


@given(st.lists(st.integers(1, 50), min_size=1, max_size=80), st.integers(50, 120))
@settings(max_examples=200, deadline=None)
def test_packing_is_greedy(sizes, most):
    got, want, n, held = blocks.starts(np.array(sizes), most).tolist(), [], -1, most + 1
    for s in sizes:
        if held + s > most:
            n, held = n + 1, 0
        held += s
        want.append(n)
    assert got == want


@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40), st.integers(-60, 60), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_envelopes_lose_no_record(times, begin, width):
    end = begin + width
    if any(begin <= t < end for t in times):
        assert min(times) < end and max(times) >= begin


def test_geometry():
    assert ring.Geometry(16384, 1024, 900, 1024, 2).blocks_of(1024) == 6
    assert ring.Geometry(65536, 4096, 256, 4096, 2).blocks_per_partition == 13
    for bad in (ring.Geometry(65536, 4096, 256, 3, 2), ring.Geometry(65536, 4096, 10**6, 512, 2), ring.Geometry(65536, 4096, 256, 512, 1)):
        with pytest.raises(RingError):
            bad.check()


def test_arguments(spark):
    for f in (lambda: C.check_range(5, 5), lambda: C.check_domain(0), lambda: C.align_up(F.lit(1), 0)):
        with pytest.raises(RingError, match="invalid_argument"):
            f()
    e = records.events(spark, SF)
    assert records.query(e, 0, 2**62, ()).count() == e.count()
    assert records.query(e, 0, 2**62, range(2000)).count() == e.where("selector < 2000").count()


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    q = records.query(records.orders(spark, SF), 0, 2**62, (3, 5))
    ranged = catalogue.queries()["record_query"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in ranged and "LessThanOrEqual(ts," in ranged and "In(user_id" in ranged
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(o_custkey" in plan.replace("IsNotNull(o_custkey), ", "") or "In(o_custkey, [3,5])" in plan


def test_oversized_records_are_an_error(spark):
    t = spark.createDataFrame([(0, 0, 0, 0, b"x" * 100, 1)], "ordinal long, index_time_ns long, selector long, flags int, payload binary, time_domain_id long")
    with pytest.raises(Exception, match="out_of_range"):
        blocks.pack(t, 64, 10).collect()


def test_stretches_do_not_show(spark, monkeypatch):
    from tidering.operators import ordering

    monkeypatch.setattr(ordering, "STRETCH", 7)
    t = spark.range(60).select(F.col("id").alias("ordinal"), (F.col("id") * F.col("id") % 11).alias("v"), (F.col("id") % 2).alias("s"))
    got = {r["ordinal"]: (r["prev_v"], r["total"]) for r in ordering.running_sum(ordering.previous(t, ["v"], stream=["s"]), "v", "total", stream=["s"]).collect()}
    v = [i * i % 11 for i in range(60)]
    assert got == {i: (v[i - 2] if i > 1 else None, sum(v[i % 2 : i + 1 : 2])) for i in range(60)}

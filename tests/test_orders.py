"""Order-dependent operators against plain folds, with stretches cut small so that their edges show."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidering.functions.codecs import fnv1a, splitmix64
from tidering.operators import events, ordering, reconstruct, records, ring, sizing, workload


@pytest.mark.parametrize("seed", range(4))
def test_generations_of_blocks_of_any_span_equal_a_fold(spark, monkeypatch, seed):
    r = random.Random(seed)
    g = ring.Geometry(16384, 1024, 900, 256, 3)
    monkeypatch.setattr(ring, "STRETCH", 40 if seed else 22)
    sizes = [r.choice([1, 100, 500, 900, r.randrange(1, 901)]) if seed % 2 else 1 for _ in range(r.choice([0, 1, 40, 333]) if seed else 260)]
    want, generation, sequence, used = [], 1, 0, 0
    for n, size in enumerate(sizes):
        if sequence and (used + g.span(900) > g.data or sequence >= 1024 // 48):
            generation, sequence, used = generation + 1, 0, 0
        want.append((n, generation, sequence, (generation - 1) % 3, 4096 + used, g.span(size)))
        sequence, used = sequence + 1, used + g.span(size)
    df = spark.createDataFrame(list(enumerate(sizes)), "block long, raw_size long")
    got = ring.assigned(df, g).select("block", "generation", "sequence", "slot", "physical_offset", "frame_span").orderBy("block").collect()
    assert [tuple(x) for x in got] == want


def test_nearest_marks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ordering, "STRETCH", 7)
    r = random.Random(2)
    rows = sorted({(r.randrange(3), r.randrange(200)) for _ in range(150)})
    marks = sorted({(r.randrange(3), r.randrange(200)) for _ in range(12)})
    df = spark.createDataFrame(rows, "s int, ordinal long")
    m = spark.createDataFrame([(s, o, o * 10) for s, o in marks], "s int, ordinal long, v long")
    got = {(x["s"], x["ordinal"]): (x["before"], x["after"]) for x in ordering.nearest(df, m, "v", ["s"]).collect()}
    want = {(s, o): (max((10 * b for a, b in marks if a == s and b <= o), default=None), min((10 * b for a, b in marks if a == s and b > o), default=None)) for s, o in rows}
    assert got == want


def test_percentiles_equal_sorting(spark, monkeypatch):
    r = random.Random(5)
    groups = {"a": [r.choice([1.0, 2.0, 3.0]) for _ in range(500)], "b": [r.random() for _ in range(30_000)], None: [7.5], "c": [None, 4.0, None]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    asked = {"p0": 0.0001, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {x["g"]: x for x in sizing.percentiles(df, "v", ["g"], asked).collect()}
    for g, vs in groups.items():
        some = sorted(v for v in vs if v is not None)
        assert (got[g]["n"], got[g]["max_value"]) == (len(some), some[-1])
        for name, f in asked.items():
            assert got[g][name] == some[math.ceil(f * len(some)) - 1], (g, name)


def test_reservoir_equals_the_fold(spark):
    k, n = 16, 400
    places: list = []
    for i in range(1, n + 1):
        if len(places) < k:
            places.append(i)
        elif (at := int(splitmix64(np.array([i], np.uint64))[0]) % i) < k:
            places[at] = i
    df = spark.range(1, n + 1).withColumnRenamed("id", "i")
    got = sorted((x["place"], x["i"]) for x in sizing.reservoir(df.repartition(5), "i", k).collect())
    assert got == list(enumerate(places))


def test_digests_follow_the_order(spark):
    df = spark.createDataFrame([(1, 2, [5, -1]), (1, 1, [7]), (2, 1, [])], "g long, at long, values array<long>")
    got = {x["g"]: x["digest"] % 2**64 for x in sizing.digests(df, ["g"], ["at"]).collect()}
    assert got == {1: fnv1a(b"".join(v.to_bytes(8, "little", signed=True) for v in (7, 5, -1))), 2: fnv1a(b"")}


def test_sessions(spark):
    rows = [(0, 0, 0, "a"), (1, 10, 1, "a"), (2, 5, 2, "a"), (3, 20, 1, "a"), (4, 30, 2, "b"), (5, 31, 900, "b"), (6, 9999, 901, "b"), (7, 10000, 902, None), (8, 10001, 903, None)]
    df = spark.createDataFrame([(o, t * 10**9, n, b) for o, t, n, b in rows], "ordinal long, index_time_ns long, number long, boot string").withColumn("s", F.lit(1))
    got = [x["clock_segment"] for x in reconstruct.segments(df, ["s"], 1000 * 10**9, "number", "boot", 5.0).orderBy("ordinal").collect()]
    assert got == [0, 0, 1, 2, 3, 4, 5, 6, 6]
    assert [x["clock_segment"] for x in reconstruct.segments(df, ["s"], 1000 * 10**9).orderBy("ordinal").collect()] == [0, 0, 1, 1, 1, 1, 2, 2, 2]


def test_models_and_uncertainty(spark):
    pairs = spark.createDataFrame([("a", 0, 100), ("a", 10, 121), ("a", 20, 139), ("b", 5, 50), ("c", 0, 10), ("c", 10, 0)], "s string, local_ns long, trusted_ns long")
    m = reconstruct.clock_models(pairs, ["s"])
    m = m.withColumn("u", reconstruct.uncertainty(F.lit(1_000_020), {c: F.col(c) for c in ("residual_ns", "from_local_ns", "to_local_ns")}, 100, 7))
    got = {x["s"]: x for x in m.collect()}
    assert got["a"]["rate"] == pytest.approx(1.95) and got["a"]["residual_ns"] == pytest.approx(1.5) and got["a"]["u"] == pytest.approx(1.5 + 100 + 7)
    assert (got["b"]["rate"], got["b"]["n"], got["b"]["residual_ns"]) == (1.0, 1, 0.0)
    assert got["c"]["rate"] == 0.0  # mapped times don't go back


def test_two_readers_and_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z")], "i int, s string")
    b = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "i int, s string")
    assert tuple(records.compared(a, b).first()) == (2, 1, 2)
    assert tuple(records.compared(a.limit(0), b.limit(0)).first()) == (0, 0, 0)
    d = spark.createDataFrame([(5, "x", 1), (3, "x", 1), (4, None, 1), (9, None, 1)], "ordinal long, k string, n int")
    assert sorted(x["ordinal"] for x in records.first_of_each(d, ["k", "n"]).collect()) == [3, 4]


def test_gaps_can_be_errors(spark):
    df = spark.createDataFrame([("data", 1), ("corrupt_gap", 2)], "kind string, n int")
    assert events.failing_on_gaps(df.where("n = 1")).count() == 1
    with pytest.raises(Exception, match="corrupt"):
        events.failing_on_gaps(df).collect()


@pytest.mark.parametrize("profile", workload.PROFILES)
def test_workloads(spark, profile):
    got = [tuple(x) for x in workload.records(spark, profile, 300, seed=3).orderBy("ordinal").collect()]
    assert got == [tuple(x) for x in workload.records(spark, profile, 300, seed=3).repartition(3).orderBy("ordinal").collect()]
    sizes = {len(x[4]) for x in got}
    assert all(bytes(x[4][:8]) == x[0].to_bytes(8, "little") for x in got) and min(sizes) >= 8
    if profile == "logs":
        assert all(bytes(x[4][8:]) == (workload.LINE * 9).encode()[8 : len(x[4])] for x in got)
    if profile == "compressible":
        assert sizes == {128} and set(got[150][4][8:]) == {1}
    if profile == "bad-time":
        assert got[150][1] == 0 and got[29][1] == 29_000_000 and got[30][1] > workload.EPOCH

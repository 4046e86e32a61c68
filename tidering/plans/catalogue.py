"""The registered queries of the record engine, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import columns as C
from ..operators import blocks, events, reconstruct, records, ring, sizing, verify, workload
from ..operators.ordering import spread

DAY = 86_400 * 10**9
#: 2024-01-05 and 2024-01-12 in nanoseconds; the range of the event queries.
BEGIN, END = 1_704_412_800 * 10**9, 1_705_017_600 * 10**9
#: 30 days from 1997-01-01, for the orders.
O_BEGIN, O_END = 852_076_800 * 10**9, 852_076_800 * 10**9 + 30 * DAY
SELECTORS = (3, 5, 8, 13, 21, 34, 55, 89)
RING = ring.Geometry(partition=131_072, index=4096, block=4096, quantum=512, slots=3)
MAX_BLOCK, CHECKPOINT = 4096, 1000

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# ---- what the SQL shares

EV = """ev AS (
  SELECT event_id AS ordinal, epoch_us(ts) * 1000 AS index_time_ns, user_id AS selector, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flags,
         encode(props) AS payload, 1::BIGINT AS time_domain_id, 32 + strlen(props) AS size FROM events
)"""
ORD = """od AS (
  SELECT o_orderkey AS ordinal, epoch_us(o_orderdate) * 1000 AS index_time_ns, o_custkey AS selector, 0 AS flags, encode(o_orderpriority) AS payload,
         1::BIGINT AS time_domain_id, 32 + strlen(o_orderpriority) AS size FROM orders
)"""


def packed_sql(source: str, name: str) -> str:
    """Greedy packing: the next start of every record, then the starts that are reached from a segment's first."""
    return f"""
{name}_s AS (SELECT *, ordinal // {CHECKPOINT} AS segment, sum(size) OVER (PARTITION BY ordinal // {CHECKPOINT} ORDER BY ordinal) AS upto FROM {source}),
{name}_n AS (
  SELECT a.segment, a.ordinal, min(b.ordinal) AS next FROM {name}_s a
  LEFT JOIN {name}_s b ON a.segment = b.segment AND b.ordinal > a.ordinal AND b.upto - a.upto + a.size > {MAX_BLOCK} GROUP BY 1, 2
),
{name}_w AS (
  SELECT segment, min(ordinal) AS start, 0 AS segment_block FROM {name}_s GROUP BY 1
  UNION ALL SELECT w.segment, n.next, w.segment_block + 1 FROM {name}_w w JOIN {name}_n n ON n.segment = w.segment AND n.ordinal = w.start WHERE n.next IS NOT NULL
),
{name} AS (
  SELECT s.*, w.segment_block, w.start FROM {name}_s s ASOF JOIN {name}_w w ON s.segment = w.segment AND s.ordinal >= w.start
),
{name}_b AS (
  SELECT segment, segment_block::BIGINT AS segment_block, count(*) AS record_count, min(ordinal) AS first_ordinal, min(index_time_ns) AS min_time_ns, max(index_time_ns) AS max_time_ns,
         bit_or(CASE WHEN flags & 1 <> 0 THEN 2 ELSE 0 END)::BIGINT AS flags, sum(size)::BIGINT AS raw_size FROM {name} GROUP BY 1, 2
)"""


def mixed_sql(source: str, number: str, carried: str = "*") -> str:
    """source with mixed: splitmix64 of an unsigned number, in 128 bits cut back to 64."""
    cut = "% 18446744073709551616::UHUGEINT"
    return f"""SELECT {carried}, xor(c, c >> 31) AS mixed FROM (
  SELECT *, xor(b, b >> 27) * 10723151780598845931::UHUGEINT {cut} AS c FROM (
    SELECT *, xor(a, a >> 30) * 13787848793156543929::UHUGEINT {cut} AS b FROM (SELECT *, ({number}::UHUGEINT + 11400714819323198485::UHUGEINT) {cut} AS a FROM {source})))"""


SIGNED = "CASE WHEN {0} >= 9223372036854775808::UHUGEINT THEN ({0}::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE {0}::BIGINT END"

#: Packed blocks of any span through the ring: where the next partition would start after a start at each block, the starts that are reached, and each block's.
RINGED = f"""
{packed_sql('ev', 'pk')},
rg_b AS (SELECT *, row_number() OVER (ORDER BY segment, segment_block) - 1 AS block, CAST(ceil((128 + raw_size) / {RING.quantum}.0) * {RING.quantum} AS BIGINT) AS frame_span FROM pk_b),
rg_s AS (SELECT *, coalesce(sum(frame_span) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM rg_b),
rg_n AS (
  SELECT a.block, min(b.block) AS next FROM rg_s a
  LEFT JOIN rg_s b ON b.block > a.block AND b.block <= a.block + {RING.index // 48} AND (b.before - a.before + {RING.span(RING.block)} > {RING.data} OR b.block - a.block = {RING.index // 48}) GROUP BY 1
),
rg_w AS (
  SELECT 0::BIGINT AS start, 1::BIGINT AS generation WHERE EXISTS (SELECT 1 FROM rg_s)
  UNION ALL SELECT n.next, w.generation + 1 FROM rg_w w JOIN rg_n n ON n.block = w.start WHERE n.next IS NOT NULL
),
ro AS (
  SELECT s.*, w.generation, s.block - w.start AS sequence, (w.generation - 1) % {RING.slots} AS slot, 4096 + s.before - f.before AS physical_offset
  FROM rg_s s ASOF JOIN rg_w w ON s.block >= w.start JOIN rg_s f ON f.block = w.start
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def shown(df: DataFrame) -> DataFrame:
    return df.select("ordinal", "index_time_ns", "selector", F.col("flags").cast("long").alias("flags"), F.col("payload").cast("string").alias("payload"))


SHOWN = "ordinal, index_time_ns, selector, flags::BIGINT AS flags, decode(payload) AS payload"

# ---- records


@query(f"WITH {EV} SELECT {SHOWN} FROM ev")
def record_scan(spark, d):
    return shown(records.events(spark, d))


@query(f"WITH {EV} SELECT {SHOWN} FROM ev WHERE index_time_ns >= {BEGIN} AND index_time_ns < {END}")
def record_time_range(spark, d):
    return shown(records.query(records.events(spark, d, (BEGIN, END)), BEGIN, END))


@query(f"WITH {EV} SELECT {SHOWN} FROM ev WHERE time_domain_id = 1 AND index_time_ns >= {BEGIN} AND index_time_ns < {END} AND selector IN {SELECTORS}")
def record_query(spark, d):
    return records.in_order(shown(records.query(records.events(spark, d, (BEGIN, END)), BEGIN, END, SELECTORS)))


@query(f"WITH {EV} SELECT {SHOWN} FROM ev WHERE index_time_ns >= {BEGIN} AND index_time_ns < {END} AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = selector AND c_acctbal > 0)")
def record_selector_semi(spark, d):
    wanted = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("selector"))
    return shown(records.query(records.events(spark, d, (BEGIN, END)), BEGIN, END, wanted))


@query(f"WITH {EV} SELECT {SHOWN} FROM ev WHERE flags & 1 <> 0")
def record_flags_filter(spark, d):
    return shown(records.events(spark, d).where(C.has_bit("flags", 1)))


@query(f"WITH {EV}, {ORD} SELECT time_domain_id, count(*) AS n, min(index_time_ns) AS min_time_ns, max(index_time_ns) AS max_time_ns FROM (SELECT * FROM ev UNION ALL SELECT * REPLACE (2 AS time_domain_id) FROM od) WHERE time_domain_id = 2 AND index_time_ns >= {O_BEGIN} AND index_time_ns < {O_END} GROUP BY 1")
def domain_isolation(spark, d):
    both = records.events(spark, d).unionByName(records.orders(spark, d, F.lit(2)))
    return records.query(both, O_BEGIN, O_END, domain=2).groupBy("time_domain_id").agg(F.count(F.lit(1)).alias("n"), F.min("index_time_ns").alias("min_time_ns"), F.max("index_time_ns").alias("max_time_ns"))


@query(f"WITH {EV}, {ORD} SELECT record_format_version, count(*) AS n, sum(size)::BIGINT AS bytes FROM (SELECT 1 AS record_format_version, size FROM ev UNION ALL SELECT 2, size FROM od) GROUP BY 1")
def mixed_profile_dispatch(spark, d):
    both = records.with_profiles({(7, 1): records.events(spark, d), (7, 2): records.orders(spark, d)})
    return both.groupBy("record_format_version").agg(F.count(F.lit(1)).alias("n"), F.sum(records.encoded_size()).alias("bytes"))


@query(f"WITH {EV} SELECT {SHOWN} FROM ev ORDER BY ordinal LIMIT 25")
def record_early_stop(spark, d):
    return shown(records.events(spark, d)).orderBy("ordinal").limit(25)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 AND c_custkey > 0 THEN 18446744073709551616 - c_custkey ELSE c_custkey END::DECIMAL(20,0)::VARCHAR AS selector FROM customer")
def unsigned_selectors(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    bits = F.when(F.col("c_custkey") % 2 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey"))
    return c.select(F.col("c_custkey").alias("id"), C.unsigned(C.signed(C.unsigned(bits))).cast("string").alias("selector"))


@query("SELECT doc_id AS ordinal, strlen(coalesce(text, '')) + 32 AS size FROM documents WHERE strlen(coalesce(text, '')) + 32 > 8192")
def oversize_reject(spark, d):
    return blocks.rejected(records.text_records(spark, d), 8192).select("ordinal", records.encoded_size().alias("size"))


# ---- anomalies


def _anomaly(back: int, fwd: int) -> str:
    b = f"prev_time_ns - index_time_ns > {back}" if back >= 0 else "false"
    f = f"index_time_ns - prev_time_ns > {fwd}" if fwd >= 0 else "false"
    return f"WITH {ORD}, l AS (SELECT *, lag(index_time_ns) OVER (ORDER BY ordinal) AS prev_time_ns FROM od) SELECT ordinal, index_time_ns, prev_time_ns, coalesce({b}, false) AS backward_anomaly, coalesce({f}, false) AS forward_anomaly FROM l WHERE coalesce({b}, false) OR coalesce({f}, false)"


def _anomalous(df: DataFrame) -> DataFrame:
    return df.where("anomaly").select("ordinal", "index_time_ns", "prev_time_ns", "backward_anomaly", "forward_anomaly")


@query(_anomaly(30 * DAY, -1))
def time_anomaly_backward(spark, d):
    return _anomalous(records.anomalies(records.orders(spark, d), 30 * DAY, -1))


@query(_anomaly(-1, 365 * DAY))
def time_anomaly_forward(spark, d):
    return _anomalous(records.anomalies(records.orders(spark, d), -1, 365 * DAY))


@query(_anomaly(900 * DAY, 900 * DAY))
def time_anomaly_both(spark, d):
    return _anomalous(records.anomalies(records.orders(spark, d), 900 * DAY, 900 * DAY))


@query(f"""
WITH {ORD}, o AS (SELECT *, 1 + ordinal // 1000 AS dom FROM od), l AS (SELECT *, lag(index_time_ns) OVER (ORDER BY ordinal) AS p, lag(dom) OVER (ORDER BY ordinal) AS q FROM o)
SELECT dom AS time_domain_id, count(*) AS records, sum(CASE WHEN p > index_time_ns AND q = dom THEN 1 ELSE 0 END)::BIGINT AS anomalies FROM l GROUP BY 1""")
def anomaly_domain_reset(spark, d):
    o = records.orders(spark, d, 1 + F.floor(F.col("o_orderkey") / 1000))
    return records.anomalies(o, 0, -1).groupBy("time_domain_id").agg(F.count(F.lit(1)).alias("records"), F.count_if("anomaly").alias("anomalies"))


@query(f"WITH {ORD}, l AS (SELECT *, 1 + ordinal // 2000 AS dom FROM od), c AS (SELECT *, CASE WHEN lag(dom) OVER (ORDER BY ordinal) <> dom THEN 1 ELSE 0 END AS new FROM l), r AS (SELECT *, sum(new) OVER (ORDER BY ordinal) AS run FROM c) SELECT run::BIGINT AS domain_run, min(ordinal) AS first_ordinal, count(*) AS n FROM r GROUP BY 1")
def domain_runs(spark, d):
    o = records.orders(spark, d, 1 + F.floor(F.col("o_orderkey") / 2000))
    return records.domain_runs(o).groupBy("domain_run").agg(F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("n"))


# ---- blocks

BLOCK = "segment, segment_block, record_count, first_ordinal, min_time_ns, max_time_ns, flags, raw_size"


def _packed(spark, d, source=records.events) -> DataFrame:
    return blocks.pack(source(spark, d), MAX_BLOCK, CHECKPOINT)


@query(f"WITH RECURSIVE {EV}, {packed_sql('ev', 'pk')} SELECT {BLOCK} FROM pk_b")
def block_pack(spark, d):
    return blocks.summaries(_packed(spark, d))


@query(f"WITH RECURSIVE {EV}, {packed_sql('ev', 'pk')} SELECT {BLOCK} FROM pk_b WHERE min_time_ns < {END} AND max_time_ns >= {BEGIN}")
def block_candidates(spark, d):
    return blocks.candidates(blocks.summaries(_packed(spark, d)), BEGIN, END)


@query(f"WITH {EV} SELECT {SHOWN} FROM ev WHERE index_time_ns >= {BEGIN} AND index_time_ns < {END}")
def record_query_by_blocks(spark, d):
    return shown(blocks.query_by_blocks(_packed(spark, d), BEGIN, END))


@query(f"""
WITH RECURSIVE {ORD}, {packed_sql('od', 'pk')},
c AS (SELECT segment, segment_block, record_count FROM pk_b WHERE min_time_ns < {O_END} AND max_time_ns >= {O_BEGIN})
SELECT (SELECT coalesce(sum(record_count), 0)::BIGINT FROM c) AS in_candidates, (SELECT count(*) FROM od WHERE index_time_ns >= {O_BEGIN} AND index_time_ns < {O_END}) AS exact""")
def candidate_false_positives(spark, d):
    p = _packed(spark, d, records.orders)
    some = blocks.candidates(blocks.summaries(p), O_BEGIN, O_END).agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("in_candidates"))
    return some.join(F.broadcast(p.agg(F.count_if(C.in_range("index_time_ns", O_BEGIN, O_END)).alias("exact"))))


@query(f"""
WITH RECURSIVE {ORD}, {packed_sql('od', 'pk')}, l AS (SELECT ordinal, lag(index_time_ns) OVER (ORDER BY ordinal) AS p FROM od)
SELECT k.segment, k.segment_block::BIGINT AS segment_block, bit_or(CASE WHEN p - index_time_ns > {30 * DAY} THEN 1 ELSE 0 END)::BIGINT AS flags FROM pk k JOIN l USING (ordinal) GROUP BY 1, 2""")
def block_flags_or(spark, d):
    o = records.anomalies(records.orders(spark, d), 30 * DAY, -1)
    return blocks.summaries(blocks.pack(o, MAX_BLOCK, CHECKPOINT)).select("segment", "segment_block", "flags")


@query(f"WITH RECURSIVE {EV}, {packed_sql('ev', 'pk')} SELECT segment, segment_block, CAST(ceil((128 + raw_size) / 512.0) * 512 AS BIGINT) AS frame_span, raw_size + raw_size // 255 + 16 AS lz4_bound, raw_size + CAST(ceil(raw_size / 128.0) AS BIGINT) AS packbits_bound FROM pk_b")
def frame_span(spark, d):
    b = blocks.summaries(_packed(spark, d))
    return b.select("segment", "segment_block", C.frame_span(F.col("raw_size"), 512).alias("frame_span"), C.most_compressed(F.col("raw_size"), "lz4_block").alias("lz4_bound"), C.most_compressed(F.col("raw_size"), "packbits").alias("packbits_bound"))


# ---- the ring


def _ring(spark, d) -> DataFrame:
    """The packed events' blocks, of their true sizes, in a ring."""
    return ring.assigned(ring.numbered(blocks.summaries(_packed(spark, d))), RING)


@query(f"WITH RECURSIVE {EV}, {RINGED} SELECT block, generation, sequence, slot, frame_span FROM ro")
def ring_assign(spark, d):
    return _ring(spark, d).select("block", "generation", "sequence", "slot", "frame_span")


@query(f"WITH RECURSIVE {EV}, {RINGED} SELECT block, generation, physical_offset FROM ro")
def physical_offset(spark, d):
    return _ring(spark, d).select("block", "generation", "physical_offset")


@query(f"WITH RECURSIVE {EV}, {RINGED} SELECT block, generation, slot, record_count FROM ro WHERE generation > (SELECT max(generation) FROM ro) - {RING.slots}")
def retention_window(spark, d):
    return ring.retained(_ring(spark, d), RING.slots).select("block", "generation", "slot", "record_count")


INSPECT = "SELECT generation, slot, count(*) AS block_count, sum(record_count)::BIGINT AS record_count, min(min_time_ns) AS min_time_ns, max(max_time_ns) AS max_time_ns, bit_or(flags) AS flags, sum(frame_span)::BIGINT AS data_bytes FROM ro GROUP BY 1, 2"


@query(f"WITH RECURSIVE {EV}, {RINGED} {INSPECT}")
def partition_inspect(spark, d):
    return ring.inspect(_ring(spark, d))


@query(f"WITH RECURSIVE {EV}, {RINGED}, i AS ({INSPECT}) SELECT * FROM i WHERE generation = (SELECT max(generation) FROM i)")
def active_partition(spark, d):
    return ring.active(ring.inspect(_ring(spark, d)))


# ---- verification


@query(f"WITH RECURSIVE {EV}, {RINGED} SELECT generation, sequence FROM ro r WHERE sequence < coalesce((SELECT min(sequence) FROM ro b WHERE b.generation = r.generation AND b.block % 11 = 7), 1000000)")
def prefix_valid(spark, d):
    marked = _ring(spark, d).withColumn("valid", F.col("block") % 11 != 7)
    return verify.valid_prefix(marked).select("generation", "sequence")


@query(f"WITH RECURSIVE {EV}, {RINGED} SELECT generation, sequence, CASE WHEN block % 13 = 5 THEN 'not_indexed' ELSE 'differs' END AS problem FROM ro WHERE block % 13 = 5 OR block % 17 = 4")
def strict_verify_mismatch(spark, d):
    scanned = _ring(spark, d)
    index = scanned.where("block % 13 <> 5").withColumn("record_count", F.col("record_count") + F.when(F.col("block") % 17 == 4, 1).otherwise(0))
    return verify.mismatches(index, scanned)


@query(f"WITH RECURSIVE {EV}, {RINGED} SELECT generation, sequence FROM ro WHERE sequence > 0 AND block % 9 = 3")
def writer_chain(spark, d):
    r = _ring(spark, d).withColumn("writer", F.col("generation") * 10)
    told = F.when(F.col("sequence") == 0, 0).when(F.col("block") % 9 == 3, -1).otherwise(F.col("writer"))
    return verify.broken_chains(r.withColumn("previous_writer", told)).select("generation", "sequence")


@query(f"WITH RECURSIVE {EV}, {RINGED} SELECT count(*) FILTER (block % 10 <> 0) AS blocks, coalesce(sum(record_count) FILTER (block % 10 <> 0), 0)::BIGINT AS records, coalesce(sum(raw_size) FILTER (block % 10 <> 0), 0)::BIGINT AS raw_bytes, count(*) FILTER (block % 10 = 0) AS gaps FROM ro")
def verify_totals(spark, d):
    r = _ring(spark, d).withColumn("kind", F.when(F.col("block") % 10 == 0, events.CORRUPT).otherwise("data"))
    return verify.totals(r)


@query(f"WITH RECURSIVE {EV}, {RINGED} SELECT min(generation) AS generation, count(*) AS n FROM ro WHERE sequence = 0 GROUP BY (generation - 1) // 2 HAVING count(*) > 1")
def duplicate_generations(spark, d):
    p = ring.inspect(_ring(spark, d)).withColumn("generation", F.floor((F.col("generation") - 1) / 2).cast("long") * 2 + 1)
    return verify.duplicates(p)


@query(f"WITH RECURSIVE {EV}, {RINGED} SELECT block, record_count FROM ro r WHERE record_count <> (SELECT count(*) FROM pk p WHERE p.segment = r.segment AND p.segment_block = r.segment_block AND ordinal % 97 <> 0)")
def short_blocks(spark, d):
    e = _packed(spark, d).where("ordinal % 97 <> 0")
    return verify.short_blocks(_ring(spark, d), e, ["segment", "segment_block"]).select("block", "record_count")


@query(f"WITH RECURSIVE {EV}, {RINGED} SELECT generation, sequence, block % 19 <> 6 AS agrees FROM ro WHERE block % 23 <> 1")
def index_lookup(spark, d):
    headers = _ring(spark, d)
    index = headers.where("block % 23 <> 1").withColumn("frame_span", F.col("frame_span") + F.when(F.col("block") % 19 == 6, 512).otherwise(0))
    return verify.looked_up(index, headers)


@query(f"""
WITH RECURSIVE {EV}, {RINGED}, p AS (SELECT DISTINCT slot, generation FROM ro), top AS (SELECT max(generation) AS g FROM p)
SELECT slot, generation, CASE WHEN slot = 1 THEN 'corrupt_gap' WHEN generation <= g - {RING.slots} THEN 'overwritten_gap' ELSE 'data' END AS kind FROM p, top WHERE generation > g - {RING.slots + 2} AND generation <= g""")
def snapshot_against_current(spark, d):
    p = ring.inspect(_ring(spark, d)).select("slot", "generation")
    now = ring.retained(p, RING.slots)
    return verify.against_current(ring.retained(p, RING.slots + 2), now.where("slot <> 1"))


@query(f"""
WITH RECURSIVE {EV}, {RINGED}, n AS (
  SELECT generation, sequence, 0 AS place, x.v, x.i FROM ro, LATERAL (SELECT unnest([generation, sequence, slot, flags]) AS v, unnest([1, 2, 3, 4]) AS i) x
  UNION ALL SELECT r.generation, r.sequence, 1, p.ordinal, p.ordinal FROM ro r JOIN pk p USING (segment, segment_block)
), b AS (SELECT generation, list(v ORDER BY sequence, place, i) AS vs FROM n GROUP BY 1),
f AS (SELECT generation, list_reduce(list_concat([14695981039346656037::UHUGEINT], flatten(list_transform(vs, lambda v: list_transform([0, 8, 16, 24, 32, 40, 48, 56], lambda k: ((v::BIGINT >> k) & 255)::UHUGEINT)))),
  lambda h, x: xor(h, x) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT) AS h FROM b)
SELECT generation, CASE WHEN h >= 9223372036854775808::UHUGEINT THEN (h::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE h::BIGINT END AS digest FROM f""")
def generation_digests(spark, d):
    packed = _packed(spark, d)
    r = ring.assigned(ring.numbered(blocks.summaries(packed)), RING)
    told = r.select("generation", "sequence", F.lit(-1).cast("long").alias("at"), F.array("generation", "sequence", "slot", "flags").alias("values"))
    held = packed.join(r.select("segment", "segment_block", "generation", "sequence"), ["segment", "segment_block"]).select("generation", "sequence", F.col("ordinal").alias("at"), F.array("ordinal").alias("values"))
    return sizing.digests(told.unionByName(held), ["generation"], ["sequence", "at"])


@query(f"WITH RECURSIVE {EV}, {packed_sql('ev', 'pk')} SELECT {SHOWN} FROM pk WHERE selector IN {SELECTORS}")
def record_query_by_values(spark, d):
    packed = _packed(spark, d)
    wanted = spark.createDataFrame([(x,) for x in SELECTORS], "selector long")
    return shown(blocks.query_by_values(packed, blocks.value_index(packed), wanted))


@query(f"WITH {EV} SELECT 0::BIGINT AS only_a, 0::BIGINT AS only_b, count(*) AS in_both FROM ev WHERE index_time_ns >= {BEGIN} AND index_time_ns < {END}")
def two_readers(spark, d):
    a = records.query(records.events(spark, d, (BEGIN, END)), BEGIN, END)
    return records.compared(shown(a), shown(blocks.query_by_blocks(_packed(spark, d), BEGIN, END)))


@query(f"WITH {EV}, t AS (SELECT * FROM ev UNION ALL SELECT * REPLACE (ordinal + 1000000000 AS ordinal) FROM ev WHERE ordinal % 3 = 0) SELECT {SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY index_time_ns, selector, flags, payload ORDER BY ordinal) AS n FROM t) WHERE n = 1")
def standby_duplicates(spark, d):
    e = records.events(spark, d)
    standby = e.where("ordinal % 3 = 0").withColumn("ordinal", F.col("ordinal") + 1_000_000_000)
    return shown(records.first_of_each(e.unionByName(standby), ["index_time_ns", "selector", "flags", "payload"]))

@query(f"""
WITH RECURSIVE {EV}, {RINGED} SELECT kind, gap_rank, generation, sequence FROM (
  SELECT 'corrupt_gap' AS kind, 0 AS gap_rank, NULL::BIGINT AS generation, NULL::BIGINT AS sequence
  UNION ALL SELECT 'overwritten_gap', 1, generation, NULL FROM (SELECT DISTINCT generation FROM ro WHERE generation = 1)
  UNION ALL SELECT 'data', 1, generation, sequence FROM ro WHERE generation > 1)""")
def gap_union_order(spark, d):
    r = _ring(spark, d)
    gone = r.where("generation = 1").select("generation").distinct()
    out = events.stream(spark.range(1).select(F.lit(None).cast("long").alias("generation")), gone, r.where("generation > 1"))
    return out.select("kind", "gap_rank", "generation", "sequence").orderBy("gap_rank", "generation", "sequence")


@query(f"WITH RECURSIVE {EV}, {RINGED} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN block % 10 = 0 THEN 'corrupt_gap' ELSE 'data' END AS kind, min_time_ns AS t FROM ro) WHERE kind <> 'data' OR t < {BEGIN} GROUP BY 1")
def gaps_kept_by_filters(spark, d):
    r = _ring(spark, d).withColumn("kind", F.when(F.col("block") % 10 == 0, events.CORRUPT).otherwise("data"))
    return r.where(events.keeping_gaps(F.col("min_time_ns") < BEGIN)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {EV}, {RINGED} SELECT 'overwritten_gap' AS kind, g AS generation FROM range(1, (SELECT greatest(1, max(generation) - {RING.slots - 1}) FROM ro)) t(g)")
def reader_overrun(spark, d):
    return events.overrun(1, ring.retained(_ring(spark, d), RING.slots))


# ---- summaries and sizing


@query(f"WITH {EV} SELECT ordinal < (SELECT count(*) FROM ev) // 768 * 768 AS durable, count(*) AS n FROM ev GROUP BY 1")
def durable_watermark(spark, d):
    e = records.events(spark, d)
    return sizing.durable(e, 768, e.count()).groupBy("durable").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max_value FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return sizing.percentiles(spark.read.parquet(f"{d}/events.parquet"), "value", ["event_type"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(f"""
WITH e AS (SELECT event_id + 1 AS i, value FROM events), s AS ({mixed_sql('e', 'i')}),
p AS (SELECT i, value, CASE WHEN i <= 256 THEN i - 1 ELSE (mixed % i::UHUGEINT)::BIGINT END AS place FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY i DESC) AS n FROM p WHERE place < 256)
SELECT place::BIGINT AS place, i, value FROM r WHERE n = 1""")
def reservoir_sample(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") + 1).alias("i"), "value")
    return sizing.reservoir(e, "i", 256)


@query("""
WITH g AS (SELECT n_nationkey::BIGINT AS id, 1024 * (1 + n_nationkey % 5) AS b, 4096 * (1 + n_nationkey % 3) AS i FROM nation)
SELECT id, (b + (b + b // 255 + 16) + 128 + (b + b // 255 + 16) + i // 48 * 64)::BIGINT AS writer, (2 * b + i + 2 * (i // 48 * 64))::BIGINT AS reader FROM g""")
def ram_bounds(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"))
    writer, reader = sizing.ram_bounds(1024 * (1 + F.col("id") % 5), 4096 * (1 + F.col("id") % 3), "lz4_block")
    return n.select("id", writer.alias("writer"), reader.alias("reader"))


@query("SELECT n_nationkey::BIGINT AS id, ((1 + n_nationkey)::DOUBLE * 40 * (8 * 365 * 86400) * 1.5) * 2.0 / 1e12 AS tbw FROM nation")
def required_tbw(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"))
    return n.select("id", sizing.required_tbw((F.col("id") + 1) * 40, 8, 1.5, 2.0).alias("tbw"))


@query(f"""
WITH RECURSIVE {EV}, {RINGED}, g AS (SELECT *, block % 10 = 0 AS gone FROM ro), k AS (SELECT ordinal FROM pk p JOIN g USING (segment, segment_block) WHERE NOT g.gone)
SELECT (SELECT count(*) FROM k) AS records, (SELECT min(ordinal) FROM k) AS first_ordinal, (SELECT max(ordinal) FROM k) AS last_ordinal,
  count(*) FILTER (NOT gone) AS blocks, sum(raw_size) FILTER (NOT gone)::BIGINT AS raw_bytes, count(*) FILTER (gone) AS gaps FROM g""")
def stream_summary(spark, d):
    p = _packed(spark, d)
    r = ring.assigned(ring.numbered(blocks.summaries(p)), RING).withColumn("kind", F.when(F.col("block") % 10 == 0, events.CORRUPT).otherwise("data"))
    kept = p.join(r.where("kind = 'data'").select("segment", "segment_block"), ["segment", "segment_block"], "left_semi")
    return sizing.summary(r, kept)


@query(f"WITH {EV}, r AS (SELECT ordinal, lag(ordinal) OVER (ORDER BY ordinal) AS prev_ordinal FROM ev WHERE ordinal % 250 <> 7) SELECT ordinal, prev_ordinal FROM r WHERE prev_ordinal + 1 <> ordinal")
def ordinal_contiguity(spark, d):
    return sizing.missing_ordinals(records.events(spark, d).where("ordinal % 250 <> 7"))


@query("""
WITH g AS (SELECT n_nationkey::BIGINT AS id, 65536 * (1 + n_nationkey % 4) AS p, 4096 AS i, 1024 * (1 + n_nationkey % 5) AS s FROM nation)
SELECT id, least(CASE WHEN p - 8192 - i < s + 1024 THEN 0 ELSE 1 + (p - 8192 - i - s - 1024) // s END, i // 48)::BIGINT AS frames FROM g""")
def frames_per_partition(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"))
    p, s = 65536 * (1 + F.col("id") % 4), 1024 * (1 + F.col("id") % 5)
    return n.select("id", sizing.frames_per_partition(p, F.lit(4096), s, s + 1024).alias("frames"))


@query("SELECT n_nationkey::BIGINT AS id, (8 * (14 * 100.0 / (1 + n_nationkey)))::DOUBLE AS longest_s, (7 * (14 * 100.0 / (1 + n_nationkey)))::DOUBLE AS shortest_s, ((1 + n_nationkey)::DOUBLE * 40 * (8 * 365 * 86400) * 1.5) AS eight_year_bytes FROM nation")
def sizing_eight_year(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"))
    rate = F.col("id") + 1
    longest, shortest = sizing.retention_seconds(F.lit(8), F.lit(14), F.lit(100), rate)
    return n.select("id", longest.alias("longest_s"), shortest.alias("shortest_s"), sizing.written_bytes(rate * 40, 8, 1.5).alias("eight_year_bytes"))


@query("SELECT event_type, coalesce(sum(strlen(props))::DOUBLE / nullif(sum(32 + strlen(props)), 0)::DOUBLE, 0.0) AS payload_share, 0.0::DOUBLE AS nothing FROM events GROUP BY 1")
def guarded_ratios(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.sum(F.octet_length("props")).alias("a"), F.sum(F.octet_length("props") + C.ENVELOPE).alias("b"))
    return e.select("event_type", C.ratio(F.col("a"), F.col("b")).alias("payload_share"), C.ratio(F.col("a"), F.lit(0)).alias("nothing"))


@query("SELECT doc_id, lower(hex(encode(text)[1:64])) || CASE WHEN strlen(text) > 64 THEN '...' ELSE '' END AS preview FROM documents WHERE text IS NOT NULL")
def hex_preview(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    return t.select("doc_id", C.hex_preview(F.col("text").cast("binary")).alias("preview"))


@query("SELECT n_nationkey::BIGINT AS code, coalesce(['ok','invalid_argument','out_of_range','io_error','interrupted','no_space','corrupt','unsupported','not_found','busy','overwritten','generation_exhausted','closed','internal_error'][n_nationkey + 1], 'unknown') AS name FROM nation")
def status_names(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("code"))
    return n.select("code", C.status_name(F.col("code")).alias("name"))


# ---- bytes


def _texts(spark, d) -> DataFrame:
    codecs.bounded_batches(spark)
    t = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("raw"))
    return spread(t)


def _round_trip(spark, d, name: str) -> DataFrame:
    back = codecs.round_tripped(F.col("raw"), name)
    return _texts(spark, d).select("doc_id", F.octet_length("raw").cast("long").alias("raw_size"), F.sha2(back, 256).alias("sha256"))


SHA = "SELECT doc_id, strlen(text)::BIGINT AS raw_size, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL"


@query(SHA)
def packbits_roundtrip(spark, d):
    return _round_trip(spark, d, "packbits")


@query(SHA)
def lz4_roundtrip(spark, d):
    return _round_trip(spark, d, "lz4_block")


@query(f"""
WITH {EV}, t AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 2197175160) ELSE x >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
h AS (SELECT ordinal, list_transform(regexp_extract_all(hex(payload), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM ev),
m AS ({mixed_sql('h', 'ordinal')}),
f AS (SELECT ordinal, mixed, list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, x: xor(t.t[xor(c, x) % 256 + 1], c >> 8)) AS c,
  list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(bytes, lambda x: x::UHUGEINT)), lambda c, x: xor(c, x) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT) AS f FROM m, t)
SELECT ordinal, xor(c, 4294967295)::BIGINT AS crc, {SIGNED.format('f')} AS fnv, {SIGNED.format('mixed')} AS mixed FROM f""")
def frame_crc(spark, d):
    codecs.bounded_batches(spark)
    e = records.events(spark, d)
    return e.select("ordinal", codecs.crc32c_of(F.col("payload")).alias("crc"), codecs.fnv1a_of(F.col("payload")).alias("fnv"), codecs.splitmix64_of(F.col("ordinal")).alias("mixed"))


@query("""
WITH b AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(range(n)) AS i, unnest(regexp_extract_all(h, '..')) AS x FROM b),
c AS (SELECT doc_id, i, CASE WHEN x = lag(x) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM e),
g AS (SELECT doc_id, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
r AS (SELECT doc_id, run, count(*) AS l FROM g GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN l < 3 THEN 0 ELSE l // 130 + (l % 130 >= 3)::INT END AS runs, CASE WHEN l < 3 THEN l WHEN l % 130 < 3 THEN l % 130 ELSE 0 END AS literals FROM r),
s AS (SELECT *, sum((l >= 3)::INT) OVER (PARTITION BY doc_id ORDER BY run) AS stretch FROM p),
z AS (SELECT doc_id, stretch, sum(runs) AS runs, sum(literals) AS literals FROM s GROUP BY 1, 2),
packed AS (SELECT doc_id, sum(2 * runs + literals + CAST(ceil(literals / 128.0) AS BIGINT))::BIGINT AS size FROM z GROUP BY 1)
SELECT b.doc_id, least(coalesce(p.size, 0), b.n)::BIGINT AS stored_size, b.n::BIGINT AS raw_size FROM b LEFT JOIN packed p ON p.doc_id = b.doc_id""")
def codec_choice(spark, d):
    return _stored(spark, d, "packbits")


@query()
def codec_choice_lz4(spark, d):
    return _stored(spark, d, "lz4_block")


def _stored(spark, d, name: str) -> DataFrame:
    t = _texts(spark, d).withColumn("packed", codecs.encoded(F.col("raw"), name))
    return t.select("doc_id", F.octet_length(C.smallest(F.col("raw"), F.col("packed"))).cast("long").alias("stored_size"), F.octet_length("raw").cast("long").alias("raw_size"))


@query(f"""
WITH o AS (SELECT unnest(range(200)) AS ordinal), p AS (SELECT unnest({list(workload.PROFILES)!r}) AS profile), s AS ({mixed_sql('o', 'xor(ordinal, 7)')}), a AS (SELECT profile, ordinal, mixed FROM s, p)
SELECT profile, ordinal, (ordinal % 64)::BIGINT AS selector,
  CASE WHEN profile <> 'bad-time' OR ordinal < 20 THEN ordinal * 1000000 WHEN ordinal = 100 THEN 0 ELSE 1780000000000000000 + ordinal * 1000000 - CASE WHEN ordinal % 7 = 0 THEN 3000000 ELSE 0 END END::BIGINT AS index_time_ns,
  CASE WHEN profile IN ('tiny', 'sparse') THEN 8 + mixed % 25 WHEN profile IN ('mixed', 'hot-rotation', 'concurrent-read') THEN CASE WHEN ordinal % 100 = 0 THEN 50 + mixed % 101 ELSE 10 + mixed % 40 END
    WHEN profile = 'burst' THEN 16 + mixed % 112 WHEN profile IN ('compressible', 'incompressible') THEN 128 WHEN profile = 'logs' THEN 50 + mixed % 300 WHEN profile = 'bad-time' THEN 32 END::BIGINT AS size FROM a""")
def workloads(spark, d):
    made = [workload.records(spark, p, 200, seed=7).select(F.lit(p).alias("profile"), "ordinal", "selector", "index_time_ns", F.octet_length("payload").cast("long").alias("size")) for p in workload.PROFILES]
    return reduce(DataFrame.unionByName, made)


# ---- clocks


@query(f"""
WITH {ORD}, o AS (SELECT *, selector % 50 AS source FROM od), l AS (SELECT *, index_time_ns - lag(index_time_ns) OVER (PARTITION BY source ORDER BY ordinal) AS step FROM o),
s AS (SELECT *, sum(CASE WHEN step < 0 OR step > {400 * DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ordinal) AS clock_segment FROM l)
SELECT source, clock_segment::BIGINT AS clock_segment, count(*) AS n, min(ordinal) AS first_ordinal FROM s GROUP BY 1, 2""")
def clock_segments(spark, d):
    o = records.orders(spark, d).withColumn("source", F.col("selector") % 50)
    return reconstruct.segments(o, ["source"], 400 * DAY).groupBy("source", "clock_segment").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first_ordinal"))


@query(f"""
WITH {EV}, e AS (SELECT *, selector % 20 AS source FROM ev), a AS (SELECT source, ordinal, index_time_ns + 1000 AS trusted_ns FROM e WHERE ordinal % 37 = 0),
b AS (SELECT e.source, e.ordinal, a.ordinal AS at0, a.trusted_ns AS t0 FROM e ASOF LEFT JOIN a ON e.source = a.source AND e.ordinal >= a.ordinal),
c AS (SELECT b.*, a.ordinal AS at1, a.trusted_ns AS t1 FROM b ASOF LEFT JOIN a ON b.source = a.source AND b.ordinal < a.ordinal)
SELECT source, ordinal, coalesce(t0 + ((t1 - t0)::HUGEINT * (ordinal - at0) // (at1 - at0))::BIGINT, t0, t1) AS time_ns,
  CASE WHEN ordinal = at0 THEN 'observed_trusted' WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN 'anchored' WHEN t0 IS NOT NULL OR t1 IS NOT NULL THEN 'extrapolated' ELSE 'unrecoverable' END AS quality FROM c""")
def clock_interpolate(spark, d):
    e = records.events(spark, d).withColumn("source", F.col("selector") % 20)
    anchors = e.where("ordinal % 37 = 0").select("source", "ordinal", (F.col("index_time_ns") + 1000).alias("trusted_ns"))
    near = reconstruct.nearest_anchors(e, anchors, ["source"])
    b, a = F.col("before"), F.col("after")
    q = reconstruct.quality(F.coalesce(F.col("ordinal") == b["at"], F.lit(False)), b.isNotNull(), a.isNotNull(), F.lit(True), F.lit(False))
    return near.select("source", "ordinal", reconstruct.interpolated(F.col("ordinal"), b, a).alias("time_ns"), q.alias("quality"))


NOISE = "(ordinal * 7919 % 2001 - 1000) * 1000"


@query(f"""
WITH {EV}, e AS (SELECT selector % 10 AS source, ordinal // 5000 AS clock_segment, index_time_ns AS x, 1700000000000000000 + (index_time_ns - 1704067200000000000) * 2 + {NOISE} AS y FROM ev),
o AS (SELECT source, clock_segment, min({{'x': x, 'y': y}}) AS o FROM e GROUP BY 1, 2),
r AS (SELECT e.*, o.o.x AS x0, o.o.y AS y0 FROM e JOIN o USING (source, clock_segment)),
m AS (SELECT source, clock_segment, count(*) AS n, x0, y0, greatest(coalesce(regr_slope((y - y0)::DOUBLE, (x - x0)::DOUBLE), 1.0), 0.0) AS slope, min(x) AS lo, max(x) AS hi FROM r GROUP BY source, clock_segment, x0, y0),
u AS (SELECT m.source, m.clock_segment, max(abs((y - r.y0)::DOUBLE - slope * (x - r.x0)::DOUBLE)) AS residual FROM r JOIN m USING (source, clock_segment) GROUP BY 1, 2)
SELECT source, clock_segment, n, x0 AS origin_local_ns, y0 AS origin_trusted_ns, round(slope, 6) AS rate, (round(residual / 1e5) * 1e5)::BIGINT AS residual_ns, round(residual / 1e5) * 1e5 + 3600e9 * (50 / 1e6) + 500 AS an_hour_later_ns FROM m JOIN u USING (source, clock_segment)""")
def clock_model(spark, d):
    e = records.events(spark, d)
    noise = (F.col("ordinal") * 7919 % 2001 - 1000) * 1000
    pairs = e.select((F.col("selector") % 10).alias("source"), F.floor(F.col("ordinal") / 5000).cast("long").alias("clock_segment"), F.col("index_time_ns").alias("local_ns"), (1_700_000_000_000_000_000 + (F.col("index_time_ns") - 1_704_067_200_000_000_000) * 2 + noise).alias("trusted_ns"))
    m = reconstruct.clock_models(pairs, ["source", "clock_segment"]).withColumns({"rate": F.round("rate", 6), "residual_ns": F.round(F.col("residual_ns") / 1e5) * 1e5})
    later = reconstruct.uncertainty(F.col("to_local_ns") + 3600 * 10**9, {c: F.col(c) for c in ("residual_ns", "from_local_ns", "to_local_ns")}, 50, 500)
    return m.select("source", "clock_segment", "n", "origin_local_ns", "origin_trusted_ns", "rate", F.col("residual_ns").cast("long").alias("residual_ns"), later.alias("an_hour_later_ns"))


@query(f"""
WITH {EV}, e AS (SELECT *, selector % 20 AS source, ordinal % 4000 AS number, ordinal // 7000 AS boot FROM ev),
l AS (SELECT *, lag(index_time_ns) OVER w AS t, lag(number) OVER w AS q, lag(boot) OVER w AS p FROM e WINDOW w AS (PARTITION BY source ORDER BY ordinal)),
n AS (SELECT *, CASE WHEN index_time_ns < t OR index_time_ns - t > {3 * DAY} OR number < q OR (number - q)::DOUBLE * 1e9 > (index_time_ns - t)::DOUBLE * 2.0 OR (t IS NOT NULL AND boot <> p) THEN 1 ELSE 0 END AS new FROM l),
s AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY ordinal) AS clock_segment FROM n)
SELECT source, clock_segment::BIGINT AS clock_segment, count(*) AS n, min(ordinal) AS first_ordinal FROM s GROUP BY 1, 2""")
def clock_sessions(spark, d):
    e = records.events(spark, d).withColumns({"source": F.col("selector") % 20, "number": F.col("ordinal") % 4000, "boot": F.floor(F.col("ordinal") / 7000).cast("long")})
    return reconstruct.segments(e, ["source"], 3 * DAY, "number", "boot", 2.0).groupBy("source", "clock_segment").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first_ordinal"))


@query(f"""
WITH {EV}, k AS (SELECT ordinal, ordinal % 11 = 0 AS t, ordinal % 2 = 0 AS b, ordinal % 3 = 0 AS a, ordinal % 5 = 0 AS near, ordinal % 7 = 0 AS arrived FROM ev)
SELECT quality, count(*) AS n FROM (SELECT CASE WHEN t THEN 'observed_trusted' WHEN b AND a THEN 'anchored' WHEN (b OR a) AND near THEN 'extrapolated' WHEN arrived THEN 'arrival_bounded' WHEN b OR a THEN 'order_only' ELSE 'unrecoverable' END AS quality FROM k) GROUP BY 1""")
def quality_classes(spark, d):
    every = lambda n: F.col("ordinal") % n == 0
    q = reconstruct.quality(every(11), every(2), every(3), every(5), every(7))
    return records.events(spark, d).groupBy(q.alias("quality")).agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

"""MinHash near-duplicate detection.

Universal hash minima with banding propose pairs, packed signatures and then the full
shingle sets verify them, and alternating large-star and small-star passes turn the
links into components. Only documents whose sets differ take part in pairs: copies of
one set are folded into their smallest id first.

A bucket never emits all of its pairs. Every document is tested against the most
central document of each of its buckets, its pivot; then those other pairs of a bucket
that are in different components, which the documents' differences from their pivot
narrow down to few. The result is
the components of the graph of all verified pairs that share a bucket; a pair at the
threshold shares none with probability under 1e-7.

A null or empty text has an empty set and no links. A row is a document of its own: rows
that repeat an id with another text are in the component of their own text, which is
named by its smallest id, so that no text is in a component that doesn't resemble it.
Rows that are equal throughout are returned as often as they occur. A row without doc_id
is returned, kept, with a null component. Texts of any length are hashed whole; an empty
table gives an empty result; other columns of the table are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_order, running_sum

#: Four minima a band: 32 bands miss a pair of similarity 0.8 with probability 4.8e-8.
BANDS, ROWS = 32, 4
#: Minima in a signature; the first BANDS * ROWS make the bands.
MINIMA = 256
#: Of the minima of two sets at the threshold, a pair is ruled out if fewer agree in four
#: bits than the mean less so many deviations, which a linked pair does once in three million.
DEVIATIONS = 5
#: Words hashed together; keeps the arrays of the minima in a core's cache.
CHUNK_WORDS = 100_000

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_M = np.uint64(0x9E3779B97F4A7C15)
_K = np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words; bytes.split() splits at 0x20 and 0x09-0x0D."""
    return (text or b"").lower().split()


def shingle_set(ws: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `width` words; all words as one if there are fewer."""
    n = len(ws)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, n)
    if n < width:
        s = np.array([n], np.uint64) * _K
        for x in h:
            s = s * _M + x
    else:
        s = h[: n - width + 1].copy()
        for i in range(1, width):
            s *= _M
            s += h[i : n - width + 1 + i]
    s ^= s >> np.uint64(29)
    s *= _K
    s ^= s >> np.uint64(32)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """Of each nonempty set, the minimum under each of the hash functions."""
    x = np.concatenate(sets).astype(np.uint32)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), len(_A)), np.uint32)
    h = np.empty_like(x)
    for i, (a, b) in enumerate(zip(_A, _B, strict=True)):
        np.multiply(x, a, out=h)
        h += b
        out[:, i] = np.minimum.reduceat(h, at)
    return out


def _bands(m: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, its number included."""
    m = m[:, : BANDS * ROWS].reshape(len(m), BANDS, ROWS).astype(np.uint64)
    k = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _K, (len(m), 1))
    for r in range(ROWS):
        k = (k ^ m[:, :, r]) * _M
        k ^= k >> np.uint64(31)
    return k.view(np.int64)


def _packed(m: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, sixteen minima to a long."""
    four = (m >> np.uint32(28)).astype(np.uint64) ^ (m.astype(np.uint64) & np.uint64(15))
    four = four.reshape(len(m), -1, 16)
    return np.bitwise_or.reduce(four << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


_SIG = MINIMA // 16
#: Rows of a bucket that one task compares with as many others.
BUCKET_ROWS = 2000
#: Bytes of sets that are put into one Arrow batch, or compared from one, besides a single pair's.
SET_BYTES = 16 << 20

_SIGNED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64()))])
_SIGNED_DDL = "doc_id long, h long, n_shingles long, set_id binary, bands array<long>, sig array<long>"


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = batch.columns
            start, done = 0, 0
            sets: list[np.ndarray] = []
            for i in range(batch.num_rows):
                s = shingle_set(words(texts[i].as_py()), width)
                sets.append(s)
                done += len(s)
                if done >= CHUNK_WORDS or i == batch.num_rows - 1:
                    yield _signed(ids.slice(start, len(sets)), hashes.slice(start, len(sets)), sets)
                    start, done, sets = i + 1, 0, []

    return run


def _signed(ids: pa.Array, hashes: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    full = [i for i, s in enumerate(sets) if len(s)]
    n = len(sets)
    bands, sig = np.zeros((n, BANDS), np.int64), np.zeros((n, _SIG), np.int64)
    if full:
        m = _minima([sets[i] for i in full])
        bands[full], sig[full] = _bands(m), _packed(m)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
    digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
    return pa.RecordBatch.from_arrays([ids, hashes, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists(bands), lists(sig)], schema=_SIGNED)


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, shingles) of rows (node, text), in batches of bounded size."""
        made = lambda nodes, sets: pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["rep", "shingles"])
        for batch in batches:
            nodes, sets, size = [], [], 0
            for node, text in zip(*batch.columns, strict=True):
                nodes.append(node.as_py())
                sets.append(shingle_set(words(text.as_py()), width).tobytes())
                size += len(sets[-1])
                if size >= SET_BYTES:
                    yield made(nodes, sets)
                    nodes, sets, size = [], [], 0
            if nodes:
                yield made(nodes, sets)

    return run


def _fetched(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, shingles): the full sets of the wanted nodes (node, doc_id, h), one row each though texts repeat rows."""
    rows = texts.join(wanted, ["doc_id", "h"]).select("node", "text").dropDuplicates(["node"])
    return rows.mapInArrow(_full_sets(width), "rep long, shingles binary")


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            keep = []
            for i in range(batch.num_rows):
                p, q = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
                both = _common(p, q)
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([a, b], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _deltas(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pivot, rep, n, linked, delta): the symmetric difference of each document's set and its pivot's."""
        for batch in batches:
            pivots, reps, x, y = batch.columns
            n, linked, delta = [], [], []
            for i in range(batch.num_rows):
                p, q = (np.frombuffer(k[i].as_buffer(), np.uint64) for k in (x, y))
                d = np.setxor1d(p, q, assume_unique=True)
                n.append(len(p))
                linked.append((100 + percent) * len(d) <= (100 - percent) * (len(p) + len(q)))
                delta.append(d.view(np.int64))
            cols = [pivots, reps, pa.array(n, pa.int64()), pa.array(linked, pa.bool_()), pa.array(delta, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["pivot", "rep", "n", "linked", "delta"])

    return run


def _by_deltas(scratch: Scratch, deltas: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) among documents compared with one pivot: every linked pair across components is one.

    A pair is linked if its symmetric difference is at most r = (100 - percent) / (100 +
    percent) of the sum of its sizes. With both sets' differences from the pivot, A and B,
    it is |A| + |B| - 2 |A and B|, so the pair must share at least t of the differences;
    t is positive whenever b isn't linked to the pivot, which one of two documents in
    different components isn't. Components are those of all links to pivots. Of A's elements, put rarest in the B's first, the first
    |A| - t + 1 then hold a shared one. Edits of one's own are in no B, and so fill these
    places without a candidate: a family of copies that drift apart from one original
    makes few pairs.
    """
    r = (100 - percent) / (100 + percent)
    size = F.size("delta").cast("long")
    b = deltas.where("not linked").select("pivot", F.col("rep").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), size.alias("db"), F.explode("delta").alias("token"))
    often = scratch.table(b.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("often")), "often")
    a = deltas.select("pivot", F.col("rep").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), size.alias("da"), F.explode("delta").alias("token"))
    a = a.join(often, ["pivot", "token"], "left")
    place = F.row_number().over(Window.partitionBy("pivot", "a").orderBy(F.coalesce("often", F.lit(0)), "token")) - 1
    a = a.withColumn("place", place).where(F.col("often").isNotNull() & (F.col("place") <= F.col("da") * (1 + r) / 2))
    a = scratch.table(a, "places")
    t = F.ceil((F.col("da") + F.col("db") - r * (F.col("na") + F.col("nb"))) / 2 - 1e-6)
    met = a.alias("x").join(b.alias("y"), (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.token") == F.col("y.token")) & (F.col("ca") != F.col("cb")) & (F.col("place") <= F.col("da") - t))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _common(p: np.ndarray, q: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if not len(p) or not len(q):
        return 0
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    return int(np.count_nonzero(q[at] == p))


def _alike(a: str, b: str, percent: int) -> Column:
    """The sizes allow the similarity, and the packed signatures agree often enough."""
    ones = F.lit(0x1111111111111111)
    unequal = []
    for i in range(_SIG):
        x = F.col(f"{a}.sig")[i].bitwiseXOR(F.col(f"{b}.sig")[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        unequal.append(F.bit_count(x.bitwiseAND(ones)))
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    p = percent / 100 + (1 - percent / 100) / 16
    most = int(MINIMA * (1 - p) + DEVIATIONS * (MINIMA * p * (1 - p)) ** 0.5) + 1
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (reduce(lambda p, q: p + q, unequal) <= most)


def _numbered(scratch: Scratch, sets: DataFrame) -> DataFrame:
    """sets (set_id, doc_id, h) with rep, a number of its own: doc_id, but for further sets of one id, which get numbers that no id has."""
    least = sets.groupBy("doc_id").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most"))
    lo, hi, several = least.agg(F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("least") != F.col("most"))).first()
    if not several:
        return sets.withColumn("rep", F.col("doc_id"))
    further = scratch.table(sets.join(least.where("least <> most"), "doc_id").where("set_id <> least").select("set_id", F.lit(1).alias("one")), "further")
    order = [F.col("set_id").asc()]
    further = running_sum(in_order(scratch, further, order, "numbers"), order, "one", "n")
    free = F.lit(hi) + F.col("n") if hi < 1 << 62 else F.lit(lo) - F.col("n")
    return sets.join(further.select("set_id", free.alias("_rep")), "set_id", "left").withColumn("rep", F.coalesce("_rep", "doc_id")).drop("_rep")


def _split_pairs(live: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket's rows that are alike, in different components, and not both like their pivot.

    A bucket is cut into parts of BUCKET_ROWS rows on average, and each pair of parts is a
    key of its own, so that no task has all rows of a large bucket. Rows meet only where
    one of them isn't like the pivot.
    """
    parts = live.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).cast("int").alias("parts"))
    cut = live.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("rep", "key"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    some = ["key", "rep", "n_shingles", "sig", "starred", "c", "part"]
    x = cut.where("not starred").select(*some, every.alias("other")).alias("x")
    y = cut.select(*some, every.alias("other")).alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.other")) & (F.col("x.other") == F.col("y.part"))
    once = F.when(F.col("y.starred"), F.col("x.c") != F.col("y.c")).otherwise(F.col("x.c") < F.col("y.c"))
    met = x.join(y, same & once & _alike("x", "y", percent))
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Components of the graph of edges (u, v): rows (node, component), the smallest node naming each.

    Alternating large-star and small-star until a large-star pass leaves the edges as
    they are and no node has two smaller neighbours: only then are they stars. Minima and edges are written between the passes, so
    both sides of the joins are exchanged and a hub of any degree can be split. Every pair
    of passes takes edges to smaller nodes or ends, so no limit on their number is needed.
    A node without edges has no row.
    """
    sign = lambda t: t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = sign(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = scratch.table(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        scratch.drop(now, least)
        now = large
        if sign(large) == last and large.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
        # a node's smaller neighbours are few after a large-star pass
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = scratch.table(small.distinct(), "edges")
        scratch.drop(large)
        last = sign(now)
    stars = now.groupBy("v").agg(F.count(F.lit(1))).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, first) for each row of docs.

    kept marks the smallest id of each component, first the text of its smallest row (by
    id and text_hash, xxhash64 of the text), which is one row unless equal rows repeat.
    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle
    sets. See the module's text for nulls, ties and repeated rows. percent is 70 at least.
    """
    if not 70 <= percent <= 100:
        raise ValueError("percent must be from 70 to 100")
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("binary")).alias("h"), F.col(text_col).cast("binary").alias("text"))
    signed = scratch.table(texts.mapInArrow(_sign(width), _SIGNED_DDL), "signed")

    # a node for each distinct set, that of its smallest row
    some = signed.where("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "h"))
    sets = scratch.table(some.groupBy("set_id").agg(first.alias("f")).select("set_id", "f.*"), "sets")
    nodes = scratch.table(_numbered(scratch, sets), "nodes")  # set_id, doc_id, h, rep
    reps = some.join(nodes.select("set_id", "doc_id", "h", "rep"), ["set_id", "doc_id", "h"]).select("rep", "n_shingles", "sig", "bands")
    reps = scratch.table(reps.dropDuplicates(["rep"]), "reps")

    rows = reps.select("rep", F.explode("bands").alias("key"))
    sizes = scratch.table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
    rows = rows.join(sizes, "key").withColumn("weight", F.sum("m").over(Window.partitionBy("rep"))).select("key", "rep", "weight")
    rows = scratch.table(rows.join(reps.select("rep", "n_shingles", "sig"), "rep"), "rows")
    central = F.max_by(F.struct("rep", "n_shingles", "sig"), F.struct("weight", -F.col("rep")))
    pivots = scratch.table(rows.groupBy("key").agg(central.alias("p")), "pivots")

    # every document against the most central one of each of its buckets
    named = rows.alias("x").join(pivots.select("key", "p.*").alias("y"), F.col("x.key") == F.col("y.key"))
    alike = (F.col("x.rep") == F.col("y.rep")) | _alike("x", "y", percent)
    rows = scratch.table(named.select("x.key", "x.rep", "x.n_shingles", "x.sig", F.col("y.rep").alias("pivot"), alike.alias("starred")), "rows")
    star = scratch.table(rows.where("starred and rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "star")
    # the same plan at every size: the texts are exchanged by id, and this list of ids is never broadcast
    rows_of = nodes.select(F.col("rep").alias("node"), "doc_id", "h")
    wanted = star.select(F.col("a").alias("node")).union(star.select("b")).distinct().join(rows_of, "node").hint("merge")
    full = [scratch.table(_fetched(texts, wanted, width), "full")]

    def with_sets(pairs: DataFrame) -> DataFrame:
        both = reduce(DataFrame.union, full)
        p = pairs.join(both.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
        return p.join(both.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")

    deltas = with_sets(star).select("b", "a", "sa", "sb").mapInArrow(_deltas(percent), "pivot long, rep long, n long, linked boolean, delta array<long>")
    deltas = scratch.table(deltas, "deltas")
    links = deltas.where("linked").select(F.col("rep").alias("u"), F.col("pivot").alias("v"))
    comp = scratch.table(components(scratch, links), "comp")

    def labelled(df: DataFrame, col: str, out: str) -> DataFrame:
        c = comp.select(F.col("node").alias(col), F.col("component").alias("_c"))
        return df.join(c, col, "left").withColumn(out, F.coalesce("_c", col)).drop("_c")

    # the other pairs across components: of documents that both are like their bucket's pivot, by their differences
    # from it, and those of buckets where one isn't
    pairs = _by_deltas(scratch, labelled(deltas, "rep", "c"), percent)
    live = scratch.table(labelled(rows, "rep", "c"), "live")
    split = live.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.bool_and("starred").alias("all")).where("lo <> hi and not all").select("key")
    live = scratch.table(live.join(split, "key"), "live")
    others = _split_pairs(live, percent)
    pairs = pairs.union(others).distinct()
    pairs = scratch.table(pairs, "pairs")
    lacking = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct().join(full[0].select("rep"), "rep", "left_anti").withColumnRenamed("rep", "node")
    lacking = scratch.table(lacking.join(rows_of, "node"), "lacking")
    if not lacking.isEmpty():
        full.append(scratch.table(_fetched(texts, lacking, width), "full"))
    more = scratch.table(with_sets(pairs).select("a", "b", "sa", "sb").mapInArrow(_linked(percent), "u long, v long"), "links")
    if not more.isEmpty():
        comp = scratch.table(components(scratch, links.union(more)), "comp")

    # a component's name is its smallest id, and the first of its rows stands for it
    members = scratch.table(labelled(nodes, "rep", "c"), "members")
    named = members.groupBy("c").agg(F.min(F.struct("doc_id", "h")).alias("f"))
    named = scratch.table(named.select("c", F.col("f.doc_id").alias("component_id"), F.col("f.h").alias("first_h")), "named")
    members = scratch.table(members.select("set_id", "c").join(named, "c").select("set_id", "component_id", "first_h"), "classes")
    scratch.keep(signed, members)
    out = signed.select("doc_id", "h", "n_shingles", "set_id").join(members, "set_id", "left")
    within = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(within, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), F.col("h").alias("text_hash"), (~within | (kept & (F.col("h") == F.col("first_h")))).alias("first"))

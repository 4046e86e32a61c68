"""SimHash fingerprints of documents, in DataFrame operations only.

The terms of a text are its pairs of neighbouring words, lower-cased (the word alone, if
there is one); each occurrence votes with the bits of its 128-bit hash, so a term
weighs as often as it occurs. Votes are counted in sums of two 32-bit lanes over the
exploded terms, which needs no array of counters and no Python. A bit of the
fingerprint is set if more than half of the votes are for it.

Fingerprints within a Hamming radius are found by permuted block tables: the bits are
cut into radius + EXTRA_BLOCKS blocks, and for each choice of EXTRA_BLOCKS of them there
is a table keyed by those blocks; two fingerprints that differ in radius bits at most
agree on all blocks of some choice. Equal fingerprints are one row of the tables, and a
pair is made in the first table only in which it agrees.

Texts without a word have the fingerprint of all zeros, as have null texts, which count
as empty. Likeness is 1 less the share of differing bits. The next document in
descending order of the id is taken from range partitions; rows without id come last;
rows of one id are ordered by length and hash. Rows with equal id and text are counted,
handled once and repeated in the result. Texts of any length are read whole, an empty
table gives an empty result, and other columns are neither read nor returned.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_order

BITS = 128
#: Bits that near fingerprints differ in at most.
RADIUS = 3
_LANES = 0x100000001
EXTRA_BLOCKS = 2


def terms(text: Column) -> Column:
    """Hashes of the pairs of neighbouring words, in an array."""
    words = F.array_remove(F.split(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     "), " "), "")
    return F.transform(F.array(words), lambda w: F.when(F.size(w) < 2, F.transform(w, lambda a: F.xxhash64(a))).otherwise(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(a, b))))[0]


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, fp0, fp1): one row for each distinct key of texts; equal keys must have equal texts."""
    t = texts.select(*keys, F.explode_outer(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("t")).withColumn("u", F.xxhash64("t", F.lit(1)))
    sums = [F.sum(F.shiftrightunsigned(c, i).bitwiseAND(F.lit(_LANES))).alias(f"{c}{i}") for c in ("t", "u") for i in range(32)]
    votes = t.groupBy(*keys).agg(F.count("t").alias("_n"), *sums)

    def word(c: str) -> Column:
        out = F.lit(0).cast("long")
        for i in range(32):
            low, high = F.col(f"{c}{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"{c}{i}", 32)
            for bit, count in ((i, low), (i + 32, high)):
                one = (1 << bit) - (1 << 64 if bit == 63 else 0)
                out = out.bitwiseOR(F.when(2 * count > F.col("_n"), F.lit(one)).otherwise(F.lit(0).cast("long")))
        return out

    return votes.select(*keys, word("t").alias("fp0"), word("u").alias("fp1"))


def text_of(fp0: Column, fp1: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(x)), 16, "0") for x in (fp0, fp1)))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return 1 - distance(a0, a1, b0, b1) / float(BITS)


def within(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a0, a1, b0, b1, distance) of distinct fingerprints at most radius bits apart, each once.

    fps: any rows with fp0 and fp1; those that are null are left out. The rows of a
    fingerprint are its class; join on (fp0, fp1) for the members.
    """
    if not 0 < radius < 32:
        raise ValueError("radius must be from 1 to 31")
    one = fps.where("fp0 is not null and fp1 is not null").select("fp0", "fp1").distinct()
    blocks = radius + EXTRA_BLOCKS
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def masked(block: int, x0: Column, x1: Column) -> list[Column]:
        """What of a block is in each word, where it has bits there."""
        bits = sum(1 << b for b in range(edges[block], edges[block + 1]))
        return [x.bitwiseAND(F.lit(signed(m))) for x, m in ((x0, bits & (2**64 - 1)), (x1, bits >> 64)) if m]

    tables = list(combinations(range(blocks), EXTRA_BLOCKS))
    # a key's low bits are the number of its table, the others a hash of its blocks
    low = len(tables).bit_length()
    keys = [F.shiftleft(F.xxhash64(*(c for b in some for c in masked(b, F.col("fp0"), F.col("fp1")))), low).bitwiseOR(F.lit(n)) for n, some in enumerate(tables)]
    rows = one.select("fp0", "fp1", F.explode(F.array(*keys)).alias("key"))
    a = rows.select(F.col("fp0").alias("a0"), F.col("fp1").alias("a1"), "key")
    b = rows.select(F.col("fp0").alias("b0"), F.col("fp1").alias("b1"), F.col("key").alias("l"))
    table = F.col("key").bitwiseAND(F.lit((1 << low) - 1))
    d = distance(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))
    less = (F.col("a0") < F.col("b0")) | ((F.col("a0") == F.col("b0")) & (F.col("a1") < F.col("b1")))
    x0, x1 = F.col("a0").bitwiseXOR(F.col("b0")), F.col("a1").bitwiseXOR(F.col("b1"))
    agree = [reduce(lambda p, q: p & q, [c == 0 for c in masked(k, x0, x1)]) for k in range(blocks)]
    # of a pair's agreeing blocks the first ones name its table; keys that are equal by chance agree in none
    first = F.lit(-1).cast("long")
    for n, some in reversed(list(enumerate(tables))):
        first = F.when(reduce(lambda p, q: p & q, [agree[k] for k in some]), F.lit(n).cast("long")).otherwise(first)
    return a.join(b, (F.col("key") == F.col("l")) & less & (d <= radius) & (table == first)).select("a0", "a1", "b0", "b1", d.alias("distance"))


def near_counts(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp0, fp1, n_near) of the fingerprints with others within radius: how many."""
    pairs = within(fps, radius)
    ends = F.array(F.struct(F.col("a0").alias("fp0"), F.col("a1").alias("fp1")), F.struct(F.col("b0").alias("fp0"), F.col("b1").alias("fp1")))
    return pairs.select(F.explode(ends).alias("e")).groupBy("e.fp0", "e.fp1").agg(F.count(F.lit(1)).alias("n_near"))


def following(scratch: Scratch, ids: DataFrame) -> DataFrame:
    """ids (doc_id, h, n_chars): with next_id and next_h, of the row after in descending order of doc_id, the last one's the first."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("n_chars").asc(), F.col("h").asc()]
    rows = in_order(scratch, ids, order, "ids")
    here = F.struct("doc_id", "h")
    first = rows.groupBy("_part").agg(F.min_by(here, F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), "n_chars", "h")).alias("first"))
    # one row a partition: what begins the next one that has rows, after the last the very first
    start = first.select(F.col("_part").alias("_p"), F.coalesce(F.lead("first").over(Window.orderBy("_part")), F.first("first").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_start"))
    rows = rows.withColumn("_next", F.lead(here).over(Window.partitionBy("_part").orderBy(*order)))
    rows = rows.join(F.broadcast(start), F.col("_part") == F.col("_p"), "left").withColumn("_next", F.coalesce("_next", "_start"))
    return rows.select(*ids.columns, F.col("_next.doc_id").alias("next_id"), F.col("_next.h").alias("next_h"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as
    many, or all, of the next document in descending order of the id. n_near counts the
    other fingerprints of the table within RADIUS bits, found by the block tables.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    facts = texts.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("copies"), F.min(F.char_length("text")).alias("n_chars"))
    facts = scratch.table(following(scratch, scratch.table(facts, "facts")), "next")
    own = scratch.table(fingerprints(texts, ["doc_id", "h"]), "own")

    # both joins take the same exchange of the texts, by keys without nulls; only what the edited text needs of the next document moves again
    key = lambda c: (F.coalesce(c, F.lit(0)), F.isnull(c))
    keyed = texts.select(key("doc_id")[0].alias("k"), key("doc_id")[1].alias("no"), "h", "text")
    needs = facts.select(key("next_id")[0].alias("k"), key("next_id")[1].alias("no"), F.col("next_h").alias("h"), key("doc_id")[0].alias("to_k"), key("doc_id")[1].alias("to_no"), F.col("h").alias("to_h"), F.floor(F.col("n_chars") / 2).cast("int").alias("take"))
    lent = keyed.join(needs, ["k", "no", "h"]).select(F.col("to_k").alias("k"), F.col("to_no").alias("no"), F.col("to_h").alias("h"), F.substring("text", F.lit(1), F.col("take")).alias("lent"))
    lent = lent.dropDuplicates(["k", "no", "h"])  # rows that repeat lend once
    n = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), "lent")
    both = keyed.join(lent, ["k", "no", "h"]).select(F.when(~F.col("no"), F.col("k")).alias("doc_id"), "h", edited.alias("text"))
    both = both.withColumn("sha", F.sha2("text", 256))
    changed = scratch.table(fingerprints(both, ["doc_id", "h", "sha"]).dropDuplicates(["doc_id", "h"]), "edited")

    scratch.keep(facts, own, changed)

    def named(t: DataFrame, p: str) -> DataFrame:
        return t.select(F.col("doc_id").alias(f"{p}_i"), F.col("h").alias(f"{p}_h"), *(F.col(c).alias(f"{p}_{c}") for c in t.columns if c not in ("doc_id", "h")))

    out = facts
    for t, p, keys in ((own, "own", ("doc_id", "h")), (changed, "edit", ("doc_id", "h")), (own, "then", ("next_id", "next_h"))):
        out = out.join(named(t, p), F.col(keys[0]).eqNullSafe(F.col(f"{p}_i")) & (F.col(keys[1]) == F.col(f"{p}_h")), "left")
    near = near_counts(own).select(F.col("fp0").alias("n_0"), F.col("fp1").alias("n_1"), "n_near")
    out = out.join(near, (F.col("own_fp0") == F.col("n_0")) & (F.col("own_fp1") == F.col("n_1")), "left")
    fp = lambda p: (F.col(f"{p}_fp0"), F.col(f"{p}_fp1"))
    out = out.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.col("edit_sha").alias("edited_sha256"), text_of(*fp("own")).alias("fingerprint"), text_of(*fp("edit")).alias("edited_fingerprint"),
        likeness(*fp("own"), *fp("edit")).alias("near_edited"), likeness(*fp("own"), *fp("then")).alias("near_next"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"),
    )
    return out.drop("_copy")

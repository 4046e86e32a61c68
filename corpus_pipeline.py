"""A training corpus from `documents`: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidering.llm import bpe, langid, minhash, mixing, pii
from tidering.llm.common import Scratch, fold

# Every stage takes nulls in any column, empty and very long texts, repeated rows, empty
# tables and further columns, which it leaves behind; its docstring says what becomes of them.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without a letter, and those too far from every language; lang becomes the predicted one.

    Learns from the rows outside fold 0 that carry a language. Null and empty texts have no
    letter and go; rows without id are held out of learning and stay by their text; rows
    that repeat are judged each.
    """
    model = langid.fit(docs.where(fold(F.col("doc_id")) != 0))
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs.withColumn("_own", F.col("text")), model, keep=["doc_id", "_own", "source", "n_chars"])
    return found.where("not rejected").select("doc_id", F.col("_own").alias("text"), F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, similarity 0.8): the row of the smallest id.

    Rows are documents: of rows that repeat an id, each goes or stays by its own text, so no
    text is lost with another one's. Of equal rows one stays, with the least lang, source
    and n_chars. Rows without id and texts without a word are linked with nothing and stay.
    """
    scratch = Scratch(spark, "near_dedup")
    marked = minhash.near_duplicates(docs.select("doc_id", "text")).where("doc_id is not null and n_shingles > 0")
    rows = marked.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).agg(F.bool_or("first").alias("_first"), (F.count(F.lit(1)) > 1).alias("_again"))
    # only rows that go or repeat: the others need no entry
    told = scratch.table(rows.where("not _first or _again"), "told")
    # the same plan at every size: documents and entries are exchanged, entries are never broadcast
    told = told.hint("merge")
    joined = docs.select(*COLUMNS).withColumn("_t", F.xxhash64(F.col("text").cast("binary"))).join(told, (F.col("doc_id") == F.col("_id")) & (F.col("_t") == F.col("_h")), "left")
    out = joined.where("_id is null").select(*COLUMNS)
    if told.where("_first and _again").isEmpty():
        return out
    rest = F.min(F.struct("lang", "source", "n_chars", "text")).alias("r")
    again = joined.where("_first and _again").groupBy("doc_id", "_t").agg(rest).select("doc_id", "r.*")
    return out.unionByName(again)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by the name of their kind; n_chars is that of the new text.

    Every row stays, each by itself. A null text stays null, with n_chars 0.
    """
    out = pii.redacted(docs, keep=["doc_id", "lang", "source"])
    return out.select("doc_id", "text", "lang", "source", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their targets: a document is there as often as the mix takes it.

    One without a word (null and empty texts) has nothing to be taken and goes. Rows without
    id, and rows that repeat one, are found again by their texts; equal rows share out what
    they get. Null sources are a source.
    """
    scratch = Scratch(spark, "mixture")
    key = {"_i": F.coalesce("doc_id", F.lit(0)), "_n": F.isnull("doc_id"), "_s": F.coalesce("source", F.lit("")), "_m": F.isnull("source")}
    taken = mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), seed="corpus").withColumns(key)
    on = [*key, "_t"]
    taken = taken.groupBy(*key, F.col("text_hash").alias("_t")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    taken = scratch.table(taken.where("_copies > 0"), "taken")
    joined = docs.select(*COLUMNS).withColumns(key | {"_t": F.xxhash64("text")}).join(taken, on)
    out = joined.where("_rows = 1").select(*COLUMNS, "_copies")
    if not taken.where("_rows > 1").isEmpty():
        rest = F.min(F.struct("doc_id", "text", "lang", "source", "n_chars")).alias("r")
        out = out.unionByName(joined.where("_rows > 1").groupBy(*on).agg(rest, F.first("_copies").alias("_copies")).select("r.*", "_copies"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids): token ids as packed little-endian unsigned 32-bit integers; texts that don't decode to themselves fail.

    Every row is encoded, each by itself; a null text counts as empty and has no tokens.
    """
    import public_tokenizers

    docs = docs.withColumn("_bytes", F.sha2("text", 256))
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "_bytes"])
    same = F.sha2("decoded", 256) == F.coalesce("_bytes", F.sha2(F.lit(""), 256))
    ids = F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("decoding does not give the text back")).cast("binary"))
    return out.select("doc_id", "lang", "source", "n_tokens", ids.alias("ids"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: The stages train and tokenise, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over `documents`."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

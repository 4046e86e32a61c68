"""All queries and stages over tables with nulls everywhere, empty and very long texts, ties, repeated rows and clashing names, and over empty ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidering.llm import mixing, queries

EXTRA = ["h", "rep", "score", "_text", "row", "key", "size", "taken", "held_out", "fp0", "spans", "line", "_copy", "_t", "_id", "copies", "first", "lang_pred", "n_tokens", "kept", "id", "v", "_h", "place", "text_hash", "_part", "upto", "rank", "target", "ids", "decoded", "predicted", "n"]
DOCUMENTS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
WORDS = {"en": "the and of thing with that other people water", "de": "der und nicht ein Wasser mit Leute auch zwischen", "fr": "le et une chose avec autre eau monde entre"}


def odd_rows():
    r = random.Random(3)
    say = lambda lang, n=40: " ".join(r.choice(WORDS[lang].split()) + r.choice(["", "", ".", str(r.randrange(9))]) for _ in range(n))
    rows = [(i, say(lang := r.choice(sorted(WORDS))), lang, r.choice(["s0", "s1", "s2"])) for i in range(60)]
    first = rows[5]
    rows += [first, first, (first[0], say("en"), "en", "s1"), (first[0], rows[7][1], "fr", None)]  # repeated rows, and its id with other texts
    rows += [(70, rows[9][1] + " end", None, "s0"), (71, rows[9][1], None, None), (None, say("de"), "de", "s0"), (None, rows[11][1], "en", None), (None, rows[11][1], "en", None), (None, None, None, None)]
    rows += [(80, None, "en", "s0"), (81, "", "de", None), (82, "   \n\t", None, "s2"), (83, "x", None, "s2"), (84, "1234 !!", "fr", "s1"), (85, say("en", 60_000), "en", "s1"), (86, "word" * 100_000, None, "s0"), (87, "idiot mail a@b.cd token = \"4e917b853860886599b2ac757f8290996dd9de57\" \U0001f642", "en", "s2")]
    return [(i, t, lang, s, None if t is None or i == 83 else len(t)) for i, t, lang, s in rows]


def tables(spark, path, rows, extra):
    d = spark.createDataFrame(rows, DOCUMENTS)
    vectors = [(i, [float(i % 5), 1.0, -0.5 * (i % 3)]) for i in range(45)] + [(20, [1.0, 1.0, 1.0]), (20, [1.0, 1.0, 1.0]), (None, [1.0]), (46, None), (47, [float("nan")]), (48, [None, 1.0]), (60, [])]
    talks = [(1, 0, "user", "hi"), (1, 1, None, None), (2, 0, "user", "hi"), (None, 0, "user", "x"), (3, 0, "user", "hi"), (3, 0, "user", "hi"), (4, None, "user", "long " * 50_000)]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 60, 2)] + [(2, 0, 1), (None, 1, 1), (999, 1, 1), (5, None, None)]
    if not rows:
        vectors, talks, labels = [], [], []
    made = {
        "documents": d, "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), "conversations": spark.createDataFrame(talks, "conv_id long, turn long, role string, text string"), "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    }
    for name, df in made.items():
        for n, c in enumerate(extra):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(n) if n % 2 else F.lit("odd"))
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd") / "t", odd_rows(), EXTRA)


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("plain") / "t", odd_rows(), [])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty") / "t", [], EXTRA)


COLUMNS = {
    "op1_minhash_near_dedup": "doc_id n_shingles component_id kept", "op2_byte_level_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op3_toxicity": "doc_id held_out score predicted", "op4_language_id": "doc_id held_out lang_pred score",
    "op5_exact_top_k": "query_id rank vec_id score", "op6_chat_formatting": "conv_id n_turns n_copies rendered", "op7_license_scan": "doc_id n_paragraphs families", "op8_simhash": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op10_mixing": "doc_id size source_size target taken",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_names_of_other_columns_change_nothing(spark, odd, plain, empty, name):
    query = queries.queries()[name]
    got = query(spark, odd)
    wanted = COLUMNS[name].split()
    assert got.columns[: len(wanted)] == wanted
    rows = sorted(map(str, got.collect()))
    assert rows == sorted(map(str, query(spark, plain).collect())) and rows
    if name not in ("op5_exact_top_k", "op6_chat_formatting", "op7_license_scan"):
        assert len(rows) == len(odd_rows())  # a row for each, repeats and nulls included
    assert query(spark, empty).count() == 0


def stage(name):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name]


BACK = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark, path):
    return spark.read.parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize("name", ["language", "near_dedup", "personal_data", "mixture", "tokens"])
def test_stages(spark, odd, plain, empty, name):
    got = stage(name)(spark, documents(spark, odd), odd)
    assert got.columns == (BACK if name != "tokens" else ["doc_id", "lang", "source", "n_tokens", "ids"])
    assert sorted(map(str, got.collect())) == sorted(map(str, stage(name)(spark, documents(spark, plain), plain).collect()))
    assert stage(name)(spark, documents(spark, empty), empty).count() == 0


def test_language_keeps_what_has_a_language(spark, odd):
    got = stage("language")(spark, documents(spark, odd), odd).collect()
    texts = [t for _, t, *_ in odd_rows() if t and any(map(str.isalpha, t))]
    assert all(r["text"] in texts for r in got) and sum(r["doc_id"] is None for r in got) == 3 and len(got) >= len(texts) - 3


def test_near_dedup_loses_no_text_and_keeps_one_of_each_group(spark, odd):
    got = stage("near_dedup")(spark, documents(spark, odd), odd).collect()
    with_id = [r for r in got if r["doc_id"] is not None]
    texts = [r["text"] for r in with_id if (r["text"] or "").split()]
    rows = odd_rows()
    near = rows[64][1]  # the copy of row 9's text with a word more
    assert len(texts) == len(set(texts)) and set(texts) == {t for i, t, *_ in rows if i is not None and (t or "").split() and t != near}
    assert sorted(r["doc_id"] for r in with_id if not (r["text"] or "").split()) == [80, 81, 82]
    assert sum(r["doc_id"] is None for r in got) == 4  # rows without id are linked with nothing
    again = next(r for r in with_id if r["text"] == rows[7][1])
    assert (again["doc_id"], again["source"]) == (5, None)  # the smallest id that has the text


def test_mixture_takes_what_mix_takes(spark, odd):
    d = documents(spark, odd)
    got = stage("mixture")(spark, d, odd)
    words = mixing.size_of(F.col("text"))
    by = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum(words).alias("n")).collect()}
    taken = mixing.mix(d, spark.read.parquet(f"{odd}/labels.parquet"), seed="corpus").groupBy("source").agg(F.sum("taken").alias("n")).where("n > 0")
    assert by == {r["source"]: r["n"] for r in taken.collect()}
    assert None in by and got.where("doc_id is null").count() > 0


def test_personal_data_and_tokens_keep_every_row(spark, odd):
    d = documents(spark, odd)
    clean = stage("personal_data")(spark, d, odd)
    assert clean.count() == d.count() and clean.where("text is null").count() == 2
    assert clean.where("doc_id = 87").first()["text"] == "idiot mail <EMAIL> token = \"<SECRET>\" \U0001f642"
    made = {(r["doc_id"], r["n_tokens"]) for r in stage("tokens")(spark, d, odd).collect()}
    assert (80, 0) in made and (81, 0) in made and (None, 0) in made and stage("tokens")(spark, d, odd).count() == d.count()


def test_the_whole_pipeline(spark, odd, empty):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, odd)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and out.count() > 50
    assert corpus_pipeline.run(spark, empty).count() == 0

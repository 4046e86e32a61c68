from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidering.llm import common, langid, toxicity

DATA, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_folds(spark):
    rows = spark.range(50).select("id", common.fold(F.col("id")).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)
    assert spark.range(1).select(common.fold(F.lit(None).cast("long"))).first()[0] == 0


def test_languages_held_out(spark):
    import os

    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    d = common.documents(spark, DATA)
    got = langid.identify_documents(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == d.count() and {r["lang_pred"] for r in got} <= {"en", "de", "fr", "es"}
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert sum(r["rejected"] for r in got) / len(got) < 0.01 and all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_odd_rows(spark, docs):
    r = random.Random(1)
    say = lambda some: " ".join(r.choice(some) for _ in range(60))
    rows = [(i, say(["the", "and", "thing"]) if i % 2 else say(["der", "und", "ich"]), "en" if i % 2 else "de", "s") for i in range(60)]
    odd = [(100, None, "en", "s"), (101, "", None, None), (102, "12 34 !?", "de", "s"), (103, "the and thing " * 20000, None, None), (None, "the and thing", "en", "s"), (104, "漢字かな" * 50, None, None), (60, "der und ich", None, None)]
    d = docs(rows + odd).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    got = {x["doc_id"]: x for x in langid.identify_documents(d).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103, None, 60)] == ["und", "und", "und", "en", "en", "de"]
    assert got[100]["rejected"] and got[102]["rejected"] and got[104]["rejected"] and not got[103]["rejected"]
    none = langid.identify_documents(docs(["abc", "1"])).collect()
    assert {x["lang_pred"] for x in langid.identify_documents(docs([(0, "abc", None, None), (1, "1", None, None)])).collect()} == {"und"} and len(none) == 2
    assert langid.identify_documents(docs([])).count() == 0


def test_prediction_equals_brute_force():
    """N-grams hashed and weighed one by one in plain Python, and cosines with every centroid by loops."""
    import math

    r = random.Random(4)
    m32 = lambda x: x & 0xFFFFFFFF
    c = [int(x) for x in langid._C]

    def vector(text, idf):
        h = [m32((ord(ch) + 1) * c[0]) for ch in " " + text.lower() + " "]
        n = {}
        for x in h:
            n[x >> 20] = n.get(x >> 20, 0) + 1
        for i in range(len(h)):
            g = h[i]
            for k in (1, 2):
                if i + k < len(h):
                    g = m32(m32((g ^ (g >> 15)) * c[k]) + h[i + k])
                    b = m32(g * c[0]) >> 20
                    n[b] = n.get(b, 0) + 1
        v = {b: math.log1p(x) * float(idf[b]) for b, x in n.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {b: x / size for b, x in v.items()}

    rng = np.random.default_rng(3)
    centroids = rng.random((5, langid.DIMS)).astype(np.float32)
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    model = langid.Model(["de", "en"], rng.random(langid.DIMS).astype(np.float32) + 0.5, centroids, np.array([0, 0, 1, 1, 1]), np.array([0.3, 0.3]))
    for _ in range(60):
        text = "".join(r.choice("abcdeé ÄÖ漢.🎉") for _ in range(r.randrange(1, 60))) + "x"
        v = vector(text, model.idf)
        best = [max(sum(x * float(centroids[k][b]) for b, x in v.items()) for k in range(5) if model.owner[k] == lang) for lang in (0, 1)]
        lang, score, cosine, rejected = model.predict(text)
        k = int(best[1] > best[0])
        assert abs(cosine - best[k]) < 1e-4 and rejected == (best[k] < 0.3) or abs(best[k] - 0.3) < 1e-4
        assert lang == ["de", "en"][k] or abs(best[0] - best[1]) < 1e-4
        assert abs(score - 1 / sum(math.exp((x - best[k]) / 0.05) for x in best)) < 1e-2


def test_kmeans_keeps_unit_centroids():
    x = np.random.default_rng(1).random((40, 9)).astype(np.float32)
    c = langid.clustered(x / np.linalg.norm(x, axis=1, keepdims=True), 4)
    assert np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5) and 1 <= len(c) <= 4


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    r = random.Random(6)
    terms = ["idiot", "trash", "worthless", "scum", "pathetic", "loser", "idol"]
    m = toxicity.Matcher(terms)
    for _ in range(4000):
        w = list(r.choice(terms))
        for _ in range(r.randrange(4)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randrange(2)] = r.choice(["", "a", "t", "s", "o"])
        word = "".join(w)
        if not word.isalpha():
            continue
        near = [(d, t) for t in terms if (d := _distance(word, t)) <= toxicity.edits(t)]
        got = m.find(word)
        assert (got is None) == (not near) and (got is None or got == (min(near)[1], min(near)[0])), (word, got, near)


def test_stems_substitutes_and_quotation():
    m = toxicity.Matcher(["idiot", "réeu*", "exact"], exact=["exact"])
    assert m.find("réeuxment,") == ("réeu*", 0) and m.find("réeu") is None and m.find("1d10t!")[0] == "idiot" and m.find("exakt") is None
    said = 'he said "you are an idiot" to me'.split()
    assert toxicity.signs(said, said.index('idiot"'), 0, True) == (1, 0, 0, 1, 1, 1, 1, 0) and toxicity.signs("you are an idoit and more".split(), 3, 1, True) == (1, 1, 0, 0, 0, 0, 0, 1)
    assert toxicity.hits(None, m) == {}


def test_score_equals_brute_force():
    """Hits by plain edit distance over the lexicon, and the score by hand."""
    import math

    terms = {"idiot": 4.0, "worthless": 2.5, "scum": 3.0, "loser": 1.5}
    model = toxicity.Model(terms, ["losers"], frozenset({"worthless"}), np.array([2.2, -0.4, -1.1, -0.3, -0.6, -1.7, -1.2, -2.5]), np.array([-3.0, 2.0]))
    matcher = model.matcher()
    r = random.Random(3)
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for _ in range(300):
        words = [r.choice([*terms, "idoit", "wothless", "losr", "losers", "scums", "he", "said", "so", "home", "table"]) for _ in range(r.randrange(1, 30))]
        words = [('"' if r.random() < 0.15 else "") + w + ('"' if r.random() < 0.15 else "") for w in words]
        best: dict = {}
        for i, own in enumerate(words):
            w = own.strip('"')
            near = [(d, t) for t in terms if (d := _distance(w, t)) <= toxicity.edits(t) and not (d and w == "losers")]
            if not near:
                continue
            d, t = min(near)
            before, after = words[max(0, i - 8) : i], words[i + 1 : i + 9]
            opened, closed = own.startswith('"') or '"' in "".join(before), own[1:].endswith('"') or '"' in "".join(after)
            said = "said" in [x.strip('"') for x in before[-4:] + after[:4]]
            c = model.context
            z = c[0] + (d == 1) * c[1] + (d == 2) * c[2] + opened * c[3] + closed * c[4] + (opened and closed) * c[5] + said * c[6] + (d > 0 and t == "worthless") * c[7]
            best[t] = max(best.get(t, 0), sigmoid(z))
        want = sigmoid(-3.0 + 2.0 * math.log2(1 + sum(terms[t] * a for t, a in best.items())))
        assert abs(model.score(model.hits(" ".join(words).upper() if r.random() < 0.3 else " ".join(words), matcher)) - want) < 1e-9


def _tables(spark, path):
    import os

    if not os.path.isdir(path):
        pytest.skip("no tables here")
    return common.documents(spark, path), spark.read.parquet(f"{path}/labels.parquet")


@pytest.fixture(scope="module")
def tables(spark):
    return _tables(spark, DATA)


@pytest.fixture(scope="module")
def larger(spark):
    """Documents, labels, and a model from what may be learnt."""
    d, labels = _tables(spark, LARGER)
    return d, labels, toxicity.fit(d, labels.where(common.fold(F.col("doc_id")) != 0))


def test_misspelt_and_quoted_words_of_held_out_rows_move_the_score(larger):
    """In held-out toxic rows, misspelling the terms takes little from the score; quoting and reporting them takes much."""
    d, labels, model = larger
    matcher = model.matcher()
    rows = d.join(labels.where("toxic = 1"), "doc_id").where(common.fold(F.col("doc_id")) == 0).collect()
    terms = [t for t in model.terms if toxicity.edits(t) and t not in model.loose]
    assert len(terms) >= 5
    as_is, misspelt, quoted, without = [], [], [], []
    for row in rows:
        words = row["text"].lower().split()
        at = [i for i, w in enumerate(words) if (h := matcher.find(w)) and h[0] in terms and h[1] == 0]
        if not at or not 0 < len(words) < 400:
            continue

        def changed(f, words=words, at=at):
            return model.score(model.hits(" ".join(f(w) if i in at else w for i, w in enumerate(words)), matcher))

        as_is.append(changed(lambda w: w))
        misspelt.append(changed(lambda w: w[:2] + w[3:]))
        quoted.append(changed(lambda w: f'he said "{w}" '))
        without.append(changed(lambda w: "so"))
    assert len(as_is) >= 20
    mean = lambda x: sum(x) / len(x)
    assert mean(misspelt) > mean(without) + 0.5 * (mean(as_is) - mean(without))
    assert mean(quoted) < mean(as_is) - 0.2 * (mean(as_is) - mean(without))


def test_what_is_learnt_does_not_depend_on_partitions(spark, tables):
    d, labels = tables
    models = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            models.append(toxicity.fit(d.repartition(n), labels))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    a, b = models
    assert (a.terms, a.innocent, a.loose, a.context.tolist(), a.weights.tolist()) == (b.terms, b.innocent, b.loose, b.context.tolist(), b.weights.tolist())


def test_toxicity_held_out(larger):
    d, labels, model = larger
    rows = d.select("doc_id", (common.fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    got = toxicity.score(rows, model, keep=["doc_id", "held_out"]).join(labels, "doc_id").collect()
    p, q = ([r["score"] for r in got if r["toxic"] == k and r["held_out"]] for k in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q)) > 0.95
    assert sum(x >= 0.5 for x in q) / len(q) < 0.05


def test_toxicity_of_odd_rows(spark, docs):
    d = docs([(1, None, None, None), (2, "", None, None), (3, "word " * 50000, None, None), (None, "x", None, None), (3, "word " * 50000, None, None)])
    none = spark.createDataFrame([(None, 1), (1, None), (99, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(d, none).collect()
    assert len(got) == 5 and len({r["score"] for r in got}) == 1 and {r["predicted"] for r in got} == {0}
    assert toxicity.score_documents(docs([]), none).count() == 0


@pytest.mark.parametrize("times", [1, 8])
def test_innocent_words_near_a_term_leave_its_misspellings(spark, docs, times):
    words = "river stone cloud table light green sugar paper music metal".split()
    said = lambda i, extra: (i, " ".join([*(words[(i * k + k) % 10] + str(i) for k in range(1, 7)), extra]), "en", "s")
    n = 60 * times
    rows = [said(i, "pathetic") for i in range(n)] + [said(n + i, "atheti" if i % 10 == 0 else "today") for i in range(n)]
    labels = spark.createDataFrame([(i, int(i < n)) for i in range(2 * n)], "doc_id long, toxic int")
    model = toxicity.fit(docs(rows), labels)
    find = toxicity.Matcher(model.terms, innocent=model.innocent).find
    assert "pathetic" in model.terms and model.innocent == ["atheti"]
    assert find("atheti") is None
    assert find("pthetic") == find("paethetic") == ("pathetic", 1)

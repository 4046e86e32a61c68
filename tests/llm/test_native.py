"""Fingerprints, mixing and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from tidering.llm import common, mixing, simhash
from tidering.llm.common import Scratch


def _rows(docs, rows):
    return docs(rows).select("doc_id", "text")


def test_edited_texts_and_fingerprints(spark, docs, sf):
    d = common.documents(spark, sf).select("doc_id", "text").unionByName(_rows(docs, [(5000, None, None, None), (5001, "", None, None), (5002, "x", None, None), (None, "no id here", None, None), (-4, "é🙂é " * 3000, None, None)]))
    rows = [(r["doc_id"], r["text"] or "") for r in d.collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = {r["doc_id"]: r for r in simhash.compare_edited(d).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        after, half = order[(k + 1) % len(order)], len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        bits = [int(got[x]["fingerprint"], 16) for x in (i, after[0])]
        assert r["near_next"] == 1 - bin(bits[0] ^ bits[1]).count("1") / 128
        assert r["near_edited"] == 1 - bin(bits[0] ^ int(r["edited_fingerprint"], 16)).count("1") / 128
    same: dict[str, set] = {}
    for i, text in rows:
        same.setdefault(text, set()).add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())
    long = [r for r in got.values() if r["n_chars"] > 400]
    assert sum(r["near_edited"] > r["near_next"] for r in long) / len(long) > 0.97


def _votes(text: str) -> int:
    """The fingerprint by counting the votes for each bit: of the pairs of neighbouring words, XXH64 chained as Spark does."""
    import struct

    import xxhash

    h = lambda data, seed: xxhash.xxh64_intdigest(data, seed=seed)
    words = text.lower().split(" ")
    pairs = [(a, b) for a, b in zip(words, words[1:], strict=False)] or [(words[0],)]
    n = [0] * 128
    for p in pairs:
        t = 42
        for w in p:
            t = h(w.encode(), t)
        u = h(struct.pack("<i", 1), h(struct.pack("<Q", t), 42))
        for bit in range(128):
            n[bit] += (t if bit < 64 else u) >> (bit % 64) & 1
    bits = [2 * x > len(pairs) for x in n]
    return sum(b << (63 - k if False else k) for k, b in enumerate(bits[:64])) << 64 | sum(b << k for k, b in enumerate(bits[64:]))


def test_bits_equal_plain_votes_and_near_ones_are_counted(docs):
    r = random.Random(12)
    words = "one two three four five six seven eight nine ten".split()
    texts = [" ".join(r.choice(words) for _ in range(r.choice([1, 2, 5, 60]))) for _ in range(30)]
    long_ = [" ".join(r.choice(words) + str(r.randrange(50)) for _ in range(3000)) for _ in range(3)]
    texts += [t.replace("one1 ", "two2 ", k) for t in long_ for k in range(6)] + texts[:5]
    got = simhash.compare_edited(docs(texts)).collect()
    want = {i: _votes(t) for i, t in enumerate(texts)}
    assert {x["doc_id"]: int(x["fingerprint"], 16) for x in got} == want
    some = set(want.values())
    assert all(x["n_near"] == sum(0 < bin(want[x["doc_id"]] ^ f).count("1") <= simhash.RADIUS for f in some) for x in got)
    assert any(x["n_near"] > 1 for x in got)


def test_repeated_rows_and_none(docs):
    rows = [(1, "a b c", None, None)] * 3 + [(2, "d e f", None, None)] * 4 + [(2, "d e g", None, None)]
    got = simhash.compare_edited(docs(rows)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 1, 2, 2, 2, 2, 2]
    odd = docs(rows).selectExpr("*", "'x' as h", "1 as fp0", "2 as lent", "3 as next_id", "4 as copies")
    assert sorted(map(tuple, simhash.compare_edited(odd).collect())) == sorted(map(tuple, got))
    assert simhash.compare_edited(docs([])).count() == 0


def test_block_tables_find_every_pair(spark):
    r = random.Random(3)
    word = lambda x: x - (1 << 64) if x >> 63 else x
    base = [r.getrandbits(128) for _ in range(12)]
    some = base + [b ^ sum(1 << k for k in r.sample(range(128), r.randrange(0, 7))) for b in base for _ in range(6)]
    df = spark.createDataFrame([(word(x & (2**64 - 1)), word(x >> 64)) for x in some] + [(None, 1)], "fp0 long, fp1 long")
    got = {frozenset(((p["a0"], p["a1"]), (p["b0"], p["b1"]))): p["distance"] for p in simhash.within(df, 3).collect()}
    keys = {(word(x & (2**64 - 1)), word(x >> 64)): x for x in some}
    want = {frozenset((a, b)): d for a, x in keys.items() for b, y in keys.items() if a < b and (d := bin(x ^ y).count("1")) <= 3}
    assert got == want
    with pytest.raises(ValueError):
        simhash.within(df, 0)


def _targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, todo = 1.5 * sum(sizes.values()), {}, set(names)
    while todo:
        level = left / sum(weight[s] for s in todo)
        full = {s for s in todo if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in todo}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        todo -= full
    return out


def _check_mix(rows, got):
    sizes: dict = {}
    most: dict = {}
    for i, text, _, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source], most[source] = sizes.get(source, 0) + n, max(most.get(source, 0), n)
    want, taken = _targets(sizes), dict.fromkeys(sizes, 0)
    by = {i: source for i, _, _, source in rows}
    for r in got:
        s = by[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1 for s in sizes)


def test_mix(spark, docs):
    r = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(r.randrange(60))) if i % 9 else None, "en", r.choice(["b", "b", "b", "a", "é", "Z", None, ""])) for i in range(900)] + [(2000, "w\x1cw w w\tw", "en", "only"), (2001, "", "en", "nothing")]
    quality = spark.createDataFrame([(i, i % 2) for i in range(0, 900, 3)] + [(None, 1), (0, None)], "doc_id long, quality int")
    d = docs(rows).withColumnRenamed("lang", "key").withColumnRenamed("n_chars", "size")
    got = mixing.mix(d, quality).collect()
    assert len(got) == len(rows)
    _check_mix(rows, got)
    again = mixing.mix(d.repartition(3), quality).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(docs([])).count() == 0
    (one,) = mixing.mix(docs([(1, None, None, None)])).collect()
    assert (one["size"], one["target"], one["taken"]) == (0, 0.0, 0)


def test_prefix_sums_over_range_partitions(spark):
    from pyspark.sql import functions as F

    t = spark.range(500).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 13).alias("v"))
    o = [F.col("k").asc()]
    got = {r["k"]: r["s"] for r in common.running_sum(common.in_order(Scratch(spark, "t"), t, o), o, "v", "s").collect()}
    total, want = 0, {}
    for r in sorted(t.collect()):
        total += r["v"]
        want[r["k"]] = total
    assert got == want


def test_pipeline_stages(spark, docs, sf):
    import corpus_pipeline as P

    from tidering.llm import pii

    assert [n for n, _ in P.STAGES] == ["language", "near_dedup", "personal_data", "mixture", "tokens"]
    d = common.documents(spark, sf)
    tables = [d]
    for name, stage in P.STAGES:
        tables.append(Scratch(spark, "t").table(stage(spark, tables[-1], sf), name))
    for t in tables[1:-1]:
        assert t.columns == d.columns
    start, lang, near, clean, mixed, tokens = (t.collect() for t in tables)
    assert len(lang) > 0.97 * len(start)
    from test_minhash import brute

    keep = {i for i, (_, c) in brute([(r["doc_id"], r["text"]) for r in lang], 5).items() if i == c}
    assert sorted(r["doc_id"] for r in near) == sorted(keep)
    texts = {r["doc_id"]: r["text"] for r in near}
    crf = pii.trained()
    assert all(r["text"] == pii.redact(texts[r["doc_id"]], pii.find(texts[r["doc_id"]], crf)[1]) and r["n_chars"] == len(r["text"]) for r in clean) and len(clean) == len(near)
    copies: dict = {}
    for r in mixed:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert set(copies.values()) <= {1, 2} and set(copies) <= {r["doc_id"] for r in clean}
    _check_mix([(r["doc_id"], r["text"], None, r["source"]) for r in clean], [{"doc_id": i, "size": (n := len(re.findall(r"[^\x20\x09-\x0D]+", next(c["text"] for c in clean if c["doc_id"] == i)))), "taken": n * k, **_facts(clean, i)} for i, k in copies.items()])
    assert len(tokens) == len(mixed) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in tokens)
    assert P.ORACLE_SQL is None
    empty = docs([])
    for _, stage in P.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def _facts(rows, i) -> dict:
    sizes: dict = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    s = next(r["source"] for r in rows if r["doc_id"] == i)
    return {"source_size": sizes[s], "target": _targets(sizes)[s]}

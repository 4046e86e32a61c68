from __future__ import annotations

import hashlib
import random
import re

import pytest

from tidering.llm import common, pii

# The base patterns.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text: str) -> list:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def other_lines(n: int, seed: int) -> list:
    """Lines of another make than those learnt from: sentences, other names, hosts and numbers, entities in lists."""
    r = random.Random(seed)
    pick = lambda x: r.choice(x.split())
    name = lambda: pick("maria hans oliver chen fatima paul ines yuki lars")
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card():
        d = digits(15)
        d += next(c for c in "0123456789" if pii.luhn(d + c))
        return r.choice("./").join(d[i : i + 4] for i in range(0, 16, 4))

    entity = {
        "email": lambda: f"{name()}{r.choice(['', digits(2)])}{r.choice([' [at] ', ' (at) ', '[at]'])}{pick('firma klinik uni store')}{r.choice([' dot ', '.'])}{pick('com org net')}",
        "phone": lambda: r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]),
        "ip": lambda: r.choice(["[.]", " . "]).join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "secret": lambda: "4e" + "".join(r.choice("0123456789abcdef") for _ in range(38)),
    }
    lead = {"email": "write to", "phone": "call us:", "ip": "the host", "card": "paid by card", "secret": 'token = "'}
    plain_ = ["Founded in 1987, it has 250 members.", "Chapter 3.2 starts on page 114.", "The match ended 3-1 on 2024-05-17.", "It costs 12.50 or 1.200,00 each.", "He met her at the station. Then they left.", "order 77120034 shipped"]
    out = []
    for _ in range(n):
        text, gold = r.choice(plain_) + " ", []
        kind = r.choice([*entity, None])
        for k in range(r.choice([1, 1, 2]) if kind and kind != "secret" else int(kind is not None)):
            text += " and " if k else lead[kind] + ("" if kind == "secret" else " ")
            made = entity[kind]()
            gold.append((kind, len(text), len(text) + len(made)))
            text += made
        out.append((text + ('" ' if kind == "secret" else " ") + r.choice(plain_), gold))
    return out


@pytest.fixture(scope="module")
def crf():
    return pii.trained()


def test_base_spans_equal_the_patterns(crf):
    r = random.Random(8)
    for _ in range(20000):
        text = "".join(r.choice("@@..aZ-_%+ 0123456789()\n²é٣") for _ in range(r.randrange(40)))
        base, all_ = pii.find(text, crf)
        assert base == plain(text), text
        assert set(base) <= set(all_)


@pytest.mark.parametrize("text", ["a" * 60_000 + "@", "a@" * 20_000, "1" * 60_000, "1." * 30_000, "+1" + " " * 60_000, "+1 " * 20_000, "a@b." * 15_000, "@" * 50_000, "1 " * 30_000])
def test_long_texts_end_soon(crf, text):
    import time

    began = time.time()
    pii.base_spans(text)
    assert time.time() - began < 3


def test_added_spans(crf):
    found = {
        "call me at (555) 123-4567 now": [("phone", "(555) 123-4567")], "mail john.doe [at] mail dot com please": [("email", "john.doe [at] mail dot com")], "card 4111.1111.1111.1111 ok": [("card", "4111.1111.1111.1111")],
        "on 2024-01-30 at 10:20:30 v1.2.3": [], "order 2353820953013749 done": [], "at the dot of noon": [],
    }
    for text, want in found.items():
        assert [(k, text[a:b]) for k, a, b in pii.find(text, crf)[1]] == want


def measured(lines, crf):
    tp = fp = fn = 0
    for text, gold in lines:
        got, gold = set(pii.find(text, crf)[1]), set(gold)
        tp, fp, fn = tp + len(got & gold), fp + len(got - gold), fn + len(gold - got)
    return tp / (tp + fp), tp / (tp + fn)


@pytest.mark.parametrize("lines", [pii.synthetic_lines(300, 99), other_lines(300, 4)], ids=["same make", "other make"])
def test_held_out_lines(crf, lines):
    precision, recall = measured(lines, crf)
    assert precision > 0.85 and recall > 0.85


def test_spans_planted_in_documents(crf, spark, sf):
    """Obfuscated spans between the words of real documents are found, and little else is added."""
    r = random.Random(2)
    lines = []
    for d in common.documents(spark, sf).where("text is not null").limit(120).collect():
        words = [w for w in d["text"].split() if w.isalpha()][:200]
        planted, gold = r.choice(other_lines(40, r.randrange(1000)))
        at = r.randrange(len(words) + 1)
        before = " ".join(words[:at]) + " . "
        lines.append((before + planted + " . " + " ".join(words[at:]), [(k, a + len(before), b + len(before)) for k, a, b in gold]))
    precision, recall = measured(lines, crf)
    assert precision > 0.85 and recall > 0.85


def segmentations(spans, i=0):
    """All of them, as lists of spans."""
    if i == len(spans):
        return [()]
    out = segmentations(spans, i + 1)
    for j, kind, _ in spans[i]:
        out = out + [((i, j, kind), *p) for p in segmentations(spans, j)]
    return out


@pytest.mark.parametrize("text", ["tel 555 123 4567 or x [at] y.com", "a1 555-123-4567, 555.123.4567 8", "key = ab12cd34ef56ab12 1.2 . 3 . 4", "555 123 4567 555 123 4567 555-1234"])
def test_best_segmentation_and_likelihood_equal_all_of_them(crf, text):
    """With transitions of every size: the best of all segmentations, and the gradient of the summed likelihood."""
    r = random.Random(text)
    odd = pii.SemiCrf(dict(crf.w) | {a + sign + b: r.uniform(-6, 6) for a in pii.KINDS for b in pii.KINDS for sign in "|>"})
    tokens = pii.tokens_of(text)
    spans = odd.lattice(text, tokens)
    every = segmentations(spans)
    scores = [odd.score(spans, x) for x in every]
    got = odd.best(text, tokens)
    assert abs(odd.score(spans, got) - max(scores)) < 1e-9
    assert len(every) > 3

    import math

    gold = list(got)
    weight = [math.exp(s - max(scores)) for s in scores]
    counts = lambda x: [f for i, j, k in x for f in next(fs for b, c, fs in spans[i] if (b, c) == (j, k))] + list(odd._transitions(x))
    want: dict = {}
    for f in counts(gold):
        want[f] = want.get(f, 0) + 1
    for x, p in zip(every, weight, strict=True):
        for f in counts(x):
            want[f] = want.get(f, 0) - p / sum(weight)
    grad = odd._gradient(spans, gold)
    assert all(abs(grad.get(f, 0) - want.get(f, 0)) < 1e-6 for f in {*grad, *want})


def test_transitions_are_learnt_and_change_the_outcome(crf):
    """A number without its code is one after another number only, which no feature of the span itself tells."""
    plain_ = pii.SemiCrf({f: v for f, v in crf.w.items() if " " in f})
    text = "so call us: (555) 123-4567, 123 9876 today"
    numbers = lambda model, t: [t[a:b] for k, a, b in pii.find(t, model)[1] if k == "phone"]
    assert numbers(crf, text) == ["(555) 123-4567", "123 9876"]
    assert numbers(plain_, text) == ["(555) 123-4567"]
    assert numbers(crf, "so in room 123 9876 today") == []


def test_secrets(crf):
    text = 'so token = "b7852d4e73166f43a80132626729b5fa5141a7a6" and API_KEY: 9XyZ81kkQm44PzTt03Lw end, commit b7852d4e73166f43a80132626729b5fa5141a7a6'
    found = [(k, text[a:b]) for k, a, b in pii.find(text, crf)[1]]
    assert ("secret", "b7852d4e73166f43a80132626729b5fa5141a7a6") in found and ("secret", "9XyZ81kkQm44PzTt03Lw") in found and len(found) == 2


def test_spans_are_added_to_the_tables(spark, sf):
    import os

    path = sf.replace("sf0.001", "sf0.01")
    if not os.path.isdir(path):
        pytest.skip("no tables here")
    got = pii.spans(common.documents(spark, path)).collect()
    assert any(r["n_secret"] and r["secrets"].startswith("secret:") for r in got) and not any("secret" in r["spans"] for r in got)


def test_a_megabyte_ends_soon(crf):
    import time

    for text in ["mail a@b.cd and 10.0.0.1 or 555-123-4567 " * 25_000, "jo at home dot com " * 50_000, "1" * 1_000_000, "a1" * 500_000, "1 " * 100_000]:
        began = time.time()
        pii.find(text, crf)
        assert time.time() - began < 60


def test_table(spark, docs, sf):
    d = common.documents(spark, sf).unionByName(docs([(900, None, None, None), (901, "", None, None), (None, "a@b.cd", None, None)])).withColumnRenamed("source", "spans")
    got = pii.spans(d).collect()
    by = {r["doc_id"]: r for r in got}
    for r in d.collect():
        want = plain(r["text"] or "")
        assert by[r["doc_id"]]["base_sha256"] == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert [by[r["doc_id"]][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in want) for k in pii.BASE_KINDS]
    assert pii.spans(docs([])).count() == 0
    with pytest.raises(ValueError):
        pii.spans(d, keep=["doc_id", "spans"])
    assert [r["text"] for r in pii.redacted(docs(["to a@b.cd now", None, "10.0.0.1", ""])).orderBy("doc_id").collect()] == ["to <EMAIL> now", None, "<IP>", ""]


def test_windows_miss_no_span_of_the_whole_text():
    """The spans found in windows are those of the CRF over all tokens."""
    crf = pii.trained()
    r = random.Random(5)
    lines = [t for t, _ in pii.synthetic_lines(120, 21)]
    filler = lambda: " ".join(r.choice(["so", "we", "met", "at", "home.", "then", "it", "is", "3", "(", "dot"]) for _ in range(r.choice([0, 1, 5, 40])))
    texts = [f"{filler()} {r.choice(lines)} {filler()}\n{r.choice(lines)}  {filler()}".strip() for _ in range(200)]
    texts += ["host 8[.]8[.]8[.]8 is up", "ip 1 . 1 . 1 . 1", "host 10 . 0 . 0 . 1 now", "10 . 0 . 0 . 1 is the host", "server  10  .  0  .  0  .  1  there", "mail  jo  at  home  dot  com  now"]
    for text in texts:
        base = pii.base_spans(text)
        tokens = pii.tokens_of(text)
        whole = [(k, tokens[i][1], tokens[j - 1][2]) for i, j, k in crf.best(text, tokens)]
        assert pii.added_spans(text, base, crf) == [(k, s, e) for k, s, e in whole if all(b <= s or e <= a or k == "secret" and s <= a and b <= e for _, a, b in base)], text
    assert all(any(k == "ip" for k, _, _ in pii.find(t, crf)[1]) for t in texts[-6:-2])

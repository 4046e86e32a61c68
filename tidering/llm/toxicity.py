"""Toxicity scores from a learnt lexicon that is matched with misspellings and read in context.

The lexicon holds the words and stems (`stem*`: longer words that start so) to which a
sparse logistic regression over those much likelier in toxic rows gives weight. Words
are matched by Levenshtein automata intersected with the trie of the
lexicon, determinised as needed: a state is the set of (trie node, edits so far), so
that reading a word costs one step a character and most words die after a few. Longer
words allow more edits, stems none; common letter substitutes are read as letters.

Each hit is abuse or quotation by a logistic score over the window of words around it:
its edits, quotation marks before and after it, both, words of reporting, and for an
edited hit whether the term is loose, one with many innocent neighbours. The score's
weights are learnt from the hits of the sample, by whether their row is toxic, around
prior weights, so signs that the sample lacks keep their prior. A text's score is a
logistic one of its distinct terms' weights, each times its most abusive hit.

Learnt from: labelled rows outside fold 0, of each label those whose hashed id falls
under the fraction that gives SAMPLE_A_LABEL rows on average; of rows that share a label
and the least hash of four words in a row, as near copies mostly do, the least text
counts. What is learnt doesn't depend on how rows are dealt over partitions. The lexicon
has no other limit than its rows. labels, lang, source and doc_id are no inputs of a score.

Null and empty texts have no hits and get the score of no hits. Texts of any length are
read whole. Rows that repeat are scored each, alike. Labels that are null or whose
document is missing teach nothing; if a document is labelled twice, the greater label
counts; without a toxic label every score is that of no hits. An empty table gives an empty result. Kept columns with the name
of a result column are an error; others may have any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, disjoint, fold

#: Bound of the labelled rows that are learnt from, of each label on average.
SAMPLE_A_LABEL = 3000
#: A term of fewer letters than the first allows no edit, of fewer than the second one, else two.
EDIT_LENGTHS = (5, 8)
#: Lengths of the stems that may become terms.
STEMS = range(3, 9)
#: Words to each side that decide whether a hit is quoted.
WINDOW = 8
KEPT_WORDS = 400_000

# Letter substitutes, quotation marks and words of reporting.
SUBSTITUTES = str.maketrans("013457@$!", "oieastasi")
MARKS = "\"“”„«»‹›"
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes word term slur insult insults phrase reported report dit dito sagte dijo".split())

_STRIP = re.compile(r"^[\W_]+|[\W_]+$")


def edits(term: str) -> int:
    return 0 if term.endswith("*") else sum(len(term) >= n for n in EDIT_LENGTHS)


class Matcher:
    """Finds the lexicon term nearest to a word, within the term's edits."""

    def __init__(self, terms: Iterable[str], exact: Iterable[str] = (), innocent: Iterable[str] = ()):
        """exact: terms that allow no edit; innocent: words that are no misspelling of any term."""
        self.innocent = frozenset(innocent)
        exact = set(exact)
        allowed = lambda term: 0 if term in exact else edits(term)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, int] | None] = [None]  # the word that ends in a node, and its edits
        self.stems: list[str | None] = [None]
        self.allowed: list[int] = [0]  # the most edits of any term below a node
        for term in sorted(set(terms)):
            node, path = 0, [0]
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.stems.append(None)
                    self.allowed.append(0)
                node = self.children[node][c]
                path.append(node)
            if term.endswith("*"):
                self.stems[node] = term
            else:
                self.ends[node] = (term, allowed(term))
            for n in path:
                self.allowed[n] = max(self.allowed[n], allowed(term))
        self.letters = {c for x in self.children for c in x}
        self.states: list[dict[int, int]] = []
        self.known: dict[tuple[tuple[int, int], ...], int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.begun: list[str | None] = []  # the stem that a state has just completed
        self.start = self._state({0: 0})
        self.words: dict[str, tuple[str, int] | None] = {}

    def _state(self, at: dict[int, int]) -> int:
        """The number of a state, closed over letters of terms that the word leaves out."""
        todo = list(at)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = at[node] + 1
                if e <= self.allowed[child] and e < at.get(child, 99):
                    at[child] = e
                    todo.append(child)
        key = tuple(sorted(at.items()))
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(at)
            self.steps.append({})
            done = [(e, self.ends[n][0]) for n, e in at.items() if self.ends[n] and e <= self.ends[n][1]]
            self.accepts.append((min(done)[1], min(done)[0]) if done else None)
            self.begun.append(next((self.stems[n] for n, e in at.items() if self.stems[n] and not e), None))
        return self.known[key]

    def _step(self, state: int, c: str) -> int:
        """The next state; -1 if no term can be reached."""
        at: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.allowed[node] and e < at.get(node, 99):
                at[node] = e

        for node, e in self.states[state].items():
            put(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                put(child, e + (letter != c))
        out = self._state(at) if at else -1
        self.steps[state][c] = out
        return out

    def _run(self, word: str) -> tuple[str, int] | None:
        """The word matched with fewest edits; without an exact one, the longest stem."""
        state, stem, begun = self.start, None, None
        for c in word:
            c = c if c in self.letters else "\0"
            step = self.steps[state].get(c)
            state = self._step(state, c) if step is None else step
            if state < 0:
                stem = begun or stem
                break
            stem = begun or stem
            begun = self.begun[state]
        whole = self.accepts[state] if state >= 0 else None
        if whole and whole[1] and word in self.innocent:
            whole = None
        return (stem, 0) if stem and (whole is None or whole[1]) else whole

    def find(self, token: str) -> tuple[str, int] | None:
        """(term, edits) of a white-space token of lower case, or None."""
        try:
            return self.words[token]
        except KeyError:
            word = _STRIP.sub("", token) if not token.isalpha() else token
            found = self._run(word) if word else None
            if (found is None or found[1]) and not word.isalpha():
                read = _STRIP.sub("", token.translate(SUBSTITUTES))
                other = self._run(read)
                found = min((x for x in (found, other) if x), key=lambda x: (x[1], x[0]), default=None)
            if len(self.words) < KEPT_WORDS and len(token) <= 40:
                self.words[token] = found
            return found


    def misspellings(self, tokens: list[str]) -> set[str]:
        """The words that are hits by edits only."""
        near = [(t, _STRIP.sub("", t), h) for t in tokens if (h := self.find(t)) and h[1]]
        return {w if self._run(w) == h else _STRIP.sub("", t.translate(SUBSTITUTES)) for t, w, h in near}


#: What a hit's context is scored by, and the prior weights: abuse speaks for itself, edits and signs of quotation against it.
SIGNS = ("hit", "one edit", "two edits", "mark before", "mark after", "marks around", "reporting", "edits of a loose term")
SIGN_PRIOR = np.array([2.0, -0.7, -1.4, -0.5, -0.5, -2.0, -1.5, -3.0])


def signs(tokens: list[str], at: int, edits_: int, loose: bool) -> tuple[int, ...]:
    """The SIGNS of a hit, each 0 or 1: from the words around it and the marks at its own ends."""
    before, after, own = tokens[max(0, at - WINDOW) : at], tokens[at + 1 : at + 1 + WINDOW], tokens[at]
    opened = own[0] in MARKS or any(m in x for x in before for m in MARKS)
    closed = any(m in own[1:] for m in MARKS) or any(m in x for x in after for m in MARKS)
    said = any(_STRIP.sub("", x) in REPORTING for x in (*before[-4:], *after[:4]))
    return (1, int(edits_ == 1), int(edits_ >= 2), int(opened), int(closed), int(opened and closed), int(said), int(loose and edits_ > 0))


#: Of the sparse regression that picks the terms.
PENALTY = 2e-4
#: A word near to a term is a misspelling of it, and a term not loose, from such log odds of toxic rows on, if innocent rows hold it at all.
MISREAD = 2.0
#: Weights of terms that count as none.
LEAST_WEIGHT = 0.05
#: Of the text's score: for nothing, and for the logarithm of its terms' weights.
PRIOR = np.array([-4.0, 3.5])


def hits(text: str | None, matcher: Matcher, loose: Collection[str] = ()) -> dict[str, set[tuple[int, ...]]]:
    """Of each term found, the distinct SIGNS of its hits."""
    tokens = (text or "").lower().split()
    out: dict[str, set[tuple[int, ...]]] = {}
    for i, h in enumerate(map(matcher.find, tokens)):
        if h:
            out.setdefault(h[0], set()).add(signs(tokens, i, h[1], h[0] in loose))
    return out


def abuse(found: tuple[int, ...], context: np.ndarray) -> float:
    """The probability that a hit of these signs is abuse rather than quotation."""
    return 1 / (1 + math.exp(-sum(w for w, s in zip(context.tolist(), found, strict=True) if s)))


@dataclass
class Model:
    terms: dict[str, float]  # with their weights
    innocent: list[str] = field(default_factory=list)  # words near to terms that are none of their misspellings
    loose: frozenset[str] = frozenset()  # terms whose edits innocent rows hold about as often as toxic ones
    context: np.ndarray = field(default_factory=lambda: SIGN_PRIOR.copy())
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def matcher(self) -> Matcher:
        return Matcher(self.terms, innocent=self.innocent)

    def hits(self, text: str | None, matcher: Matcher) -> dict[str, set[tuple[int, ...]]]:
        return hits(text, matcher, self.loose)

    def feature(self, found: dict[str, set[tuple[int, ...]]]) -> float:
        return math.log2(1 + sum(self.terms[t] * max(abuse(s, self.context) for s in each) for t, each in sorted(found.items())))

    def score(self, found: dict[str, set[tuple[int, ...]]]) -> float:
        """From 0 to 1, of the hits of a text."""
        return 1 / (1 + math.exp(-(self.weights[0] + self.weights[1] * self.feature(found))))


def fit_weights(z: np.ndarray, y: np.ndarray, prior: np.ndarray, deviation: float, rounds: int = 50) -> np.ndarray:
    """Logistic regression by damped Newton steps, with a Gaussian prior."""
    hold = 1 / deviation**2
    loss = lambda w: np.logaddexp(0, z @ w).sum() - y @ (z @ w) + hold * ((w - prior) ** 2).sum() / 2
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + hold * (w - prior)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + hold * np.eye(len(w)), g)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def strings(tokens: list[str]) -> set[str]:
    """The distinct words of a text, and the stems of those that are longer."""
    words = {w for w in (_STRIP.sub("", t) for t in tokens) if w}
    return words | {w[:n] + "*" for w in words for n in STEMS if n < len(w)}


def family(tokens: list[str]) -> int:
    """The least hash of four words in a row: near copies mostly share it."""
    return min(xxhash.xxh3_64_intdigest(" ".join(tokens[i : i + 4])) for i in range(max(1, len(tokens) - 3))) >> 1


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic, family) of the rows with a word."""
    for b in batches:
        found = [(t, y, family(w)) for t, y in zip(*(c.to_pylist() for c in b.columns), strict=True) if (w := (t or "").lower().split())]
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["text", "toxic", "family"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(string, a, b): rows with each string, toxic and others."""
    seen: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for w in strings(text.lower().split()):
                seen.setdefault(w, [0, 0])[1 - toxic] += 1
    names = list(seen)
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([seen[w][i] for w in part], pa.int64()) for i in (0, 1))], names=["string", "a", "b"])


def _holding(wanted: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The numbers of the wanted strings that each row holds, and its label."""
        number = {w: i for i, w in enumerate(wanted)}
        for b in batches:
            held = [sorted(number[w] for w in strings(x.as_py().lower().split()) if w in number) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32())), b.column(1)], names=["held", "toxic"])

    return run


def _misread(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The misspellings of terms that rows hold, with the row's label and half."""
        matcher = Matcher(weights)
        for b in batches:
            found = [(w, y, h) for x, y, h in zip(*(c.to_pylist() for c in b.columns), strict=True) for w in matcher.misspellings(x.lower().split())]
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32()), strict=True)], names=["word", "toxic", "half"])

    return run


def _hit(terms: dict[str, float], innocent: list[list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(toxic, hits) of each row, its hits as [(term, signs)], without the innocent words told for its half."""
        matchers = [Matcher(terms, innocent=some) for some in innocent]
        for b in batches:
            found = [[{"term": t, "signs": list(s)} for t, each in sorted(hits(x.as_py(), matchers[h]).items()) for s in sorted(each)] for x, h in zip(b.column(0), b.column(2).to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("term", pa.string()), ("signs", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, kind)], names=["toxic", "hits"])

    return run


def sparse_weights(rows: list[list[int]], y: np.ndarray, p: int, penalty: float, rounds: int = 400) -> np.ndarray:
    """Nonnegative weights of an L1-penalised logistic regression with a free intercept, by accelerated proximal gradient.

    rows: of each row the numbers of its features, which are 0 or 1.
    """
    n = len(rows)
    at, held = np.repeat(np.arange(n), [len(r) for r in rows]), np.fromiter((i for r in rows for i in r), np.int64)
    apply = lambda v: v[0] + np.bincount(at, v[1:][held], n)
    back = lambda g: np.concatenate(([g.sum()], np.bincount(held, g[at], p)))
    w = v = np.zeros(p + 1)
    v_ = np.ones(p + 1)
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        v_ = back(apply(v_))
        v_ /= np.linalg.norm(v_)
    step, t = 4 * n / float(np.linalg.norm(apply(v_)) ** 2 * 1.05), 1.0
    for _ in range(rounds):
        g = back(1 / (1 + np.exp(-np.clip(apply(v), -30, 30))) - y) / n
        new = v - step * g
        new[1:] = np.maximum(new[1:] - step * penalty, 0)
        t_ = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_ * (new - w), new, t_
    return w[1:]


def distinct_strings(names: list[str], rows: list[list[int]]) -> list[int]:
    """The numbers of the strings to learn from: of those that the same rows hold, the word, or else the longest stem.

    So a word's own stems, which nothing tells from it, don't take its weight to other words.
    """
    holders: dict[int, list[int]] = {}
    for n, r in enumerate(rows):
        for i in r:
            holders.setdefault(i, []).append(n)
    best: dict[tuple[int, ...], int] = {}
    rank = lambda i: (names[i].endswith("*"), -len(names[i]), names[i])
    for i, some in holders.items():
        key = tuple(some)
        if key not in best or rank(i) < rank(best[key]):
            best[key] = i
    return sorted(best.values())


def lexicon(names: list[str], weights: np.ndarray) -> dict[str, float]:
    """The terms of more than LEAST_WEIGHT; a term's stems add theirs."""
    kept = {n: float(w) for n, w in zip(names, weights, strict=True) if w > LEAST_WEIGHT}
    return {w: sum(kept.get(w[:n] + "*", 0.0) for n in STEMS if n < len(w.removesuffix("*"))) + kept[w] for w in sorted(kept)}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic); the caller leaves out what must not be learnt from."""
    spark = docs.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1):
        return Model({})
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE_A_LABEL / sizes[1])).otherwise(min(1.0, SAMPLE_A_LABEL / max(1, sizes.get(0, 0))))
    u = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    scratch = Scratch(spark, "toxicity")
    chosen = known.where(u < share)  # two labels' sample: about 2 * SAMPLE_A_LABEL ids
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic").mapInArrow(_families, "text string, toxic int, family long")
    rows = scratch.table(rows.groupBy("family", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", (F.col("family") % 2).cast("int").alias("half")), "rows")

    of = {(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = (sum(n for (_, y), n in of.items() if y == label) for label in (1, 0))
    by = rows.select("text", "toxic").mapInArrow(_counted, "string string, a long, b long").groupBy("string").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 3")
    odds = F.log((F.col("a") + 0.5) / F.lit(n1 + 1)) - F.log((F.col("b") + 0.5) / F.lit(n0 + 1))
    low = odds - 2 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    names = sorted(r["string"] for r in by.where(low > 1).select("string").collect())  # of a bounded sample's words
    held = rows.select("text", "toxic").mapInArrow(_holding(names), "held array<int>, toxic int").collect()
    held.sort(key=lambda r: (r["toxic"], r["held"]))
    some = distinct_strings(names, [r["held"] for r in held])
    number = {i: n for n, i in enumerate(some)}
    each = [[number[i] for i in r["held"] if i in number] for r in held]
    terms = lexicon([names[i] for i in some], sparse_weights(each, np.array([r["toxic"] for r in held], float), len(some), PENALTY)) if some else {}
    # words near to terms that innocent rows hold, and toxic ones not much more often, by shares of the sample, are no misspellings
    near = rows.mapInArrow(_misread(terms), "word string, toxic int, half int").groupBy("word", "half").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b")).collect()

    def few(held_by: dict[str, list[int]], m1: int, m0: int) -> list[str]:
        """What innocent rows hold, and toxic ones not much more often."""
        return sorted(w for w, (x, y) in held_by.items() if y and math.log((x + 0.5) / (m1 + 1)) - math.log((y + 0.5) / (m0 + 1)) < MISREAD)

    def innocent(halves: tuple[int, ...]) -> list[str]:
        held_by: dict[str, list[int]] = {}
        for r in near:
            if r["half"] in halves:
                n = held_by.setdefault(r["word"], [0, 0])
                n[0], n[1] = n[0] + r["a"], n[1] + r["b"]
        m1, m0 = (sum(of.get((h, y), 0) for h in halves) for y in (1, 0))
        return few(held_by, m1, m0)

    # the words that one half tells innocent are left out of the other, so that the weight of edits is that for words not met before
    got = rows.mapInArrow(_hit(terms, [innocent((1,)), innocent((0,))]), "toxic int, hits array<struct<term: string, signs: array<int>>>").collect()
    model = Model(terms, innocent((0, 1)))
    scratch.drop(rows)
    got = sorted((r["toxic"], [(h["term"], tuple(h["signs"])) for h in r["hits"]]) for r in got)
    edited: dict[str, list[int]] = {}
    for y, found in got:
        for t in {t for t, s in found if s[1] or s[2]}:
            edited.setdefault(t, [0, 0])[1 - y] += 1
    model.loose = frozenset(few(edited, n1, n0))
    got = sorted((y, [(t, (*s[:-1], int(t in model.loose and s[1] + s[2] > 0))) for t, s in found]) for y, found in got)
    if seen := sorted({(y, s, t, n) for n, (y, found) in enumerate(got) for t, s in found}):
        model.context = fit_weights(np.array([s for _, s, _, _ in seen], float), np.array([y for y, *_ in seen], float), SIGN_PRIOR, 1.0)
    found = [{t: {s for u, s in each if u == t} for t, _ in each} for _, each in got]
    x = np.array([[1.0, model.feature(f)] for f in found]).reshape(len(found), 2)
    model.weights = fit_weights(x, np.array([y for y, _ in got], float), PRIOR, 2.0)
    return model


def _scored(model: Model, n_kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                s = [model.score(model.hits(t.as_py(), matcher)) for t in b.column(0)]
                yield pa.RecordBatch.from_arrays([*b.columns[1 : 1 + n_kept], pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=[*b.schema.names[1 : 1 + n_kept], "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, score (0 to 1) and predicted (1 from 0.5)."""
    keep = keep if keep is not None else ["doc_id"]
    disjoint(keep, ["score", "predicted"])
    bounded_batches(docs.sparkSession)
    kept = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)
    ddl = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes[1:]), "score double, predicted int"])
    return kept.mapInArrow(_scored(model, len(keep)), ddl)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows outside fold 0 and score every row: doc_id, held_out, score, predicted."""
    model = fit(docs, labels.where(fold(F.col("doc_id")) != 0))
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    return score(rows, model, keep=["doc_id", "held_out"])

"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds to them.

Base spans are the matches of four patterns (e-mail addresses, IP addresses, card and
phone numbers), leftmost and non-overlapping within their kind, that pass the kind's
check; a failing match is dropped without another try. The matchers below give the
same matches in linear time, whatever the text.

Around digits, @ signs and words for it, with all tokens that a span through them could
hold, a semi-Markov CRF segments the tokens. Segments are single tokens outside, or
spans of up to MOST_TOKENS tokens of one of KINDS, among them secrets (keys, tokens,
passwords), which have no base pattern. A segment is scored by features of the whole
span (separators, grouping of the digits, checksums, spelled-out signs, classes of
letters, the words before) and by the transition from the segment before it: its kind,
or that it is outside and the kind of the last span seen. Dynamic programming over spans
of bounded length finds the best boundaries and kinds together. The spans that meet no
base span are added, and secrets around them. The weights are trained by conditional likelihood on seeded
synthetic lines, on the driver when a query is planned, and go along with the tasks.

Null and empty texts have no spans. Every row is handled by itself, so rows that repeat
repeat their result; an empty table gives an empty result. Texts of any length are
searched whole, in time linear in their tokens. Kept columns with the name of a result
column are an error; others may have any name. Offsets are in code points, ends
exclusive; spans are ordered by start, then kind as in KINDS, then end.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, disjoint

#: Kinds with a base pattern, and all of them.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: The most tokens of a span: sixteen digits apart take that many.
MOST_TOKENS = 16
#: Tokens before a span that its features read.
CONTEXT = 4
#: Tokens outside after which a span is forgotten; no more than CONTEXT, so that windows see what the whole text would.
NEAR = 3
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with a domain after it, and the run of local characters before it that no earlier match holds."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        else:
            end = max(end, at)  # a run never reaches over an @
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The base spans, by start and then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- the semi-Markov CRF

# Spelled-out signs, and words that announce a kind.
AT, DOT = frozenset({"at", "arroba", "chez"}), frozenset({"dot", "punkt", "punto", "point"})
CUES = {
    "email": frozenset("mail email e-mail contact write address correo courriel".split()),
    "ip": frozenset("ip host server address node".split()),
    "card": frozenset("card visa mastercard amex credit carte karte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax ring telefon teléfono".split()),
    "secret": frozenset("token secret password passwd pwd key apikey auth bearer credential credentials passwort contraseña".split()),
}
#: Letters and digits mixed, from so many on, are one token: keys and hashes.
BLOB = 12
_TOKEN = re.compile(r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{%d,}|[0-9]+|[^\W\d_]+|[^\s]" % BLOB)
_ANCHOR = re.compile(r"[0-9]+|@|(?<![^\W\d_])(?:at|arroba|chez)(?![^\W\d_])", re.I)
_DOTS = re.compile(r"\.|(?<![^\W\d_])(?:dot|punkt|punto|point)(?![^\W\d_])", re.I)
_SEPARATORS = frozenset(".-()/+ []")
_ADDRESS = frozenset("._%+-@()[]{}")

Token = tuple[str, int, int]


def _numeric(tokens: list[Token]) -> bool:
    first, last = tokens[0][0], tokens[-1][0]
    return (first.isdigit() or first in "+(") and last.isdigit() and all(t.isdigit() or t in _SEPARATORS for t, _, _ in tokens)


def _addressed(words: list[str]) -> bool:
    if not all(w in _ADDRESS or w.isalnum() for w in words):
        return False
    return words[0][0].isalnum() and words[-1].isalpha() and len(words) >= 5 and ("@" in words or any(w in AT for w in words[1:-1])) and ("." in words or any(w in DOT for w in words[1:-1]))


def _blob(t: str) -> bool:
    return len(t) >= BLOB and t.isascii() and t.isalnum() and not t.isdigit() and not t.isalpha()


def _secret(span: list[Token], before: list[str], cue: bool) -> list[str]:
    """Features of a run of letters and digits as a secret."""
    raw = "".join(t for t, _, _ in span)
    size = len(raw)
    letters = [c for c in raw if c.isalpha()]
    near = [t for t in before if t not in "\"'`"]
    kind = "hex" if all(c in "0123456789abcdefABCDEF" for c in raw) else "wide"
    case = "lower" if all(c.islower() for c in letters) else "upper" if all(c.isupper() for c in letters) else "both"
    return [f"size:{min(size // 8, 8)}", f"{kind} {case}", "assigned" if near and near[-1] in "=:" else "bare", "quoted" if before and before[-1] in "\"'`" else "plain", "cue" if cue else "no_cue", f"tokens:{min(len(span), 4)}"]


def span_features(text: str, tokens: list[Token], i: int, j: int, lower: list[str]) -> dict[str, list[str]]:
    """Of the span of tokens i to j (exclusive): features by kind; empty if it can be no entity."""
    span = tokens[i:j]
    before = lower[max(0, i - CONTEXT) : i]
    near = lambda k: not CUES[k].isdisjoint(before)
    out: dict[str, list[str]] = {}
    if span[0][0].isdigit() or span[0][0] in "+(":
        if not _numeric(span):
            return {}
        raw = text[span[0][1] : span[-1][2]]
        if (i and tokens[i - 1][2] == span[0][1] and tokens[i - 1][0][0].isalnum()) or (j < len(tokens) and tokens[j][1] == span[-1][2] and tokens[j][0][0].isalnum()):
            return {}
        groups = re.findall(r"[0-9]+", raw)
        d = "".join(groups)
        shape = "-".join(str(len(g)) for g in groups)
        gaps = "".join(sorted(set(re.sub(r"[0-9]", "", raw))))
        if len(groups) == 4 and "." in gaps and all(len(g) <= 3 and int(g) <= 255 for g in groups):
            out["ip"] = ["ok", f"gaps:{gaps}"] + ["cue"] * near("ip")
        if 12 <= len(d) <= 19:
            out["card"] = ["luhn" if luhn(d) else "no_luhn", "grouped" if shape in ("4-4-4-4", "4-6-5") else "ungrouped", f"gaps:{gaps}"] + ["cue"] * near("card")
        if 7 <= len(d) <= 15:
            out["phone"] = [f"digits:{len(d)}", f"shape:{shape}" if len(groups) < 6 else "shape:many", f"gaps:{gaps}", "plus" if raw[0] == "+" else "bare", "cue" if near("phone") else "no_cue"]
        return out
    if len(text[span[0][1] : span[-1][2]].split(None, 1)) == 1 and any(_blob(t) for t, _, _ in span) and all(t.isalnum() or t in "-_" for t, _, _ in span) and span[-1][0].isalnum():
        out["secret"] = _secret(span, before, near("secret"))
    words = lower[i:j]
    if j - i < 5 or not _addressed(words):
        return out
    signs = [k for k, w in enumerate(words) if w == "@" or w in AT]
    if len(signs) != 1:
        return out
    k = signs[0]
    spelled = words[k] != "@"
    held = k + 1 < len(words) and k and words[k - 1] in "[({" and words[k + 1] in "])}"
    rest = [w for w in words[k + 1 :] if w not in "[](){}"]
    tight = all(tokens[i + q][1] == tokens[i + q - 1][2] and tokens[i + q][2] == tokens[i + q + 1][1] for q in range(k + 1, len(words) - 1) if words[q] == ".")
    host = all(w.isalnum() or w in ".-" for w in rest) and (rest[-2] in DOT or rest[-2] == "." if len(rest) >= 3 else False)
    out["email"] = ["spelled" if spelled else "sign", "held" if held else "loose", "inside" if i and tokens[i - 1][2] == span[0][1] else "free", "host" if host else "no_host", f"name:{min(k, 4)}", "name_apart" if any(tokens[i + q][2] < tokens[i + q + 1][1] for q in range(k - 1 - held)) else "name_tight", f"rest:{min(len(rest), 6)}", "cue" if near("email") else "no_cue", "dot_word" if any(w in DOT for w in rest) else "dot_tight" if tight else "dot_apart"]
    return out


class SemiCrf:
    """Segments are single tokens outside, or spans of a kind.

    weights: of each feature of a kind, and of the transitions "last|kind" where two spans
    touch and "last>kind" where up to NEAR tokens are between them.
    """

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.w: dict[str, float] = defaultdict(float, weights or {})

    def lattice(self, text: str, tokens: list[Token]) -> list[list[tuple[int, str, list[str]]]]:
        """Of each start, the candidate spans (end, kind, features)."""
        lower = [t.lower() for t, _, _ in tokens]
        signs = [k for k, t in enumerate(lower) if t == "@" or t in AT] + [len(tokens)] * 2
        blobs = [k for k, (t, _, _) in enumerate(tokens) if _blob(t)] + [len(tokens)]
        stops = [len(tokens)] * (len(tokens) + 1)  # of each place, the first token from there on that no address holds
        if signs[0] < len(tokens):
            for i in reversed(range(len(tokens))):
                stops[i] = stops[i + 1] if lower[i] in _ADDRESS or lower[i].isalnum() else i
        out, sign, blob = [], 0, 0
        for i in range(len(tokens)):
            here = []
            while signs[sign] < i:
                sign += 1
            while blobs[blob] < i:
                blob += 1
            t, most = tokens[i][0], min(len(tokens), i + MOST_TOKENS)
            ends: set[int] = set()
            if t[0] in "+(" or t.isdigit():
                j = i + 1
                while j < most and ((u := tokens[j][0]).isdigit() or u in _SEPARATORS):
                    j += 1
                held = groups = 0
                for k in range(i, j):
                    if tokens[k][0].isdigit():
                        held, groups = held + len(tokens[k][0]), groups + 1
                        if held >= 7 or groups == 4:  # no fewer digits make a number, but an address
                            ends.add(k + 1)
                        if held > 19:
                            break
            elif t.isalnum():
                if i < signs[sign] < most and stops[i] > signs[sign]:  # an address has one sign within, and after it a dot
                    upto = min(most, signs[sign + 1], stops[i])
                    dot = next((k for k in range(signs[sign] + 1, upto - 1) if lower[k] == "." or lower[k] in DOT), upto)
                    if dot == upto:  # one before the sign will do
                        dot = signs[sign] if any(w == "." or w in DOT for w in lower[i + 1 : signs[sign]]) else upto
                    ends.update(k for k in range(max(dot + 2, i + 5), upto + 1) if lower[k - 1].isalpha())
                if blobs[blob] < most:
                    j = i + 1  # the run without white space that holds the blob
                    while j < most and tokens[j][1] == tokens[j - 1][2] and (tokens[j][0].isalnum() or tokens[j][0] in "-_"):
                        j += 1
                    if blobs[blob] < j and (not i or tokens[i - 1][2] < tokens[i][1] or not (tokens[i - 1][0].isalnum() or tokens[i - 1][0] in "-_")):
                        ends.update(k for k in range(blobs[blob] + 1, j + 1) if tokens[k - 1][0].isalnum())
            for j in sorted(ends):
                for kind, fs in span_features(text, tokens, i, j, lower).items():
                    here.append((j, kind, [f"{kind} {f}" for f in ("bias", *fs)]))
            out.append(here)
        return out

    def best(self, text: str, tokens: list[Token], spans: list | None = None) -> list[tuple[int, int, str]]:
        """The segmentation of greatest score: its spans.

        Tokens outside score nothing, so only the starts of candidates are visited: `far`
        is the best of what is forgotten, `at` has the best score of each kind of span that ends at a place.
        """
        w = self.w
        far: tuple[float, tuple | None] = (0.0, None)
        at: dict[int, dict[str, tuple[float, tuple | None]]] = {}
        for i, here in enumerate(self.lattice(text, tokens) if spans is None else spans):
            if not here:
                continue
            for j in [k for k in at if k < i - NEAR]:
                far = max(far, *at.pop(j).values(), key=lambda x: x[0])
            close = [("|" if j == i else ">", last, v, link) for j in range(i - NEAR, i + 1) for last, (v, link) in at.get(j, {}).items()]
            for j, kind, fs in here:
                ways = [far, *((v + w.get(last + sign + kind, 0.0), link) for sign, last, v, link in close)]
                v, link = max(ways, key=lambda x: x[0])
                v += sum(w.get(f, 0.0) for f in fs)
                if kind not in (to := at.setdefault(j, {})) or v > to[kind][0]:
                    to[kind] = (v, (i, j, kind, link))
        link = max([far, *(x for found in at.values() for x in found.values())], key=lambda x: x[0])[1]
        out = []
        while link:
            i, j, kind, link = link
            out.append((i, j, kind))
        return out[::-1]

    @staticmethod
    def _transitions(chosen: list[tuple[int, int, str]]) -> Iterator[str]:
        for (_, end, last), (i, _, kind) in zip(chosen, chosen[1:], strict=False):
            if i - end <= NEAR:
                yield last + ("|" if i == end else ">") + kind

    def score(self, spans: list, chosen: list[tuple[int, int, str]]) -> float:
        """The score of a segmentation, given as its spans in order."""
        own = [f for i, j, kind in chosen for f in next(fs for k, c, fs in spans[i] if (k, c) == (j, kind))]
        return sum(self.w.get(f, 0.0) for f in [*own, *self._transitions(chosen)])

    def _gradient(self, spans: list, gold: list[tuple[int, int, str]]) -> dict[str, float]:
        """What the gold segmentation holds of each feature, less what is expected of it: forward and backward sums over states.

        A state is the last span's kind and how many tokens ago it ended, or that it is forgotten.
        """
        n, w = len(spans), self.w
        states = [("", NEAR + 1), *((k, ago) for k in KINDS for ago in range(NEAR + 1))]
        number = {x: i for i, x in enumerate(states)}
        away = [number.get((k, ago + 1), 0) for k, ago in states]
        step = lambda last, ago, kind: last + "|>"[ago > 0] + kind if last else None
        arcs = [[(j, number[kind, 0], kind, fs, [math.exp(sum(w[f] for f in fs) + (w[t] if (t := step(*x, kind)) else 0.0)) for x in states]) for j, kind, fs in here] for here in spans]
        ahead = [[0.0] * len(states) for _ in range(n + 1)]
        ahead[0][0] = 1.0
        for i in range(n):
            for s, v in enumerate(ahead[i]):
                ahead[i + 1][away[s]] += v
            for j, to, _, _, e in arcs[i]:
                ahead[j][to] += sum(v * x for v, x in zip(ahead[i], e, strict=True))
        behind = [[0.0] * len(states) for _ in range(n)] + [[1.0] * len(states)]
        for i in reversed(range(n)):
            for s in range(len(states)):
                behind[i][s] = behind[i + 1][away[s]] + sum(e[s] * behind[j][to] for j, to, _, _, e in arcs[i])
        whole = sum(ahead[n])
        grad: dict[str, float] = defaultdict(float)
        for i, j, kind in gold:
            for f in next(fs for k, c, fs in spans[i] if (k, c) == (j, kind)):
                grad[f] += 1
        for t in self._transitions(gold):
            grad[t] += 1
        for i in range(n):
            for j, to, kind, fs, e in arcs[i]:
                each = [v * x * behind[j][to] / whole for v, x in zip(ahead[i], e, strict=True)]
                for f in fs:
                    grad[f] -= sum(each)
                for x, p in zip(states, each, strict=True):
                    if p and (t := step(*x, kind)):
                        grad[t] -= p
        return grad

    def train(self, lines: list[tuple[str, list[Span]]], rounds: int = 10, rate: float = 0.5, decay: float = 1e-3) -> None:
        """Gradient ascent on the conditional likelihood of lines with their spans."""
        sums: dict[str, float] = defaultdict(lambda: 1e-8)
        made = []
        for text, gold in lines:
            tokens = tokens_of(text)
            spans, want = self.lattice(text, tokens), {(a, b, k) for k, a, b in gold}
            found = sorted({(i, j, k) for i, here in enumerate(spans) for j, k, _ in here if (tokens[i][1], tokens[j - 1][2], k) in want})
            made.append((spans, found))
        for _ in range(rounds):
            for spans, gold in made:
                for f, g in self._gradient(spans, gold).items():
                    g -= decay * self.w[f]
                    sums[f] += g * g
                    self.w[f] += rate * g / math.sqrt(sums[f])


def tokens_of(text: str, start: int = 0, end: int | None = None) -> list[Token]:
    return [(m[0], *m.span()) for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def synthetic_lines(n: int = 480, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Lines with entities in forms that the base patterns miss, and with look-alikes that are none."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "er", "in", "lo", "ti", "sha", "que", "re", "ou"]) for _ in range(r.randint(1, 3)))

    def card() -> str:
        d = num(15)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def phone() -> str:
        return r.choice([lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"{num(3)} {num(3)} {num(4)}"])()

    def email() -> str:
        at = r.choice([" [at] ", " (at) ", " at ", "[at]", " @ "])
        dot = r.choice([" dot ", "."]) if at != " at " else " dot "
        return f"{word()}{r.choice(['', '.' + word(), num(2)])}{at}{word()}{dot}{r.choice(['com', 'org', 'net'])}"

    def four(c: str) -> str:
        return c.join(d[i : i + 4] for d in [card()] for i in range(0, 16, 4))

    def secret() -> str:
        kinds = r.choice(["0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"])
        return "".join(r.choice(kinds) for _ in range(r.choice([16, 20, 32, 40, 64]) - 2)) + r.choice("abcdef" if kinds[10] == "a" else "ABCDEF") + r.choice("0123456789")

    def digest() -> str:
        return "".join(r.choice("0123456789abcdef") for _ in range(r.choice([30, 38, 62]))) + "7f"

    entity = {"secret": secret, "phone": phone, "email": email, "card": lambda: four(r.choice([".", "/"])), "ip": lambda: r.choice(["[.]", " . "]).join(str(r.randint(1, 255)) for _ in range(4))}
    other = [
        lambda: f"{r.randint(1900, 2030)}-{num(2)}-{num(2)}", lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"{num(1)}.{num(2)}.{num(1)}", lambda: num(r.choice([2, 4, 5, 7, 8, 10, 14, 16])),
        lambda: f"{num(1)}.{num(3)}.{num(3)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(4)} {num(4)}", lambda: f"{word()} at {word()} {word()}", lambda: f"{word()} at {word()}. {word()} {word()}", lambda: f"{word()}. {word()} at {word()}. {word()}", lambda: f"{word()} at {word()} {word()} {word()}. {word()}", lambda: f"{num(3)}, {num(3)}, {num(4)}", lambda: ".".join(num(4) for _ in range(4)), lambda: f"{num(3)} {num(5)} {num(2)}",
        lambda: f"{num(3)} {num(4)}", lambda: f"{num(3)} {num(4)}", lambda: f"commit {digest()}", lambda: f"build{num(8)}x", lambda: f"sha256 {digest()}", lambda: f"checksum: {digest()}", lambda: f"file img{num(10)}jpg", lambda: f"number: {num(12)}ab",
    ]
    out = []
    for _ in range(n):
        line, gold = " ".join(word() for _ in range(r.randint(1, 3))), []
        for _ in range(r.randint(1, 2)):
            kind = r.choice([*KINDS, None, None, None, None])
            if kind:
                if r.random() < (0.9 if kind == "secret" else 0.5):
                    line += " " + r.choice(sorted(CUES[kind])) + (r.choice([" =", ":", "=", " = ", ""]).rstrip(" ") if kind == "secret" else r.choice(["", ":"]))
                made, quote = entity[kind](), r.choice(["", "\"", "'"]) if kind == "secret" else ""
                gold.append((kind, len(line) + 1 + len(quote), len(line) + 1 + len(quote) + len(made)))
                made = quote + made + quote
                if kind == "phone" and r.random() < 0.4:  # a second number without its code, which alone would be none
                    sign, short = r.choice([", ", " / ", " or "]), f"{num(3)} {num(4)}"
                    at = len(line) + 1 + len(made) + len(sign)
                    gold.append((kind, at, at + len(short)))
                    made += sign + short
            else:
                made = r.choice(other)()
            line += f" {made}{r.choice(['', '.', ','])} {word()}"
        out.append((line, gold))
    return out


@lru_cache(maxsize=1)
def trained() -> SemiCrf:
    crf = SemiCrf()
    crf.train(synthetic_lines())
    return crf


def windows(text: str) -> Iterator[list[Token]]:
    """Runs of tokens that hold all candidates and what their features read; windows that meet are one.

    A candidate holds digits, or an @ or word for it with a dot or word for it near.
    """
    found = [(m.start(), m[0]) for m in _ANCHOR.finditer(text)]
    if not found:
        return
    if any(t.isalpha() or t == "@" for _, t in found):
        dots = [m.start() for m in _DOTS.finditer(text)]
    tokens = tokens_of(text)
    starts = [s for _, s, _ in tokens]
    lo = hi = 0
    for at, t in found:
        k = bisect_right(starts, at) - 1
        a, b = max(0, k - MOST_TOKENS - CONTEXT), min(len(tokens), k + MOST_TOKENS + 1)
        if not t[0].isdigit():
            dot = bisect_left(dots, starts[max(0, k - MOST_TOKENS)])
            if dot == len(dots) or dots[dot] >= tokens[b - 1][2]:
                continue
        if a > hi:
            if hi:
                yield tokens[lo:hi]
            lo = a
        hi = max(hi, b)
    if hi:
        yield tokens[lo:hi]


def added_spans(text: str, base: list[Span], crf: SemiCrf) -> list[Span]:
    """The CRF's spans that meet no base span, and secrets that hold those they meet: digits in a key may pass for a card."""
    taken: list[list[int]] = []  # merged
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    ends = [b for _, b in taken]
    meets = lambda s, e: (k := bisect_right(ends, s)) < len(taken) and taken[k][0] < e
    holds = lambda s, e: all(s <= a and b <= e for a, b in taken[bisect_right(ends, s) : bisect_left(starts, e)])
    starts = [a for a, _ in taken]
    out = []
    for tokens in windows(text):
        if all(meets(s, e) and not (_blob(t) and holds(s, e)) for t, s, e in tokens if t[0].isdigit() or t == "@" or _blob(t)) and not any(t.lower() in AT | DOT for t, _, _ in tokens):
            continue  # the base spans explain all that could be found
        for i, j, kind in crf.best(text, tokens):
            s, e = tokens[i][1], tokens[j - 1][2]
            if not meets(s, e) or kind == "secret" and holds(s, e):
                out.append((kind, s, e))
    return out


def find(text: str | None, crf: SemiCrf) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, both by start, kind and end."""
    text = text or ""
    base = base_spans(text)
    more = added_spans(text, base, crf)
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if more else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of spans that meet, replaced by <KIND> of its first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _run(n_kept: int, what: str):
    weights = dict(trained().w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = SemiCrf(weights)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = b.column(0).to_pylist()
                found = [find(t, crf) for t in texts]
                kept = b.columns[1 : 1 + n_kept]
                names = b.schema.names[1 : 1 + n_kept]
                if what == "redact":
                    new = [t if t is None or not all_ else redact(t, all_) for t, (_, all_) in zip(texts, found, strict=True)]
                    cols = {"text": pa.array(new, pa.string())}
                else:
                    cols = {f"n_{k}": pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE_KINDS}
                    cols["base_sha256"] = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found])
                    cols["spans"] = pa.array([joined([x for x in all_ if x[0] in BASE_KINDS]) for _, all_ in found], pa.string())
                    cols["n_secret"] = pa.array([sum(x[0] not in BASE_KINDS for x in all_) for _, all_ in found], pa.int64())
                    cols["secrets"] = pa.array([joined([x for x in all_ if x[0] not in BASE_KINDS]) for _, all_ in found], pa.string())
                yield pa.RecordBatch.from_arrays([*kept, *cols.values()], names=[*names, *cols])

    return run


def spans(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all of these kinds, as kind:start:end), n_secret and secrets (those of the kind without a base pattern)."""
    keep = keep if keep is not None else ["doc_id"]
    bounded_batches(docs.sparkSession)
    kept = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)
    ddl = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes[1:]), *(f"n_{k} long" for k in BASE_KINDS), "base_sha256 string, spans string, n_secret long, secrets string"])
    disjoint(keep, [*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_secret", "secrets"])
    return kept.mapInArrow(_run(len(keep), "spans"), ddl)


def redacted(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and text, its spans replaced by <KIND>."""
    keep = keep if keep is not None else ["doc_id"]
    disjoint(keep, ["text"])
    bounded_batches(docs.sparkSession)
    kept = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)
    return kept.mapInArrow(_run(len(keep), "redact"), ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes[1:]), "text string"]))

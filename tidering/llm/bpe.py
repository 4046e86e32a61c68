"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Bytes are mapped to Latin-1 so that pyahocorasick finds every token at every place of
a piece in one pass. The encoding is built from the left: take the longest token, keep
it if it is compatible with the token before it (the two, merged from their bytes, stay
those two), else try its next shorter prefix, else step back over the previous token.
A sequence whose adjacent tokens are all compatible is the one that the merges give, so
this reproduces them exactly; places from which no way on was found are marked, which
keeps the work linear in the length of the piece. Compatibility is memoised for the
pairs met.

Texts are cut, with the same result, before a single space that stands between two
characters that aren't white space; each cut-off part is split by the vocabulary's
pattern. Encodings of short parts are kept in a table of bounded size.

A null text counts as empty: no ids. Decoding the ids gives the text's UTF-8 bytes back.
Texts of any length are encoded whole; rows that repeat are encoded each, alike; an empty
table gives an empty result. Kept columns with the name of a result column are an error;
others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, disjoint

#: Parts and pieces of at most so many characters are remembered, so many of each in a worker.
KEPT_CHARS, KEPT_PARTS, KEPT_PIECES = 40, 300_000, 400_000
#: White space apart from U+0020 and U+000A.
OTHER_SPACE = [chr(c) for c in (9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Pairs of tokens whose compatibility is remembered in each worker.
KEPT_PAIRS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return parse_ranks(lines)


def parse_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The plain definition: merge the adjacent pair of lowest rank, leftmost first, while there is one."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Codec:
    """Encodes and decodes with one vocabulary and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        # \s of the library is White_Space; here it would also take U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.cut = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})").split
        self.bytes = {i: b for b, i in ranks.items()}
        self.packed = {b: struct.pack("<I", i) for b, i in ranks.items()}
        self.found = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.found.add_word(b.decode("latin-1"), (len(b), i))
        self.found.make_automaton()
        self.shorter: dict[bytes, bytes | None] = {}
        self.fit: dict[tuple[bytes, bytes], bool] = {}
        self.parts = _Parts(self)
        self.pieces: dict[str, bytes] = {}

    def _compatible(self, a: bytes, b: bytes) -> bool:
        if (known := self.fit.get((a, b))) is None:
            known = merge(a + b, self.ranks) == [a, b]
            if len(self.fit) < KEPT_PAIRS:
                self.fit[a, b] = known
        return known

    def _shorter(self, token: bytes) -> bytes | None:
        """The longest proper prefix of the token that is a token."""
        if token not in self.shorter:
            self.shorter[token] = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)
        return self.shorter[token]

    def tokens(self, piece: bytes) -> list[bytes]:
        """The tokens of one match of the pattern."""
        if piece in self.ranks:
            return [piece]
        longest = [1] * len(piece)
        for end, (n, _) in self.found.iter(piece.decode("latin-1")):
            longest[end + 1 - n] = n  # matches of one start come in order of length
        out: list[bytes] = []
        at, dead = 0, bytearray(len(piece) + 1)
        token: bytes | None = piece[: longest[0]]
        while True:
            while token is not None and (dead[at + len(token)] or out and not self._compatible(out[-1], token)):
                token = self._shorter(token)
            if token is None:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                token = out.pop()
                at -= len(token)
                token = self._shorter(token)
                continue
            out.append(token)
            at += len(token)
            if at == len(piece):
                return out
            token = piece[at : at + longest[at]]

    def encode_part(self, part: str) -> bytes:
        return b"".join([self.encode_piece(p) for p in self.split(part)])

    def encode_piece(self, piece: str) -> bytes:
        if (out := self.pieces.get(piece)) is None:
            packed = self.packed
            out = b"".join([packed[t] for t in self.tokens(piece.encode())])
            if len(piece) <= KEPT_CHARS and len(self.pieces) < KEPT_PIECES:
                self.pieces[piece] = out
        return out

    def _spaced(self, text: str) -> bool:
        """Whether some space isn't between two characters that aren't white space."""
        return text[:1] == " " or text[-1:] == " " or "  " in text or "\n " in text or " \n" in text or any(c in text for c in OTHER_SPACE)

    def encode(self, text: str) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit integers."""
        if self._spaced(text):
            first, *rest = self.cut(text)
        else:
            first, *rest = text.split(" ")
        get = self.parts.__getitem__
        return self.encode_part(first) + b"".join([get(x) for x in rest])

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in memoryview(ids).cast("I")])


class _Parts(dict):
    """Encodings of a space and the part after it."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, part: str) -> bytes:
        out = self.codec.encode_part(" " + part)
        if len(part) <= KEPT_CHARS and len(self) < KEPT_PARTS:
            self[part] = out
        return out


@lru_cache(maxsize=2)
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(parse_ranks(ranks.splitlines()), pattern)


def _run(ranks: bytes, pattern: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                encoded = [codec.encode(x.as_py() or "") for x in batch.column(0)]
                counts = pa.array([len(x) // 4 for x in encoded], pa.int64())
                if digests:
                    made = [pa.array([hashlib.sha256(x).hexdigest() for x in y]) for y in (encoded, [codec.decode(x) for x in encoded])]
                else:
                    made = [pa.array(encoded, pa.binary()), pa.array([codec.decode(x) for x in encoded], pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], counts, *made], names=[*batch.schema.names[1:], "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])

    return run


def _encoded(docs: DataFrame, path: str, pattern: str, text_col: str, keep: list[str], digests: bool) -> DataFrame:
    with open(path, "rb") as f:  # fixed size, read where the query is planned and sent along with the task
        ranks = f.read()
    bounded_batches(docs.sparkSession)
    kept = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)
    disjoint(keep, ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"])
    made = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary"
    ddl = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes[1:]), "n_tokens long", made])
    return kept.mapInArrow(_run(ranks, pattern, digests), ddl)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, n_tokens, ids (packed little-endian 32-bit) and decoded (the ids' bytes)."""
    return _encoded(docs, path, pattern, text_col, keep if keep is not None else ["doc_id"], digests=False)


def encode_digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As encode(), with SHA-256 of ids and decoded bytes in place of the bytes themselves."""
    return _encoded(docs, path, pattern, text_col, keep if keep is not None else ["doc_id"], digests=True)

from __future__ import annotations

import hashlib
import random

import pytest

from tidering.llm import bpe, common

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def _same(codec, library, text):
    ids = codec.encode(text)
    assert list(memoryview(ids).cast("I")) == library.encode_ordinary(text), text[:80]
    assert codec.decode(ids) == text.encode()


def test_random_texts(codec, library):
    r = random.Random(3)
    some = " \n\t\r  \x0b\x1c\x1d\x1f\x85 ​'sdtlvmABCabcéßñ漢字🙂0١²½.,!?<|endoftext|>-_́\x00"
    for _ in range(6000):
        _same(codec, library, "".join(r.choice(some) for _ in range(r.randrange(25))))
    for _ in range(1500):
        _same(codec, library, "".join(chr(r.choice([r.randrange(0xD800), r.randrange(0xE000, 0x110000), r.randrange(128)])) for _ in range(r.randrange(12))))


@pytest.mark.parametrize("text", ["", " ", "a" * 30_000, " " * 5000, "ab" * 9000 + " x", "the " * 4000, "'" * 300, "=" * 7000, "0" * 4000, "\n" * 900, " a\n b  c", "é" * 5000, "<|endoftext|>"])
def test_long_and_odd_texts(codec, library, text):
    _same(codec, library, text)


def test_pieces_equal_plain_merges(codec):
    r = random.Random(4)
    for _ in range(3000):
        piece = bytes(r.choice(b"etaoinsh rdlu\xc3\xa9\xff") for _ in range(r.randrange(1, 24)))
        assert codec.tokens(piece) == ([piece] if piece in codec.ranks else bpe.merge(piece, codec.ranks))


def test_full_tables_change_nothing(library, monkeypatch):
    for name in ("KEPT_PARTS", "KEPT_PIECES", "KEPT_PAIRS"):
        monkeypatch.setattr(bpe, name, 3)
    small = bpe.Codec(bpe.load_ranks(PATH), P.PATTERN)
    for text in ("some words and other words and some more", "unheard-of wordishness, unheard-of"):
        _same(small, library, text)


def test_table(spark, docs, library, sf):
    d = common.documents(spark, sf).unionByName(docs([(900, None, None, None), (901, "", "x", "y"), (None, "a b", None, None)]))
    got = bpe.encode_digests(d, PATH, P.PATTERN).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in d.collect()]
    assert len(got) == len(texts)
    by = {r["doc_id"]: r for r in got}
    for i, text in texts:
        ids = library.encode_ordinary(text)
        assert by[i]["n_tokens"] == len(ids)
        assert by[i]["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert by[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    whole = bpe.encode(docs(["ab cd"]), PATH, P.PATTERN, keep=["doc_id", "source"]).first()
    assert bytes(whole["decoded"]) == b"ab cd" and whole["source"] == "s" and len(whole["ids"]) == 4 * whole["n_tokens"]
    assert bpe.encode_digests(docs([]), PATH, P.PATTERN).count() == 0

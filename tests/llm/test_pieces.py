"""SentencePiece ids next to the library's own."""

import hashlib
import random

import pytest

from cairn.llm import catalog, pieces


@pytest.fixture(scope="module")
def model():
    return pieces.pieces(pieces.public_file(pieces.MODEL))


@pytest.mark.parametrize(
    "letters",
    ["ab ", "a ", "aeiou tnrs \n", " \n▁a", "the in on er an ", "é中😀\0a b", "<s> </s>0x0A\t "],
)
def test_random_texts(model, letters):
    rnd = random.Random(letters)
    for _ in range(1500):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 90)))
        assert model.encode(text) == model.library.encode(text, add_eos=True), text


def test_long_texts_without_blanks(model):
    for text in ("abcdefghij" * 20_000, " " * 50_000, "\n" * 50_000, "a" * 50_000):
        assert model.encode(text) == model.library.encode(text, add_eos=True)


def test_taken_pieces_are_those_of_merging(model):
    rnd = random.Random(3)
    for _ in range(2000):
        word = "▁" * rnd.randint(0, 3) + "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 25)))
        assert model.split(word) == model.merged(word)


def test_small_caches_change_nothing(model, monkeypatch):
    texts = ["one two three", "two  three\nfour", "one four"] * 3
    want = [model.library.encode(t, add_eos=True) for t in texts]
    monkeypatch.setattr(pieces, "KEPT_WORDS", 2)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 2)
    own = pieces.Pieces(pieces.public_file(pieces.MODEL))
    assert [own.encode(t) for t in texts] == want


def test_rows(spark, documents, model):
    docs = documents(["a b", None, "", "a b", "  x"], ids=[1, 2, None, 1, 3]).withColumn("ids", pieces.F.lit("clash"))
    tokens = pieces.decoded(pieces.encoded(docs))
    rows = sorted((r.doc_id or 0, r.ids, r.text) for r in tokens.collect())
    want = sorted((i, model.library.encode(t, add_eos=True), t) for i, t in [(1, "a b"), (2, ""), (0, ""), (1, "a b"), (3, "  x")])
    assert rows == want
    assert pieces.digest(pieces.decoded(pieces.encoded(docs.limit(0)))).count() == 0


def test_query(spark, small, model):
    texts = {r.doc_id: r.text or "" for r in small.collect()}
    rows = catalog.QUERIES["op13_sentencepiece"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = model.library.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.library.decode(ids).encode()).hexdigest()

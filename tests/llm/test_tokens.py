import zlib

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import packing, token_files
from cairn.llm.tokens import Encoder, public_file

ODD = [
    "", " a", "a ", "a b\nc\n\nd  e", "\n", "\na\nb ", "It's a <|endoftext|> b", "x\ty z　 q", "café Aİİ '  s we'll 123 45",
    "a\x1cb c", "a\0 b", "😀 é, ü! 12.5 |", "a \nb", None, "12a -b 3,4 -- x", "a\x01b \x02c", "naïve ß", "word " * 5000,
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    tool = Encoder(public_file(name))
    for texts in (ODD, ODD[:3], ["plain words, and 12 more."], []):
        ids, sizes = tool.encode(pa.array(texts, pa.string()), 0)
        want = [tool._ids(t or "") + [0] for t in texts]
        assert sizes.tolist() == [len(w) for w in want]
        assert ids.tolist() == sum(want, [])


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_blocks_round_trip(n):
    values = np.random.default_rng(n)
    ids = values.integers(0, 50_000, n).astype(np.uint32)
    ids[::97] = 4_000_000_000
    docs, lengths = [3, None, 7], [n // 2, 0, n - n // 2]
    found, sizes, back = token_files.read_segment(token_files.write_segment(docs, lengths, ids))
    assert found == docs and sizes.tolist() == lengths and back.tolist() == ids.tolist()
    index, data = token_files.pack(ids)
    patches = (len(data) - int(index["width"].astype(int).sum()) * token_files.BLOCK // 8) // 6
    if len(index) > 2:
        some = token_files.unpack(index, data, patches, n, 1, 2)
        assert some[: token_files.BLOCK].tolist() == ids[token_files.BLOCK : 2 * token_files.BLOCK].tolist()


def test_token_files(spark, documents, tmp_path):
    docs = documents(["b c", None, "", "a a a", "a a a"], [5, 1, None, 3, 3])
    token_files.write_token_files(docs, f"{tmp_path}/t")
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, f"{tmp_path}/t").collect())
    tool, at = Encoder(public_file("byte_bpe_50k.json")), 0
    for (key, start, n, crc), text in zip(got, ["", "", "a a a", "a a a", "b c"]):
        ids = np.array(tool._ids(text) + [0], "<u4")
        assert (start, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert [k for k, *_ in got] == [(False, 0), (True, 1), (True, 3), (True, 3), (True, 5)]
    token_files.write_token_files(docs.limit(0), f"{tmp_path}/none")
    assert token_files.read_token_files(spark, f"{tmp_path}/none").count() == 0


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (7, 5, 4, 3)] == [(0, 0), (1, 0), (1, 5), (0, 7)]
    bins = packing.OpenBins(10, 1)
    assert [bins.place(n) for n in (7, 6, 3)] == [(0, 0), (1, 0), (1, 6)]  # the fuller one was closed for the second


def test_packing(documents, small):
    docs = small.unionByName(documents(["x " * 9000, None, "x"], [900_001, 900_002, None]))
    rows = packing.pack_documents(docs, with_ids=True).collect()
    tool, texts = Encoder(public_file("word_bpe_49k.json")), {r.doc_id: r.text for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert set(by_doc) == set(texts)
    for key, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        ids = tool._ids(texts[key] or "") + [0]
        assert sum((list(r.ids) for r in parts), []) == ids
        assert [r.start for r in parts] == list(range(0, len(ids), 2048))
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= 1.03 * sum(r.length for r in rows) / 2048 + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0

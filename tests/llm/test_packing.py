import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from scholia.llm import packing as P
from scholia.llm import tokens as K
from scholia.llm.textbytes import buffer

HARD = ["héllo wörld's 12 don't ### " * 3 + "<|endoftext|> x\n" + "日本語 İx é" * 2, "a" * 100, "'sx 's\n\n" * 9, "", None, "É ÀÞß ×÷ x_y 12ab|<x ''s", "It's\tOK", "\x00 a\x0bb", "ÀÉÎÕÜ" * 3, "a'b"]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(K.tokenizer_path())


@pytest.mark.parametrize(("piece", "most"), [(20, 4), (50, 1_000_000), (1 << 20, 1_000_000)])
def test_ids_are_the_tokenizers(monkeypatch, tok, piece, most):
    monkeypatch.setattr(K, "PIECE", piece)
    monkeypatch.setattr(K, "MOST_WORDS", most)
    enc = K.Encoder(K.tokenizer_path())
    data, offs = buffer(pa.array(HARD * 2))
    out, ptr = enc.encode(data, offs)
    for i, t in enumerate(HARD * 2):
        assert out[ptr[i] : ptr[i + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids + [2]


def test_crc_of_rest():
    raw = bytes(range(256)) * 9
    for k in (0, 1, 64, 1000, len(raw)):
        assert P.crc_of_rest(zlib.crc32(raw), zlib.crc32(raw[:k]), len(raw) - k) == zlib.crc32(raw[k:])


def test_pack_covers_every_id_once(spark, tok):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in base] + [(10_000 + i, t) for i, t in enumerate(HARD)] + [(20_000, "same text"), (20_001, "same text"), (20_002, " ".join(r.text for r in base[:40]))]
    d = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, length int")
    out = P.pack(d, shard_rows=60).toPandas()
    texts = dict(rows)
    for doc_id, own in out.groupby("doc_id"):
        ids = np.array(tok.encode(texts[doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        own = own.sort_values("start")
        assert (own.doc_tokens == len(ids)).all() and own.length.sum() == len(ids) and (own.start == own.length.cumsum() - own.length).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    assert set(out.doc_id) == set(texts)
    size = 0
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 4096
        size += 4096
    assert out.length.sum() / size > 0.9
    again = P.pack(d, shard_rows=60).toPandas()
    key = ["doc_id", "start"]
    assert out.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_neighbours_share_words(spark):
    topics = [" ".join(f"t{k}w{i}" for i in range(200)) for k in range(3)]
    rows = [(i, topics[i % 3]) for i in range(60)]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert (out.groupby("sequence_id").doc_id.apply(lambda x: (x % 3).nunique()) == 1).mean() > 0.7


def test_nulls_repeats_and_empty(spark):
    d = spark.createDataFrame([(None, None), (1, "x"), (1, "x"), (2, "")], "doc_id long, text string")
    out = P.pack(d).collect()
    assert len(out) == 4 and len({r.sequence_id for r in out}) == 1 and sum(r.doc_id is None for r in out) == 1
    assert P.pack(d.limit(0)).count() == 0

import re

import numpy as np
import pyarrow as pa
import pytest

from scholia.llm import textbytes as T

TEXTS = ["Hello, World é-x", "", None, "a" * 100, "  x ", "é" * 30 + " ab", "z", "one two three four five six"] * 4
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("chunk", [5, 17, 1 << 19])
def test_words_match_a_regex(monkeypatch, chunk):
    monkeypatch.setattr(T, "CHUNK", chunk)
    data, offs = T.buffer(pa.array(TEXTS))
    w = T.words(data, offs)
    for i, t in enumerate(TEXTS):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        got = [data[s:e].tobytes().decode().lower() for s, e in zip(w.start[w.ptr[i] : w.ptr[i + 1]], w.end[w.ptr[i] : w.ptr[i + 1]])]
        assert got == [x.lower() for x in WORD.findall(low)]
        assert [T.word_id(x) for x in WORD.findall(low)] == w.h[w.ptr[i] : w.ptr[i + 1]].tolist()


def test_sliced_and_empty_columns():
    a = pa.array(["ab", "cd ef", "gh"]).slice(1, 2)
    data, offs = T.buffer(a)
    assert len(T.words(data, offs).h) == 3
    data, offs = T.buffer(pa.array([], pa.string()))
    assert len(T.words(data, offs).h) == 0 and T.blocks(offs) == []
    data, offs = T.buffer(pa.array([None, None], pa.string()))
    assert T.words(data, offs).ptr.tolist() == [0, 0, 0]


def test_blocks_and_windows():
    offs = np.array([0, 10, 20, 500, 510])
    assert T.blocks(offs, 25) == [(0, 2), (2, 3), (3, 4)]
    h = np.array([1, 2, 3, 1, 2, 3], np.uint64)
    w = T.windows(h, 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 3 and len(T.windows(h, 7)) == 0

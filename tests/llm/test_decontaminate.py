import hashlib
import random
import re

import numpy as np
import pytest

from scholia.llm import decontaminate as D
from scholia.llm.fmindex import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, ids = WORD.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    ids |= wins[x]
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_fm_index_finds_all():
    r = np.random.default_rng(3)
    seq = r.integers(0, 4, 400)
    seq[-1] = 0
    f = FMIndex(seq, 4, sample=3)
    pats = np.array([[1, 2], [3, 3], [2, 1], [1, 1]])
    which, lo, hi = f.ranges(pats)
    for w, a, b in zip(which, lo, hi):
        want = [i for i in range(len(seq) - 1) if seq[i] == pats[w][0] and seq[i + 1] == pats[w][1]]
        assert sorted(f.locate(np.arange(a, b)).tolist()) == want
    assert f.ranges(np.array([[1]]))[0].tolist() == [0]


@pytest.mark.parametrize("block_words", [1_000_000, 6])
def test_scan_equals_brute_force(spark, monkeypatch, block_words):
    monkeypatch.setattr(D, "BLOCK_WORDS", block_words)
    r = random.Random(1)
    vocab = ["a", "b", "c", "Dé", "e1"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(1, text(14)), (2, text(3)), (None, text(12)), (3, None), (10, "..."), (2, text(11)), (5, text(10))]
    docs = [(i, text(r.randint(0, 60)) + r.choice(["", "!", " zz zz"])) for i in range(60)] + [(7, items[0][1].replace('a', 'A').replace('b', 'B')), (None, None), (8, ""), (8, "")]
    docs += [(100, " ".join([items[0][1]] * 400))]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(x) for x in D.scan(spark, d, b).drop("spans").collect()), key=str)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert D.scan(spark, d, b).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(x)[:6] for x in D.scan(spark, one, b).collect()] == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


def test_remove(spark):
    item = " ".join(f"w{i}" for i in range(12))
    clean = "this stays as it is, é. " * 3
    docs = [(1, clean + item + " and so on", "k", 5), (2, clean, "k", 6), (3, item, "k", 7), (4, None, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r for r in D.remove(spark, d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 4} and got[1].text == clean + " and so on" and got[1].n_chars == len(got[1].text)
    assert got[2].text == clean and got[2].lang == "k" and got[4].text is None

"""Language of whole texts, also code-switched ones: a conditional random field over words.

A word's features are its own hash (lexicon), its first and last bytes (affixes), its length,
and all its byte bigrams and trigrams, hashed; learned transitions tie neighbouring words.
Forward-backward gives each word a probability for each language; a text's language is the one
with the largest mean over its words, and that mean is its score. Each distinct word of a block
is scored once.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows, the first by a hash of doc_id of
those that may be learned from (the bound is a parameter), with their whole texts, in one
executor task, which holds the texts and works through them in blocks. It is a table of fixed
size, which is broadcast. Every text is then labelled whole.

Edge cases: a null text and one without a letter are ``und`` with score 0, as is every text
if no row can be learned from; a text of any length is one chain, held in memory; of languages
with equal means the first in the order of their names wins; a null lang is no example; a null
doc_id counts as the text 'null' for the split; repeated rows each get their row; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import map_batches, remainder, thinned
from scholia.llm.crf import Crf, Ragged, marginals
from scholia.llm.textbytes import LETTERS, Words, blocks, buffer, mix, words

SAMPLE_ROWS = 2000
BITS = 18
#: Bytes of text, and words of a chain, that training works on at once; passes over the sample.
TRAIN_BYTES, TRAIN_WORDS, EPOCHS = 1 << 20, 50, 2
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_AFFIX = 4
_LETTER = re.compile(r"[^\W\d_]")


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> Ragged:
    """Feature numbers (from 1) of words: lexicon, length, prefixes of 2 and 3 bytes, suffixes of 2 to 4, all bigrams and trigrams; 0 where a word is too short."""
    low = LETTERS[0]
    size = end - start
    j = np.arange(_AFFIX)
    head = np.where(j < size[:, None], low[data[np.minimum(start[:, None] + j, len(data) - 1)]], 0).astype(np.uint64)
    tail = np.where(j < size[:, None], low[data[np.maximum(end[:, None] - 1 - j, 0)]], 0).astype(np.uint64)
    one = np.uint64(1)

    def hashed(kind: int, key: np.ndarray, has: np.ndarray) -> np.ndarray:
        return np.where(has, (mix(key * np.uint64(64) + np.uint64(kind)) % np.uint64((1 << BITS) - 1) + one), 0).astype(np.int64)

    def packed(cols: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cols), np.uint64)
        for c in range(cols.shape[1]):
            out = out * np.uint64(256) + cols[:, c]
        return out

    fixed = [hashed(1, h, size > 0), hashed(2, np.minimum(size, 15).astype(np.uint64), size > 0)]
    fixed += [hashed(10 + k, packed(head[:, :k]), size >= k) for k in (2, 3)]
    fixed += [hashed(20 + k, packed(tail[:, :k]), size >= k) for k in (2, 3, 4)]
    many = [np.maximum(size - k + 1, 0) for k in (2, 3)]
    ptr = np.concatenate([[0], np.cumsum(len(fixed) + many[0] + many[1])])
    idx = np.empty(ptr[-1], np.int64)
    for c, col in enumerate(fixed):
        idx[ptr[:-1] + c] = col
    begin = ptr[:-1] + len(fixed)
    for k, n in zip((2, 3), many):
        stop = np.cumsum(n)
        place = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - n, n)
        at = np.repeat(start, n) + place
        idx[np.repeat(begin, n) + place] = hashed(30 + k, packed(np.stack([low[data[at + i]] for i in range(k)], axis=1).astype(np.uint64)), np.ones(len(at), bool))
        begin = begin + n
    return Ragged(ptr, idx)


def _distinct(data: np.ndarray, w: Words) -> tuple[Ragged, np.ndarray]:
    """(features of the distinct words, the number of each word among them)."""
    _, at, inv = np.unique(w.h, return_index=True, return_inverse=True)
    return features(data, w.start[at], w.end[at], w.h[at]), inv


def fit(texts: list[str], langs: list[str]) -> Crf | None:
    """A model from whole texts with their languages."""
    labels = sorted(set(langs))
    if not labels:
        return None
    data, offs = buffer(pa.array(texts, pa.large_string()))
    gold = np.searchsorted(labels, langs)
    model = Crf(labels, BITS)
    for _ in range(EPOCHS):
        for a, b in blocks(offs, TRAIN_BYTES):
            w = words(data, offs[a : b + 1], LETTERS)
            if len(w.h):
                feats, row = _distinct(data, w)
                # chains of a sentence's length, for steps of even size
                cuts = np.unique(np.concatenate([w.ptr, *[np.arange(x, y, TRAIN_WORDS) for x, y in zip(w.ptr[:-1], w.ptr[1:])]]))
                model.train(feats, np.repeat(gold[a:b], np.diff(w.ptr)), cuts, epochs=1, row=row)
    model.squares = None
    return model


def _fit_task(batches):
    texts, langs = [], []
    for pdf in batches:
        texts += pdf["text"].tolist()
        langs += pdf["lang"].tolist()
    yield pd.DataFrame({"model": [pickle.dumps(fit(texts, langs))]})


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Crf | None:
    """Fit on a bounded sample of labelled training rows, in a task; only the weights come back."""
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).where((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = thinned(rows, "doc_id", sample_rows).orderBy(F.xxhash64("doc_id"), "doc_id", F.md5("text")).limit(sample_rows).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    got = rows.repartition(1).mapInPandas(_fit_task, "model binary").collect()
    return pickle.loads(got[0].model) if got else None


def label_block(model: Crf, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Mean label probabilities of each text's words (rows of zeros: no words)."""
    w = words(data, offs, LETTERS)
    n = np.diff(w.ptr)
    if not len(w.h):
        return np.zeros((len(n), len(model.labels)))
    feats, row = _distinct(data, w)
    scores = model.scores(feats)[row]
    m = np.concatenate([np.zeros((1, len(model.labels))), np.cumsum(marginals(scores, w.ptr, model.trans), axis=0)])
    return (m[w.ptr[1:]] - m[w.ptr[:-1]]) / np.maximum(n, 1)[:, None]


def identify(spark: SparkSession, docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = spark.sparkContext.broadcast(train(docs, sample_rows))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model.value
        data, offs = buffer(batch.column(1))
        lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
        for a, b in blocks(offs, 2 << 20) if m else []:
            p = label_block(m, data, offs[a : b + 1])
            best = p.argmax(axis=1)
            for i in range(b - a):
                top = p[i, best[i]]
                if top > 0 and _LETTER.search(data[offs[a + i] : offs[a + i + 1]].tobytes().decode("utf-8", "replace")):
                    lang[a + i], score[a + i] = m.labels[best[i]], min(1.0, top)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (remainder("doc_id", 4) == 2).alias("held_out"))
    return map_batches(d, run, SCHEMA)

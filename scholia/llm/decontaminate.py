"""Benchmark decontamination by an FM-index for each shard of training text.

A shard is a block of whole documents inside one task, so that nothing is shuffled. Its words
become numbers of the benchmark's vocabulary; words outside it are separators, and stretches
between separators that are shorter than the shortest window hold no match and are left out
(nothing is lost: a match never crosses a separator). An FM-index over the rest takes each
benchmark window by backward search through the ranks of a wavelet matrix, locates the
occurrences by sampled suffix positions, and the occurrences merge into removal spans.

The benchmark is a stated query set. It goes to the tasks in blocks of at most
``BLOCK_WORDS`` words, each a broadcast of bounded size that is loaded by itself; the
documents are still read once. A shard is indexed anew for each block, and the sum of the
blocks grows with the benchmark, which passes through the driver once: the method is meant for
benchmarks of up to some hundred million words against any number of documents.

Edge cases: a null or empty text has no words and no hits; a text of any length is one shard,
in memory; occurrences that overlap are one span; a null benchmark text has no windows; an item
without an id counts under the empty id; items with one id are one item; repeated document rows
each get their row; an empty table of documents gives no rows; other columns are ignored by
``scan`` and kept by ``remove``; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import map_batches
from scholia.llm.fmindex import FMIndex
from scholia.llm.textbytes import ALNUM, Words, blocks, buffer, words

WINDOW = 10
BLOCK_WORDS = 1_000_000
SHARD_BYTES = 2 << 20
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"


@dataclass
class Patterns:
    """Windows of a block of items over the block's vocabulary (numbers from 1)."""

    vocab: np.ndarray
    by_len: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # length, windows, and items of each as (pointers, numbers)
    ids: list[str]

    @property
    def shortest(self) -> int:
        return min(x[0] for x in self.by_len)


def compile_items(items: list[tuple[str, str | None]], window: int = WINDOW) -> Patterns | None:
    """None if no item has a word."""
    texts = pa.array([t or "" for _, t in items], pa.string())
    w = words(*buffer(texts), ALNUM)
    if not len(w.h):
        return None
    vocab, sym = np.unique(w.h, return_inverse=True)
    sym = sym.astype(np.int64) + 1
    ids = sorted({i for i, _ in items})
    number = {x: k for k, x in enumerate(ids)}
    found: dict[int, dict[tuple, set[int]]] = {}
    for k, (item, _) in enumerate(items):
        own = sym[w.ptr[k] : w.ptr[k + 1]]
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            found.setdefault(n, {}).setdefault(tuple(own[i : i + n].tolist()), set()).add(number[item])
    by_len = []
    for n, wins in sorted(found.items()):
        per = [sorted(x) for x in wins.values()]
        by_len.append((n, np.array(list(wins), np.int64).reshape(-1, n), np.concatenate([[0], np.cumsum([len(x) for x in per])]), np.concatenate(per).astype(np.int64)))
    return Patterns(vocab, by_len, ids)


def search(w: Words, pats: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length) of the occurrences in a shard, then distinct (document, item number) pairs."""
    none = np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(pats.vocab, w.h), len(pats.vocab) - 1)
    known = pats.vocab[at] == w.h
    starts = known.copy()
    starts[1:] &= ~known[:-1]
    first = w.ptr[:-1]
    first = first[first < len(known)]
    starts[first] = known[first]
    pos = np.flatnonzero(known)
    if not len(pos):
        return none, none, none, none
    run = np.cumsum(starts)[pos] - 1
    keep = (np.bincount(run) >= pats.shortest)[run]
    pos, run = pos[keep], run[keep]
    if not len(pos):
        return none, none, none, none
    fresh = np.concatenate([[True], run[1:] != run[:-1]])
    place = np.arange(len(pos)) + np.cumsum(fresh) - 1  # one separator after each stretch
    seq = np.zeros(place[-1] + 2, np.int64)
    seq[place] = at[pos] + 1
    word_at = np.zeros(len(seq), np.int64)
    word_at[place] = pos
    index = FMIndex(seq, len(pats.vocab) + 1)
    spot, size, docs, items = [none], [none], [none], [none]
    for n, wins, ptr, item in pats.by_len:
        which, lo, hi = index.ranges(wins)
        many = hi - lo
        if not many.sum():
            continue
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        p = word_at[index.locate(rows)]
        spot.append(p)
        size.append(np.full(len(p), n))
        doc, win = np.searchsorted(w.ptr, p, "right") - 1, np.repeat(which, many)
        pair = np.unique(doc * len(wins) + win)
        doc, win = pair // len(wins), pair % len(wins)
        k = ptr[win + 1] - ptr[win]
        docs.append(np.repeat(doc, k))
        items.append(item[np.repeat(ptr[win] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())])
    pair = np.unique(np.concatenate(docs) * len(pats.ids) + np.concatenate(items))
    return np.concatenate(spot), np.concatenate(size), pair // len(pats.ids), pair % len(pats.ids)


def hits(w: Words, spot: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each word, whether an occurrence covers it."""
    edge = np.bincount(spot, minlength=len(w.h) + 1) - np.bincount(spot + size, minlength=len(w.h) + 1)
    return np.cumsum(edge[: len(w.h)]) > 0


def shards(column: pa.Array, compiled: list) -> "Iterator[tuple[int, int, Words, np.ndarray, dict[int, set[str]]]]":
    """(first row, end, words, hit words, items by row) of each shard of a batch."""
    data, offs = buffer(column)
    for a, b in blocks(offs, SHARD_BYTES):
        w = words(data, offs[a : b + 1], ALNUM)
        hit, items = np.zeros(len(w.h), bool), {}
        for block in compiled:
            pats = block.value
            spot, size, docs, item = search(w, pats) if len(w.h) else (np.zeros(0, np.int64),) * 4
            if len(spot):
                hit |= hits(w, spot, size)
            for d, k in zip(docs.tolist(), item.tolist()):
                items.setdefault(d, set()).add(pats.ids[k])
        yield a, b, w, hit, items


def removal_spans(w: Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first byte, end) of runs of hit words within a text."""
    k = np.flatnonzero(hit)
    doc = np.searchsorted(w.ptr, k, "right") - 1
    if not len(k):
        return k, k, k
    cut = np.concatenate([[True], (k[1:] != k[:-1] + 1) | (doc[1:] != doc[:-1])])
    end = np.concatenate([cut[1:], [True]])
    return doc[cut], w.start[k[cut]], w.end[k[end]]


def compiled_blocks(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW) -> list:
    """Broadcasts of at most BLOCK_WORDS words each, filled from an iterator over the benchmark."""
    out, items, n = [], [], 0

    def close() -> None:
        nonlocal items, n
        if items and (p := compile_items(items, window)):
            out.append(spark.sparkContext.broadcast(p))
        items, n = [], 0

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t"))
    for i, t in rows.toLocalIterator():
        items.append((i, t))
        n += len(t or "") // 2 + 1
        if n >= BLOCK_WORDS:
            close()
    close()
    return out


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: its words, hit words, matched items, and removal spans (bytes, ``start:end`` comma-joined)."""
    compiled = compiled_blocks(spark, benchmark, window)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        n_words, n_hit, n_items = (np.zeros(n, np.int64) for _ in range(3))
        digest, spans = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
        _, offs = buffer(batch.column(1))
        for a, b, w, hit, items in shards(batch.column(1), compiled):
            n_words[a:b] = np.diff(w.ptr)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit[a:b] = total[w.ptr[1:]] - total[w.ptr[:-1]]
            for d, own in items.items():
                n_items[a + d] = len(own)
                digest[a + d] = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
            for d, s, e in zip(*(x.tolist() for x in removal_spans(w, hit))):
                spans[a + d] += f"{',' if spans[a + d] else ''}{s - offs[a + d]}:{e - offs[a + d]}"
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(digest, pa.string()), pa.array(n_hit > 0), pa.array(spans, pa.string())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)


def remove(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with their removal spans cut out of ``text`` (and ``n_chars``, where there is one, set anew); one whose text is all benchmark goes, as does what keeps fewer than half its words."""
    compiled = compiled_blocks(spark, benchmark, window)
    names = docs.columns
    t = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.ones(batch.num_rows, bool)
        changed: dict[int, bytes] = {}
        data, offs = buffer(batch.column(t))
        for a, _b, w, hit, _items in shards(batch.column(t), compiled):
            total = np.concatenate([[0], np.cumsum(hit)])
            own = total[w.ptr[1:]] - total[w.ptr[:-1]]
            all_words = np.diff(w.ptr)
            for d, s, e in zip(*(x.tolist() for x in removal_spans(w, hit))):
                row = a + d
                if 2 * own[d] > all_words[d]:
                    keep[row] = False
                    continue
                done, at = changed.get(row, (b"", int(offs[row])))
                changed[row] = (done + data[at:s].tobytes(), e)
        columns = list(batch.columns)
        if changed:
            texts = columns[t].to_pylist()
            for row, (done, at) in changed.items():
                texts[row] = (done + data[at : offs[row + 1]].tobytes()).decode("utf-8", "replace")
            columns[t] = pa.array(texts, batch.schema.field(t).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    out = map_batches(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out

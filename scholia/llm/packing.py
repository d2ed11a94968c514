"""Lexical retrieval packing: windows filled with a seed document's BM25 neighbours.

Documents are dealt to shards of about ``SHARD_ROWS`` by a hash of their id and text, so that
no source or group of copies gathers in one. Each shard has an inverted index over its
documents' words (by 32 bits of a word's hash) with BM25 weights. A seed document opens a
window; the unused documents that BM25 ranks next to it fill it, best first, whole while they
fit. What is left goes to the best neighbour that did not fit: it is cut at a multiple of
``GRAIN`` ids, and its rest seeds the next window. A document's full windows are sequences of
their own.

A seed sees the neighbours of its own shard only, and its words that more than half of the
shard holds are left out of its query: their weight is below ln 2, and their postings would be
most of the work. Where nothing else is shared, documents fill windows in the order of their
ids. Both concern which neighbours stand together, not what is packed: every id is.

The tokens are made once, before the shuffle; shards see only counts, word hashes and running
checksums at each cut point, from which a piece's checksum follows without its ids.

Edge cases: a null or empty text is the end id alone; a text of any length is read whole, in
memory, and gives full windows and one rest; a null doc_id stays null; repeated rows are each
packed; neighbours with equal scores go in order of id and length; documents without words have
no neighbours and fill windows in order; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import map_batches, partitions
from scholia.llm.textbytes import ALNUM, blocks, buffer, words
from scholia.llm.tokens import encoder, tokenizer_path

WINDOW = 4096
GRAIN = 16
BLOCK_BYTES = 1 << 20
SHARD_ROWS = 2000
K1, B = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(64)
def _shift(n: int) -> tuple[int, ...]:
    """What n zero bytes do to each bit of a CRC-32."""
    if n == 1:
        return tuple(((1 << i) >> 8) ^ _byte((1 << i) & 255) for i in range(32))
    half = _shift(n // 2)
    twice = tuple(_apply(half, x) for x in half)
    return twice if n % 2 == 0 else tuple(_apply(_shift(1), x) for x in twice)


def _byte(x: int) -> int:
    for _ in range(8):
        x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
    return x


def _apply(m: tuple[int, ...], x: int) -> int:
    out, i = 0, 0
    while x:
        if x & 1:
            out ^= m[i]
        x >>= 1
        i += 1
    return out


def crc_of_rest(all_: int, first: int, n: int) -> int:
    """CRC-32 of the last n bytes, from that of all and that of what stands before them."""
    k, bit = first, 1
    while n:
        if n & 1:
            k = _apply(_shift(bit), k)
        n >>= 1
        bit <<= 1
    return all_ ^ k


def _tokens(path: str):
    """Batches of (doc_id, text, shard) to what the packer needs of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(path)
        data, offs = buffer(batch.column(1))
        n_ids, full, tail, terms, counts = [], [], [], [], []
        for a, b in blocks(offs, BLOCK_BYTES):
            own = offs[a : b + 1]
            ids, ptr = enc.encode(data, own)
            w = words(data, own, ALNUM)
            doc = np.repeat(np.arange(b - a), np.diff(w.ptr))
            # (document, word) pairs in order, a word by 32 bits of its hash: equal ones are counted
            pair = (doc.astype(np.uint64) << np.uint64(32)) | (w.h >> np.uint64(32))
            pair.sort()
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
            tf = np.diff(np.append(first, len(pair))).astype(np.uint32)
            pair = pair[first]
            at = np.searchsorted(pair, np.arange(b - a + 1).astype(np.uint64) << np.uint64(32))
            term = (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            raw = memoryview(ids.astype("<u4")).cast("B")
            for i in range(b - a):
                p, q = int(ptr[i]), int(ptr[i + 1])
                whole = (q - p) // WINDOW
                full.append(np.array([zlib.crc32(raw[4 * (p + j * WINDOW) : 4 * (p + (j + 1) * WINDOW)]) for j in range(whole)], np.uint32).tobytes())
                crc, cs = 0, []
                for j in range(p + whole * WINDOW, q, GRAIN):
                    crc = zlib.crc32(raw[4 * j : 4 * min(q, j + GRAIN)], crc)
                    cs.append(crc)
                tail.append(np.array(cs, np.uint32).tobytes())
                n_ids.append(q - p)
                terms.append(term[at[i] : at[i + 1]].tobytes())
                counts.append(tf[at[i] : at[i + 1]].tobytes())
        return pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(n_ids, pa.int64()), *(pa.array(x, pa.binary()) for x in (full, tail, terms, counts))], ["shard", "doc_id", "n", "full", "tail", "terms", "counts"])

    return run


class Bm25:
    """An inverted index over one shard: postings by term, with each posting's weight."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray]):
        n = len(terms)
        size = np.array([len(t) for t in terms])
        doc = np.repeat(np.arange(n), size)
        term = np.concatenate(terms) if n else np.zeros(0, np.uint32)
        tf = (np.concatenate(counts) if n else np.zeros(0, np.uint32)).astype(np.float64)
        length = np.bincount(doc, tf, minlength=n)
        order = np.argsort(term, kind="stable")
        _, first, df = np.unique(term[order], return_index=True, return_counts=True)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.n, self.doc = n, doc[order]
        self.first, self.df = first, df
        norm = K1 * (1 - B + B * length / max(1.0, length.mean() if n else 1.0))
        self.weight = np.repeat(idf, df) * tf[order] * (K1 + 1) / (tf[order] + norm[self.doc])
        number = np.repeat(np.arange(len(df)), df)
        self.own = np.empty(len(term), np.int64)
        self.own[order] = number
        self.ptr = np.concatenate([[0], np.cumsum(size)])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents for the seed's words; words that most documents hold say nothing and are left out."""
        q = self.own[self.ptr[seed] : self.ptr[seed + 1]]
        q = q[2 * self.df[q] <= self.n + 1]
        many = self.df[q]
        if not len(q):
            return np.zeros(self.n)
        end = np.cumsum(many)
        at = np.repeat(self.first[q] - end + many, many) + np.arange(end[-1])
        return np.bincount(self.doc[at], self.weight[at], minlength=self.n)


def _pack_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """All pieces of one shard; the order of its rows does not matter."""
    pdf = pdf.sort_values(["doc_id", "n", "tail", "full"], kind="stable").reset_index(drop=True)
    ids, n = pdf["doc_id"].tolist(), pdf["n"].tolist()
    index = Bm25([np.frombuffer(x, np.uint32) for x in pdf["terms"]], [np.frombuffer(x, np.uint32) for x in pdf["counts"]])
    out: list[tuple] = []
    seq = int(key[0]) << 32

    rest = np.zeros(len(n), np.int64)  # ids that wait for a place, at the end of each document
    for i, raw in enumerate(pdf["full"]):
        for j, crc in enumerate(np.frombuffer(raw, np.uint32).tolist()):
            out.append((ids[i], j * WINDOW, WINDOW, crc, n[i], seq, 0))
            seq += 1
        rest[i] = n[i] % WINDOW
    tails = [np.frombuffer(x, np.uint32) for x in pdf["tail"]]
    size = rest.copy()
    at = 0

    def place(i: int, length: int) -> None:
        nonlocal at
        a = int(size[i] - rest[i])  # within the tail, a multiple of GRAIN
        b = a + length
        crc = int(tails[i][-(-b // GRAIN) - 1])
        if a:
            crc = crc_of_rest(crc, int(tails[i][a // GRAIN - 1]), 4 * length)
        out.append((ids[i], n[i] - int(size[i]) + a, length, crc, n[i], seq, at))
        rest[i] -= length
        at += length

    queue, seed = 0, -1
    while True:
        if seed < 0 or not rest[seed]:
            while queue < len(n) and not rest[queue]:
                queue += 1
            if queue == len(n):
                break
            seed = queue
        first, seed, at = seed, -1, 0
        place(first, int(rest[first]))
        score = index.scores(first)
        unused = np.flatnonzero(rest)
        unused = unused[np.argsort(-score[unused], kind="stable")]
        least, misfit = int(rest[unused].min()) if len(unused) else 0, -1
        for i in unused.tolist():
            if WINDOW - at < (least if misfit >= 0 else 1):
                break
            if rest[i] <= WINDOW - at:
                place(i, int(rest[i]))
            elif misfit < 0:
                misfit = i
        room = (WINDOW - at) // GRAIN * GRAIN
        if misfit >= 0:
            if room:
                place(misfit, min(room, int(rest[misfit])))
            seed = misfit
        seq += 1
    frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return frame.astype({"doc_id": "Int64"})


def pack(docs: DataFrame, tokenizer: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece of (doc_id, text): where it stands in its document and in its sequence."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shards = partitions(d.count(), shard_rows)
    d = d.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))
    made = map_batches(d, _tokens(tokenizer or tokenizer_path()), "shard long, doc_id long, n long, full binary, tail binary, terms binary, counts binary")
    return made.groupBy("shard").applyInPandas(_pack_shard, SCHEMA)

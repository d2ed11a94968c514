"""Batches of queries: every document is scored where it lies, and a task passes on its best of each query only.

All that a document's scores need is in its own row, but for the weights of the queries' terms, of
which there are few. So no posting and no pair of a query and a document is shuffled, and disk
does not grow with the number of pairs. The arithmetic is that of ``functions.scoring``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scholia.functions import scoring
from scholia.operators.index import Index
from scholia.session import share_code

#: Fewer query terms make few pairs, which are joined and summed as a plan; more of them, or more results, are not held by each task.
FEW_TERMS, MOST_TERMS, MOST_BEST = 64, 1_000_000, 1_000_000
#: Tokens, and pairs of a document and a query with the addends to them, that a worker works on at once (a single document may have more).
TOKENS, CELLS = 1 << 18, 1 << 19


@dataclass
class Terms:
    """The terms that queries and corpus share: weights by field and term, and each term's queries with the times that they repeat it, from ptr[term] to ptr[term + 1]."""

    words: pa.Array
    weights: dict[str, tuple[float, float, np.ndarray]]  # by field: boost, mean length, idf by term
    ptr: np.ndarray
    query: np.ndarray
    times: np.ndarray
    query_ids: pa.Array


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half up by the shortest decimal form, as Spark rounds; scores are not negative."""
    scaled = x * 10.0**digits
    low = np.floor(scaled)
    out = np.floor(scaled + 0.5) / 10.0**digits
    for i in np.flatnonzero(np.abs(scaled - low - 0.5) <= 1e-3 + 4 * np.spacing(scaled)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


class Best:
    """The k best documents of each query so far, by rounded score and then by id; rows are gathered and thinned out now and then."""

    def __init__(self, queries: int, k: int, digits: int | None) -> None:
        self.k, self.digits, self.held, self.limit = k, digits, 0, max(CELLS // 4, 2 * queries * k)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.least = np.full(queries, -np.inf)

    def add(self, scores: np.ndarray, found: np.ndarray, ids: np.ndarray) -> None:
        """scores, found: by document and query."""
        near = 0.0 if self.digits is None else 10.0**-self.digits
        row, query = np.nonzero(found & (scores >= self.least - near))
        self.parts.append((query, scores[row, query], ids[row]))
        self.held += len(row)
        if self.held > self.limit:
            self.thin()

    def thin(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, score and id of what is still among the best."""
        query, score, ids = (np.concatenate(x) for x in zip(*self.parts))
        by = score if self.digits is None else rounded(score, self.digits)
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -by, query))
        starts = np.flatnonzero(np.diff(query[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
        kept, last = order[place < self.k], order[place == self.k - 1]
        self.least[query[last]] = by[last]
        self.parts, self.held = [(query[kept], score[kept], ids[kept])], len(kept)
        return self.parts[0]


def _parts(batch: pa.RecordBatch, t: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, score) by document and term: the best field and a tenth of the others."""
    keys, scores = [], []
    for field, (boost, mean, idf) in t.weights.items():
        tokens = batch.column(field)
        length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        code = pc.fill_null(pc.index_in(tokens.flatten(), value_set=t.words), -1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(code >= 0)
        key, tf = np.unique(np.repeat(np.arange(len(length)), length)[at] * len(t.words) + code[at], return_counts=True)
        keys.append(key)
        scores.append(boost * (idf[key % len(t.words)] * scoring.tf_weight(tf, length[key // len(t.words)], mean)))
    key, score = np.concatenate(keys), np.concatenate(scores)
    order = np.argsort(key, kind="stable")
    key, starts = np.unique(key[order], return_index=True)
    if len(key):
        score = scoring.dismax(np.maximum.reduceat(score[order], starts), np.add.reduceat(score[order], starts))
    return key // len(t.words), key % len(t.words), score


def _cuts(cost: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows whose costs sum to about most."""
    ends = [*np.flatnonzero(np.diff(np.cumsum(cost) // most)) + 1, len(cost)]
    return list(zip([0, *ends], ends))


def _blocks(batch: pa.RecordBatch, t: Terms) -> Iterator[pa.RecordBatch]:
    lengths = [pc.fill_null(pc.list_value_length(batch.column(f)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for f in t.weights]
    for first, end in _cuts(sum(lengths), TOKENS):
        yield batch.slice(first, end - first)


def _give_back() -> None:
    """Return what freed arrays took to the machine: a worker lives on for the next tasks, beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _score(batch: pa.RecordBatch, t: Terms, out: Best) -> None:
    doc, term, score = _parts(batch, t)
    ids, n = batch.column("id").to_numpy(zero_copy_only=False), len(t.query_ids)
    fan = t.ptr[term + 1] - t.ptr[term]
    for first, end in _cuts(n + np.bincount(doc, fan, batch.num_rows).astype(np.int64), CELLS):
        own = slice(*np.searchsorted(doc, (first, end)))
        many = fan[own]
        row = np.repeat(np.arange(len(many)), many)
        at = np.arange(len(row)) - (np.cumsum(many) - many - t.ptr[term[own]])[row]
        cell = ((doc[own] - first) * n)[row] + t.query[at]
        found = np.zeros((end - first) * n, bool)
        found[cell] = True
        total = np.bincount(cell, score[own][row] * t.times[at], len(found))
        out.add(total.reshape(-1, n), found.reshape(-1, n), ids[first:end])


def _terms(index: Index, asked: DataFrame, boosts: dict[str, float]) -> Terms | None:
    """asked: query_id, term, times. None: no document has any."""
    q = asked.toArrow()
    words = F.broadcast(asked.select("term").distinct())
    once = index.tokens.select("field", F.explode(F.array_distinct("tokens")).alias("term")).join(words, "term", "left_semi")
    df = once.groupBy("field", "term").agg(F.count("*").alias("df")).join(F.broadcast(index.fields), "field")
    found = df.select("field", "term", "mean", scoring.idf(F.col("n"), F.col("df")).alias("idf")).toArrow().combine_chunks()
    if not found.num_rows:
        return None
    vocabulary = pc.unique(found["term"])
    code, idf = (x.to_numpy() for x in (pc.index_in(found["term"], value_set=vocabulary), found["idf"]))
    weights = {}
    for field in pc.unique(found["field"]).to_pylist():
        own = pc.equal(found["field"], field).to_numpy()
        by_term = np.zeros(len(vocabulary))
        by_term[code[own]] = idf[own]
        weights[field] = (boosts.get(field, 0.0), found["mean"].to_numpy()[own][0], by_term)
    query_ids = pc.unique(q["query_id"])
    at = pc.fill_null(pc.index_in(q["term"], value_set=vocabulary), -1).to_numpy()
    query, times = pc.index_in(q["query_id"], value_set=query_ids).to_numpy(), q["times"].to_numpy()
    order = np.lexsort((query, at))[np.count_nonzero(at < 0) :]
    return Terms(vocabulary, weights, np.searchsorted(at[order], np.arange(len(vocabulary) + 1)), query[order], times[order], query_ids)


def best(index: Index, docs: DataFrame, terms: DataFrame, k: int, boosts: dict[str, float], digits: int | None = None) -> DataFrame | None:
    """(query_id, id, score) of docs, rows of the index: among them the k best of each query. terms: query_id, term, a row for each time.

    None if the index has no texts, or the batch is too small or too large for this way. An id names one row.
    """
    if index.analysed is None:
        return None
    asked = terms.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    n = asked.agg(F.count("*").alias("terms"), F.count_distinct(F.struct("query_id")).alias("queries")).first()
    if not FEW_TERMS < n.terms <= MOST_TERMS or n.queries * k > MOST_BEST:
        return None
    spark = docs.sparkSession
    share_code(spark)
    shape = StructType([terms.schema["query_id"], StructField("id", docs.schema["id"].dataType), StructField("score", DoubleType())])
    made = _terms(index, asked, boosts)
    if made is None:
        return spark.createDataFrame([], shape)
    shared = spark.sparkContext.broadcast(made)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, kind = shared.value, None
        out = Best(len(t.query_ids), k, digits)
        for batch in batches:
            if batch.num_rows:
                kind = batch.schema.field("id").type
                for block in _blocks(batch, t):
                    _score(block, t, out)
            batch = block = None
            _give_back()
        if out.parts:
            query, score, ids = out.thin()
            yield pa.RecordBatch.from_arrays([t.query_ids.take(pa.array(query)), pa.array(ids, kind), pa.array(score)], ["query_id", "id", "score"])

    texts = docs.where(F.col("id").isNotNull()).select("id", *(index.analysed[f].alias(f) for f in made.weights))
    return texts.mapInArrow(task, shape)

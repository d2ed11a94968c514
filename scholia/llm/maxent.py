"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

p(word | history) = p(class | history) * p(slot | class, history) * p(word | slot). Both
softmaxes are maximum entropy over hashed features of the history: for the class the last word,
the last two words (n-grams) and the word before the last (skip); for the slot within the class
the last word and the word before the last, each together with the class. A word's class comes
from its last bytes and length, its slot from a hash of it; the end of a text is a class of its
own. Words that share one of the ``CLASSES * SLOTS`` slots have their smoothed share of the
training counts in it, unknown words included, so that all words' probabilities sum to 1: this
last factor has no features. The feature tables have a fixed size, so on a large corpus many
rare histories share a row; the counts grow with the corpus.

Training: in each round every task takes gradient steps over its own documents from the
round's common weights, and the weights that the tasks end with are averaged by their tokens,
in a tree of tasks. Each training document is used in one of the ``ROUNDS`` rounds.

Counts: documents are dealt by a hash to parts of about ``PART_BYTES``; a part asks for each of
its distinct words once, in packed arrays by bucket of the word's hash, so a frequent word costs
one entry per part and not per text. A bucket adds up its words' counts over all parts and
answers each part. Texts go through one shuffle, used by both steps.

Edge cases: a null or empty text is its end alone; a text of any length is scored whole, in the
memory of its part's task; without training documents all counts are 0 and base scores 0; words
that tie are not told apart; a null doc_id counts as the text 'null' for the split; repeated
rows each get their row and count; other columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import PACKED, cut, packed_batch, partitions, remainder, tree_sum
from scholia.llm.textbytes import NONSPACE, blocks, buffer, mix, words

CLASSES, SLOTS = 32, 32
#: Rows of each kind of features, of classes and of slots.
CLASS_BITS, SLOT_BITS = 13, 14
ROUNDS = 2
RATE = 0.5
BATCH = 1 << 13
PART_BYTES, PART_ROWS = 13_000_000, 16_000
BLOCK_BYTES = 1 << 19
#: The end's id as a token.
END = np.uint64(0x5851F42D4C957F2D)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: One table: a row of biases and three kinds of features for classes, then a row of biases for each class and two kinds for slots.
_SLOT0 = 1 + 3 * (1 << CLASS_BITS)
_ROWS = _SLOT0 + CLASSES + 2 * (1 << SLOT_BITS)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, classes, first token of each text and the end); each text ends with END."""
    w = words(data, offs, NONSPACE)
    n = len(offs) - 1
    low = NONSPACE[0]
    size = w.end - w.start
    tail = low[data[w.end - 1]].astype(np.uint64) * np.uint64(256) if len(w.h) else np.zeros(0, np.uint64)
    if len(w.h):
        tail += np.where(size > 1, low[data[np.maximum(w.end - 2, 0)]], 0).astype(np.uint64)
    kind = (mix(tail * np.uint64(8) + np.minimum(size, 7).astype(np.uint64)) % np.uint64(CLASSES - 1)).astype(np.int64)
    ptr = w.ptr + np.arange(n + 1)
    ids, cls = np.full(ptr[-1], END), np.full(ptr[-1], CLASSES - 1, np.int64)
    at = np.arange(len(w.h)) + np.repeat(np.arange(n), np.diff(w.ptr))
    ids[at], cls[at] = w.h, kind
    return ids, cls, ptr


def slots(ids: np.ndarray) -> np.ndarray:
    """The slot of each token within its class."""
    return (mix(ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(5)) % np.uint64(SLOTS)).astype(np.int64)


def histories(ids: np.ndarray, cls: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for each token: (for its class, for its slot). The history is of the same text."""
    first = np.zeros(len(ids), bool)
    first[ptr[:-1]] = True
    one = np.zeros_like(ids)
    one[1:] = ids[:-1]
    one[first] = 1
    two = np.zeros_like(ids)
    two[1:] = one[:-1]
    two[first] = 2
    a, b = mix(one), mix(two * np.uint64(17))
    mask = np.uint64((1 << CLASS_BITS) - 1)
    for_class = np.empty((4, len(ids)), np.int64)
    for_class[0] = 0
    for k, key in enumerate((a, mix(one * np.uint64(31) + mix(two)), b)):
        for_class[k + 1] = (key & mask).astype(np.int64) + 1 + (k << CLASS_BITS)
    mask, c = np.uint64((1 << SLOT_BITS) - 1), cls.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for_slot = np.empty((3, len(ids)), np.int64)
    for_slot[0] = _SLOT0 + cls
    for k, key in enumerate((a, b)):
        for_slot[k + 1] = (((key + c) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS) & mask).astype(np.int64) + _SLOT0 + CLASSES + (k << SLOT_BITS)
    return for_class, for_slot


def softmax(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials, their sums) of the choices of tokens."""
    z = np.take(weights, rows[0], axis=0)
    more = np.empty_like(z)
    for r in rows[1:]:
        z += np.take(weights, r, axis=0, out=more, mode="clip")  # the mode that writes to out directly
    if float(z.max(initial=0.0)) > 60 or float(z.min(initial=0.0)) < -60:  # else float32 holds the exponentials as they are
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ np.ones((z.shape[1], 1), z.dtype)


def _sums(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the stretches of rows that begin at ``at``: most are short, and their rows are added place by place."""
    size = np.diff(np.append(at, len(z)))
    g, live, k = z[at], np.flatnonzero(size > 1), 1
    while len(live) and k < 8:
        g[live] += z[at[live] + k]
        k += 1
        live = live[size[live] > k]
    for i in live.tolist():
        g[i] += z[at[i] + k : at[i] + size[i]].sum(axis=0)
    return g


def _step(weights: np.ndarray, square: np.ndarray, rows: np.ndarray, y: np.ndarray) -> None:
    """One gradient step (AdaGrad by row) on the choices y."""
    z, total = softmax(weights, rows)
    z /= total
    z[np.arange(len(y)), y] -= 1
    for own in rows:
        order = np.argsort(own.astype(np.uint16), kind="stable")
        s = own[order]
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        g = _sums(z[order], at) if len(at) > 1 else z.sum(axis=0, keepdims=True)
        row = s[at]
        square[row] += np.einsum("ij,ij->i", g, g) / g.shape[1]
        weights[row] -= g * (RATE / np.sqrt(square[row] + 1))[:, None]


def steps(weights: np.ndarray, square: np.ndarray, ids: np.ndarray, cls: np.ndarray, ptr: np.ndarray) -> None:
    """Gradient steps over texts, in batches of BATCH tokens."""
    for_class, for_slot = histories(ids, cls, ptr)
    slot = slots(ids)
    for a in range(0, len(ids), BATCH):
        b = a + BATCH
        _step(weights, square, for_class[:, a:b], cls[a:b])
        _step(weights, square, for_slot[:, a:b], slot[a:b])


def factors(weights: np.ndarray, ids: np.ndarray, cls: np.ndarray, slot: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """ln p(class | history) + ln p(slot | class, history) of each token."""
    for_class, for_slot = histories(ids, cls, ptr)
    out = np.zeros(len(ids))
    for a in range(0, len(ids), BATCH):
        b = min(len(ids), a + BATCH)
        z, total = softmax(weights, for_class[:, a:b])
        out[a:b] = np.log(np.maximum(z[np.arange(b - a), cls[a:b]], 1e-30)) - np.log(total[:, 0])
        z, total = softmax(weights, for_slot[:, a:b])
        # the end's class has one member
        out[a:b] += np.where(cls[a:b] == CLASSES - 1, 0.0, np.log(np.maximum(z[np.arange(b - a), slot[a:b]], 1e-30)) - np.log(total[:, 0]))
    return out


def train(spark: SparkSession, docs: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after rounds of local gradient steps and averaging; docs: (text, round_)."""
    weights = np.zeros((_ROWS, CLASSES), np.float32)
    for k in range(rounds):
        common = spark.sparkContext.broadcast(weights)

        def local(batches):
            own, square, n = common.value.copy(), np.zeros(_ROWS, np.float32), 0
            for batch in batches:
                data, offs = buffer(batch.column(0))
                for a, b in blocks(offs, BLOCK_BYTES):
                    ids, cls, ptr = tokens(data, offs[a : b + 1])
                    steps(own, square, ids, cls, ptr)
                    n += len(ids)
            if n:
                # rows that the task's texts do not touch stay 0
                yield packed_batch(np.append((own - common.value).ravel() * np.float32(n), np.float32(n)))

        # a table of fixed size comes back: _ROWS * CLASSES weights
        mean = tree_sum(docs.where(F.col("round_") == k).select("text").mapInArrow(local, PACKED), _ROWS * CLASSES + 1, np.float32, lambda x: x[:-1] / x[-1])
        if mean is not None:
            weights = weights + mean.reshape(_ROWS, CLASSES)
        common.unpersist()
    return weights


def _distinct(table: pa.Table, buckets: int) -> tuple:
    """(distinct ids in order of bucket and id, their classes, training counts, first of each bucket, ids of all tokens as numbers of these, blocks)."""
    data, offs = buffer(table.column("text"))
    ids, cls, ptr = tokens(data, offs)
    held = table.column("held_out").to_numpy()
    train_token = np.repeat(~held, np.diff(ptr))
    vocab, first, k = np.unique(ids, return_index=True, return_inverse=True)
    bucket = (mix(vocab) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    counts = np.bincount(k, train_token, minlength=len(vocab)).astype(np.uint32)
    return vocab[order], cls[first][order].astype(np.uint8), counts[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), back[k], ids, cls, ptr


def _asks(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        vocab, cls, counts, at, *_ = _distinct(table, buckets)
        part = table.column("part")[0].as_py()
        cut = lambda x: pa.array([x[at[i] : at[i + 1]].tobytes() for i in range(buckets)], pa.binary())
        return pa.table({"bucket": pa.array(range(buckets), pa.int32()), "part": pa.array([part] * buckets, pa.int64()), "ids": cut(vocab), "classes": cut(cls), "counts": cut(counts)})

    return run


def _answers(table: pa.Table) -> pa.Table:
    """Counts over all parts of one bucket's words, for each part that asked; in a row of part -1 the tokens and words of each slot."""
    ids = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("ids")]
    size = np.array([len(x) for x in ids])
    vocab, first, k = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")])
    cls = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("classes")])[first]
    total = np.bincount(k, counts, minlength=len(vocab)).astype(np.int64)
    leaf = cls.astype(np.int64) * SLOTS + slots(vocab)
    stats = np.concatenate([np.bincount(leaf, total, minlength=CLASSES * SLOTS), np.bincount(leaf, total > 0, minlength=CLASSES * SLOTS)]).astype(np.int64).tobytes()
    ends = np.cumsum(size)
    out = [total[k[e - n : e]].tobytes() for n, e in zip(size, ends)]
    bucket = table.column("bucket").to_pylist()
    return pa.table({"bucket": pa.array([*bucket, bucket[0]], pa.int32()), "part": pa.array([*table.column("part").to_pylist(), -1], pa.int64()), "totals": pa.array([*out, stats], pa.binary())})


def _scores(weights, stats, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        _, _, _, _, k, ids, cls, ptr = _distinct(table, buckets)
        c = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in answers.column("totals")])[k].astype(np.float64)
        n_leaf, v_leaf = stats.value.reshape(2, -1).astype(np.float64)
        n_all, v_all = n_leaf.sum(), v_leaf.sum()
        base = np.log10((c + 1) / (n_all + v_all + 1))
        slot = slots(ids)
        word = factors(weights.value, ids, cls, slot, ptr) + np.log((c + 1) / (n_leaf + v_leaf + 1)[cls * SLOTS + slot])
        add = lambda x: np.add.reduceat(x, ptr[:-1])  # noqa: E731  each text has a token at least
        return pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(np.diff(ptr)), "n_known": pa.array(add((c > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(ptr) - 1, int(n_all))), "base_score": pa.array(add(base)), "score": pa.array(add(word) / np.log(10))})

    return run


def score(spark: SparkSession, docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per document: its tokens, the base score and the model's log10 probability."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (remainder("doc_id", 7) == 2).alias("held_out"))
    size = d.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(partitions(size.n, part_rows), partitions(size.bytes or 0, PART_BYTES))
    # a bucket's words come from all parts: beyond 4,096 of them 64 parts' worth lie in each
    buckets = min(parts, max(4096, parts // 64))
    weights = spark.sparkContext.broadcast(train(spark, d.where("NOT held_out").withColumn("round_", F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)))))
    dealt = d.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)))
    asks = dealt.groupBy("part").applyInArrow(_asks(buckets), "bucket int, part long, ids binary, classes binary, counts binary")
    answers = cut(spark, asks.groupBy("bucket").applyInArrow(_answers, "bucket int, part long, totals binary"), "word-counts")
    found = tree_sum(answers.where("part < 0").select(F.col("totals").alias("packed"), F.lit(-1).alias("filled")), 2 * CLASSES * SLOTS, np.int64)
    stats = spark.sparkContext.broadcast(found if found is not None else np.zeros(2 * CLASSES * SLOTS, np.int64))
    return dealt.groupBy("part").cogroup(answers.where("part >= 0").groupBy("part")).applyInArrow(_scores(weights, stats, buckets), SCHEMA)

"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its distinct runs of ``SHINGLE`` words; a shingle's weight is
(1 + ln tf) * idf, rounded to a grid, with idf = 1 + IDF_SPREAD * ln(N / df) / ln N: 1 for a
shingle of every document, 1 + IDF_SPREAD for that of one. Document frequencies come from the
whole corpus, in ``2**DF_BITS`` hashed counters (a table of fixed size). The logarithm is
normalised because a large group of copies makes its own shingles common: with 1 + ln(N / df)
the words that its members changed would outweigh all that they share.

Each of ``BANDS * ROWS`` samples keeps the shingle with the least value of Ioffe's improved
consistent weighted sampling (two texts agree in a sample with the probability of their
weighted Jaccard similarity). Texts that agree in all samples of a band share a bucket; at a
similarity of 0.8 all bands miss a pair once in 1,500.

Texts that are equal are one node. A link is a weighted Jaccard similarity of ``SIMILARITY`` or
more, computed from the texts' whole shingle lists; classes are the components of the links. A
bucket never yields its pairs at once: all its nodes are held against one, its pivot - the one
that shares most places in buckets, which in a group of copies is near its centre. Where nodes
of a bucket stay in different components, each node's weight that it shares with nodes of
other components bounds all its similarities to them; nodes whose bound is too low are done.
The rest go through rounds. In each, some nodes of every open bucket (more from round to round)
become pivots, the others are held against them unless exact bounds rule a link out - the
shared weights, and bit maps of the shingles: a bit that only one of two maps has is a shingle
that the other text lacks - and the pivots leave the bucket. Rounds go on until no bucket has
nodes of two components, so no link between the texts of a bucket is lost.

Edge cases: null counts as empty; a text of fewer than SHINGLE words is one shingle; texts
without words are linked only if they are equal; a text of any length is sketched and compared
whole (a batch holds it in memory); of equal similarities none is preferred, as every link of
0.8 or more counts; a null doc_id is carried along and names a class only if the class has no
other; repeated rows are one node; an empty table gives no rows; other columns are ignored by
``classes`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import PACKED, cut, dealt_join, hot_keys, map_batches, packed_batch, spread_join, tree_sum
from scholia.llm.components import LOCAL_EDGES, components
from scholia.llm.textbytes import ALNUM, blocks, buffer, mix, windows, words

SHINGLE = 5
BANDS, ROWS = 24, 6
SIMILARITY = 0.8
DF_BITS = 20
IDF_SPREAD = 1.0
LEVELS, STEP = 24, 0.125
BLOCK_BYTES = 1 << 20
#: Pivots of an open bucket in its first round, and how many times more in each that follows.
PIVOTS, PIVOT_GROWTH = 16, 16
#: Lists of nodes up to so many rows (16 bytes each) are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Buckets of more rows are dealt over several tasks.
HOT_BUCKET = 2000
#: 64-bit words of the bit map of a node's shingles.
MAP_WORDS = 32


def shingle_sets(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first shingle of each text, 44-bit shingle ids in order, how often each stands in its text)."""
    w = words(data, offs, ALNUM)
    n = np.diff(w.ptr)
    doc = np.repeat(np.arange(len(n)), n)
    win = windows(w.h, shingle)
    own = np.arange(len(win)) + shingle <= w.ptr[1:][doc[: len(win)]] if len(win) else np.zeros(0, bool)
    hs, ds = [win[own]], [doc[: len(win)][own]]
    for k in range(1, shingle):
        short = np.flatnonzero(n == k)
        hs.append(windows(w.h, k)[w.ptr[short]] if len(short) else np.zeros(0, np.uint64))
        ds.append(short)
    key = (np.concatenate(ds).astype(np.uint64) << np.uint64(44)) | (np.concatenate(hs) >> np.uint64(20))
    key.sort()
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    tf = np.diff(np.append(at, len(key)))
    key = key[at]
    ptr = np.searchsorted(key, np.arange(len(n) + 1).astype(np.uint64) << np.uint64(44))
    return ptr, key & np.uint64((1 << 44) - 1), tf


def idf_levels(df: np.ndarray, n_docs: int) -> np.ndarray:
    """ln idf of each hashed counter."""
    share = np.log(np.maximum(df, 1)) / np.log(max(n_docs, 2))
    return np.log1p(IDF_SPREAD * (1 - np.clip(share, 0, 1))).astype(np.float32)


def levels(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights as steps of the grid: a weight is exp(STEP * level)."""
    lw = np.log1p(np.log(tf)) + idf[(h & np.uint64((1 << DF_BITS) - 1)).astype(np.int64)]
    return np.minimum(np.rint(lw / STEP), LEVELS - 1).astype(np.int64)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(ordered values of a sample by level and 16 hash bits, odd multipliers of the samples)."""
    rng = np.random.default_rng(20250101)
    r, c, beta = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16), rng.random(1 << 16)
    out = []
    for level in range(LEVELS):
        t = np.floor(STEP * level / r + beta)
        bits = (np.log(c) - r * (t - beta) - r).astype(np.float32).view(np.uint32)
        out.append(np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32))
    return np.concatenate(out), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(ptr: np.ndarray, h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A key for each text (that has shingles) and band."""
    table, odd = _tables()
    has = np.flatnonzero(np.diff(ptr))
    out = np.zeros((len(has), BANDS), np.uint64)
    hh = mix(h)
    low, base, start = hh & np.uint64(0xFFFFFFFF), level << 16, ptr[has]
    for b in range(BANDS):
        key = np.full(len(has), b + 1, np.uint64)
        for k in range(ROWS):
            at = ((hh * odd[b * ROWS + k]) >> np.uint64(48)).astype(np.int64)
            at += base
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(table[at] | low, start))
        out[:, b] = key
    return out


def _nodes(docs: DataFrame) -> DataFrame:
    """node (digest of the text), doc_id, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.unhex(F.md5(text.cast("binary"))).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _frequencies(spark: SparkSession, nodes: DataFrame) -> np.ndarray:
    """ln idf of the hashed counters, from all documents."""

    def count(batches):
        df = np.zeros((1 << DF_BITS) + 1, np.uint64)  # the last one counts documents
        for batch in batches:
            data, offs = buffer(batch.column(0))
            for a, b in blocks(offs, BLOCK_BYTES):
                _, h, _ = shingle_sets(data, offs[a : b + 1])
                at, many = np.unique((h & np.uint64((1 << DF_BITS) - 1)).astype(np.uint32), return_counts=True)
                df[at] += many.astype(np.uint64)
            df[-1] += np.uint64(batch.num_rows)
        if df[-1]:
            yield packed_batch(df)

    idf = tree_sum(nodes.select("text").mapInArrow(count, PACKED), (1 << DF_BITS) + 1, np.uint64, lambda df: idf_levels(df[:-1].astype(np.float64), int(df[-1])))
    return np.zeros(1 << DF_BITS, np.float32) if idf is None else idf


def _sketches(idf):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = buffer(batch.column(2))
        keys: list = []
        for a, b in blocks(offs, BLOCK_BYTES):
            ptr, h, tf = shingle_sets(data, offs[a : b + 1])
            own = [None] * (b - a)
            if len(h):
                found = band_keys(ptr, h, levels(h, tf, idf.value)).view(np.int64)
                for i, row in zip(np.flatnonzero(np.diff(ptr)).tolist(), found):
                    own[i] = row
            keys += own
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], ["node", "doc_id", "bands"])

    return run


def _vectors(idf):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = buffer(batch.column(1))
        out = []
        for a, b in blocks(offs, BLOCK_BYTES):
            ptr, h, tf = shingle_sets(data, offs[a : b + 1])
            packed = ((h << np.uint64(8)) | levels(h, tf, idf.value).astype(np.uint64)) if len(h) else h
            out += [packed[ptr[i] : ptr[i + 1]].tobytes() for i in range(b - a)]
        w = [float(_WEIGHT[(np.frombuffer(x, np.uint64) & np.uint64(255)).astype(np.int64)].sum()) for x in out]
        maps = pa.array([bit_map(np.frombuffer(x, np.uint64)) for x in out], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(w, pa.float64()), maps], ["node", "vec", "w", "bits"])

    return run


_WEIGHT = np.exp(STEP * np.arange(256).clip(max=LEVELS))


def bit_map(packed: np.ndarray) -> np.ndarray:
    """A bit for each hash value of the shingles of a packed list, in MAP_WORDS words."""
    bits = np.zeros(64 * MAP_WORDS, np.uint8)
    bits[(mix(packed >> np.uint64(8)) % np.uint64(64 * MAP_WORDS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two packed shingle lists."""
    ha, hb = a >> np.uint64(8), b >> np.uint64(8)
    wa, wb = _WEIGHT[(a & np.uint64(255)).astype(np.int64)], _WEIGHT[(b & np.uint64(255)).astype(np.int64)]
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    both = hb[at] == ha if len(hb) else np.zeros(len(ha), bool)
    m = float(np.minimum(wa[both], wb[at[both]]).sum())
    return m / (wa.sum() + wb.sum() - m)


def _verify(batch: pa.RecordBatch) -> pa.RecordBatch:
    pairs = [similarity(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3))]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pairs, pa.float64())], ["u", "v", "j"])


def _entries(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The shingles of (node number, component number, packed list)."""
    lists = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(2)]
    size = [len(x) for x in lists]
    v = np.concatenate(lists)
    node, comp = (np.repeat(batch.column(k).to_numpy(), size) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array((v >> np.uint64(8)).astype(np.int64)), pa.array((v & np.uint64(255)).astype(np.int8)), pa.array(node), pa.array(comp)], ["h", "level", "nid", "cid"])


def _shared(left: DataFrame, vectors: DataFrame) -> DataFrame:
    """Weight (sw) of each open node's shingles that stand in a node of another component, and of all its shingles (w)."""
    nodes = left.select("node", "component").distinct().join(vectors, "node").withColumn("nid", F.xxhash64("node")).withColumn("cid", F.xxhash64("component"))
    rows = map_batches(nodes.select("nid", "cid", "vec"), _entries, "h long, level byte, nid long, cid long")
    both = rows.groupBy("h").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b").select("h")
    sums = rows.join(both, "h").groupBy("nid").agg(F.sum(F.exp(F.col("level") * STEP)).alias("sw"))
    return nodes.select("node", "nid", "w", "bits").join(sums, "nid", "left").select("node", "w", "bits", F.coalesce("sw", F.lit(0.0)).alias("sw"))


def _bound(own: str, all_: str, other: str) -> str:
    """SQL: most that a similarity can be, if the common weight is at most own."""
    return f"({own} / ({all_} + greatest({other} - {own}, 0D)) + 1e-9)"


def _lacks(a: str, b: str, own: str, other: str) -> str:
    """SQL: whether a may have so many shingles (each of weight 1 at least) that b lacks, as their maps show, and be similar to it."""
    common = SIMILARITY / (1 + SIMILARITY)
    return f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x & ~y)), 0, (s, x) -> s + x) <= w{own} - {common} * (w{own} + w{other}) + 1e-6"


def _compared(spark: SparkSession, pairs: DataFrame, vectors: DataFrame, broadcast_rows: int) -> DataFrame:
    """The similarity of pairs (u, v), which lie in a table."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    if 2 * pairs.count() <= broadcast_rows:  # only the vectors of a few nodes are moved
        vectors = vectors.join(F.broadcast(ends), "node", "left_semi")
    hot = hot_keys(ends, "node")
    for old, new in (("u", "x"), ("v", "y")):
        own = hot.withColumnRenamed("node", old) if hot is not None else None
        pairs = dealt_join(pairs, vectors.select(F.col("node").alias(old), F.col("vec").alias(new)), old, own)
    return cut(spark, map_batches(pairs.select("u", "v", "x", "y"), _verify, "u binary, v binary, j double"), "pairs")


def _open(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    split = rows.groupBy("band", "key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band", "key")
    return rows.join(split, ["band", "key"], "left_semi")


def _buckets(spark: SparkSession, one: DataFrame) -> DataFrame:
    """(band, key, node, pivot) of all buckets with more than one node. The rows of a large bucket meet their pivot in several tasks."""
    member = one.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = cut(spark, member.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    # at most 100,000 buckets can be so large, which bounds the broadcast
    hot = max(HOT_BUCKET, (sizes.agg(F.sum("size")).first()[0] or 0) // 100_000)
    pieces = F.ceil(F.col("size") / hot).cast("int")
    large = F.broadcast(sizes.where(F.col("size") > hot).select("band", "key", pieces.alias("pieces")))
    dealt = member.join(large, ["band", "key"], "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")
    again = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), pieces - 1)))
    member = cut(spark, dealt.join(again, ["band", "key", "salt"]), "members")
    central = member.join(member.groupBy("node").agg(F.sum("size").alias("places")), "node")
    pivot = central.groupBy("band", "key", "salt").agg(F.max(F.struct("places", "node")).alias("p")).groupBy("band", "key").agg(F.max("p").alias("p"))
    return cut(spark, member.drop("size").join(pivot.join(again.drop("size"), ["band", "key"]), ["band", "key", "salt"]).select("band", "key", "node", F.col("p.node").alias("pivot")), "buckets")


def links(spark: SparkSession, docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, local_edges: int = LOCAL_EDGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their node, components of linked nodes, all compared pairs with their similarity)."""
    nodes = _nodes(docs)
    idf = spark.sparkContext.broadcast(_frequencies(spark, nodes))
    sig = cut(spark, map_batches(nodes, _sketches(idf), "node binary, doc_id long, bands array<bigint>"), "sketches")
    member = _buckets(spark, sig.groupBy("node").agg(F.first("bands").alias("bands")))

    wanted = cut(spark, member.select("node").distinct().join(sig.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "node"), "wanted")
    small = wanted.count() <= broadcast_rows
    w = wanted.select(F.col("node").alias("n_"), F.col("doc_id").alias("d_"))
    texts = nodes.join(F.broadcast(w) if small else w, (F.col("node") == F.col("n_")) & F.col("doc_id").eqNullSafe(F.col("d_")), "left_semi").select("node", "text")
    vectors = map_batches(texts, _vectors(idf), "node binary, vec binary, w double, bits array<bigint>").groupBy("node").agg(F.first(F.struct("vec", "w", "bits")).alias("v")).select("node", "v.*")
    vectors = cut(spark, vectors, "vectors")

    good = F.col("j") >= SIMILARITY
    pair = [F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")]
    first = cut(spark, member.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).select(*pair).distinct(), "candidates")
    seen = _compared(spark, first, vectors, broadcast_rows)
    comp = components(seen.where(good).select("u", "v"), local_edges=local_edges)

    def named(rows: DataFrame) -> DataFrame:
        return _open(rows.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")))

    rows = named(member.select("band", "key", "node"))
    rows = rows.join(cut(spark, _shared(rows, vectors), "shared"), "node")
    # a node that shares too little with other components is done, whatever stands in its bucket
    least = rows.groupBy("band", "key").agg(F.min("w").alias("w0"))
    rows = rows.join(least, ["band", "key"]).where(f"{_bound('sw', 'w', 'w0')} >= {SIMILARITY}").drop("w0")
    rows = cut(spark, _open(rows), "open")
    count = PIVOTS
    while not rows.isEmpty():
        chosen = rows.groupBy("band", "key", F.pmod(F.xxhash64("node", F.lit(count)), F.lit(count)).alias("k")).agg(F.max_by(F.struct("node", "component", "w", "sw", "bits"), F.xxhash64("node")).alias("p"))
        chosen = cut(spark, chosen.select("band", "key", *(F.col(f"p.{c}").alias(f"{c}_") for c in ("node", "component", "w", "sw", "bits"))), "pivots")
        may = f"component <> component_ AND {_bound('least(sw, sw_)', 'w', 'w_')} >= {SIMILARITY} AND {_lacks('bits', 'bits_', '', '_')} AND {_lacks('bits_', 'bits', '_', '')}"
        pairs = rows.join(chosen, ["band", "key"]).where(may).select(F.col("node").alias("a"), F.col("node_").alias("b")).select(*pair).distinct()
        pairs = cut(spark, pairs.join(seen.select("u", "v"), ["u", "v"], "left_anti"), "candidates")
        rows = rows.join(chosen.select("band", "key", F.col("node_").alias("node")), ["band", "key", "node"], "left_anti")
        if not pairs.isEmpty():
            more = _compared(spark, pairs, vectors, broadcast_rows)
            seen = seen.unionByName(more)
            if not more.where(good).isEmpty():
                comp = components(seen.where(good).select("u", "v"), local_edges=local_edges)
                rows = named(rows.drop("component"))
        rows = cut(spark, _open(rows), "open")
        count *= PIVOT_GROWTH
    return sig.select("node", "doc_id"), comp, seen.where(good)


def classes(spark: SparkSession, docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), kept (whether it is that one), n_links (verified links of its text to other texts; those that its class does not need are not all verified)."""
    own, comp, seen = links(spark, docs, broadcast_rows, local_edges)
    ends = seen.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = _named(own, comp).join(ends, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    rows = spread_join(own, cut(spark, named, "classes"), "node")
    return rows.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "n_links")


def _named(own: DataFrame, comp: DataFrame) -> DataFrame:
    """node, class_id, keeper (the one node of the class that stays) of each node."""
    first = own.groupBy("node").agg(F.min("doc_id").alias("first"))
    named = first.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = named.groupBy("component").agg(F.min("first").alias("class_id"), F.min_by("node", F.struct(F.col("first").isNull(), "first", "node")).alias("keeper"))
    return named.join(best, "component").select("node", "class_id", "keeper")


def keep_one(spark: SparkSession, docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents without all but one of each class, with all their columns."""
    own, comp, _ = links(spark, docs, broadcast_rows)
    named = cut(spark, spread_join(own, cut(spark, _named(own, comp), "classes"), "node"), "members")
    stays = (F.col("node") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    gone = named.where(~stays).select(F.col("node").alias("n_"), F.col("doc_id").alias("d_")).distinct()
    again = named.where(stays).groupBy("node", "doc_id").agg(F.count("*").alias("k_")).where("k_ > 1").select(F.col("node").alias("n_"), F.col("doc_id").alias("d_"))
    drop = cut(spark, gone.withColumn("again_", F.lit(False)).unionByName(again.withColumn("again_", F.lit(True))), "gone")
    hint = F.broadcast if drop.count() <= broadcast_rows else (lambda x: x)
    # whole rows travel in one column, so that no name of theirs can meet one of these
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("node"), F.col("doc_id").cast("long").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    key = (F.col("node") == F.col("n_")) & F.col("id").eqNullSafe(F.col("d_"))
    kept = rows.join(hint(drop), key, "left_anti").select("row")
    if not drop.where("again_").isEmpty():
        repeated = rows.join(hint(drop.where("again_")), key).groupBy("n_", "d_").agg(F.first("row").alias("row"))
        kept = kept.unionByName(repeated.select("row"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))

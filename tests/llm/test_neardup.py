import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from scholia.llm import neardup as N
from scholia.llm.common import PACKED, packed_batch, spread_join, tree_sum
from scholia.llm.components import components
from scholia.llm.textbytes import buffer


def brute(rows):
    """Class of each row by all pairs."""
    texts = sorted({t or "" for _, t in rows})
    data, offs = buffer(pa.array(texts))
    ptr, h, tf = N.shingle_sets(data, offs)
    df = np.zeros(1 << N.DF_BITS)
    where = {t: i for i, t in enumerate(texts)}
    for _, t in rows:
        i = where[t or ""]
        np.add.at(df, (h[ptr[i] : ptr[i + 1]] & np.uint64((1 << N.DF_BITS) - 1)).astype(np.int64), 1)
    v = (h << np.uint64(8)) | N.levels(h, tf, N.idf_levels(df, len(rows))).astype(np.uint64)
    vec = [v[ptr[i] : ptr[i + 1]] for i in range(len(texts))]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(vec[i]) and len(vec[j]) and N.similarity(vec[i], vec[j]) >= N.SIMILARITY:
                up[root(i)] = root(j)
    least = {}
    for d, t in rows:
        r = root(where[t or ""])
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, least[root(where[t or ""])]) for d, t in rows), key=str)


def corpus():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    rows, k = [], 0
    for _ in range(12):
        base = text(r.randint(20, 200))
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((k, " ".join(w)))
            k += 1
    group = text(140)  # one large group, many of whose members are close to the line
    for _ in range(60):
        w = list(group)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((k, " ".join(w)))
        k += 1
    passage = " ".join(text(60))
    rows += [(k + i, passage + " " + " ".join(text(60))) for i in range(25)]
    return rows + [(900, None), (901, ""), (902, "only three words"), (903, "only three words"), (904, "Only, three WORDS"), (None, rows[0][1]), (905, "!!"), (905, "!!"), (906, "z " * 3000)]


def test_classes_equal_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    want = brute(rows)
    for bound, local in ((N.BROADCAST_ROWS, 200_000), (0, 0)):  # the second as it runs on large tables
        got = N.classes(spark, d, bound, local).collect()
        assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == want
        text = {i: t or "" for i, t in rows}
        of = {c: {text[r.doc_id] for r in got if r.class_id == c and r.doc_id is not None} for c in {r.class_id for r in got}}
        assert all((r.n_links > 0) == (len(of[r.class_id]) > 1) for r in got)
    kept = N.keep_one(spark, d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want})


def test_sampling_follows_similarity():
    r = random.Random(2)
    a = [f"a{r.randrange(10**6)}" for _ in range(400)]
    pairs = []
    for edits in (0, 5, 20, 60):
        b = list(a)
        for i in r.sample(range(400), edits):
            b[i] = "x" + str(r.random())
        pairs += [" ".join(a), " ".join(b)]
    ptr, h, tf = N.shingle_sets(*buffer(pa.array(pairs)))
    k = N.band_keys(ptr, h, N.levels(h, tf, np.zeros(1 << N.DF_BITS, np.float32)))
    same = [(k[i] == k[i + 1]).mean() for i in range(0, 8, 2)]
    assert same[0] == 1 and same[0] > same[1] > same[2] >= same[3]


def test_components(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("900", "901"), ("901", "902"), ("902", "900"), ("950", "950")]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u string, v string")).collect())
    assert {got[f"{i:03d}"] for i in range(41)} == {"000"} and {got[x] for x in ("900", "901", "902")} == {"900"} and "950" not in got


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert N.classes(spark, d).count() == 0 and N.keep_one(spark, d).count() == 0


def around(seed, pairs=12):
    """A text, and pairs of texts too far from it to be linked, each pair at the line of plain Jaccard."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**6)}"

    def edited(t, places):
        w = list(t)
        for i in places:
            w[i] = word()
        return w

    centre = [word() for _ in range(94)]
    rows = [centre]
    for _ in range(pairs):
        p = r.sample(range(6, 88, 6), 5)
        one = edited(centre, p[:3])
        rows += [one, edited(one, p[3:])]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_pairs_that_share_one_band_are_compared(spark):
    rows = around(350)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.class_id) for r in N.classes(spark, d).collect()), key=str) == brute(rows)


def test_bit_maps_rule_out_no_link(spark):
    r = random.Random(6)
    base = [r.randrange(1 << 44) for _ in range(300)]
    found = set()
    for k in range(0, 80, 2):
        a, b = (np.unique(np.array(base[: 300 - k] + [r.randrange(1 << 44) for _ in range(m)], np.uint64)) for m in (k // 3, k // 4))
        a, b = ((x << np.uint64(8)) | np.array([r.randrange(3) for _ in x], np.uint64) for x in (a, b))
        w = [float(N._WEIGHT[(x & np.uint64(255)).astype(np.int64)].sum()) for x in (a, b)]
        row = [N.bit_map(a).tolist(), N.bit_map(b).tolist(), *w]
        t = spark.createDataFrame([row], "bits array<long>, bits_ array<long>, w double, w_ double")
        may = t.selectExpr(f"{N._lacks('bits', 'bits_', '', '_')} AND {N._lacks('bits_', 'bits', '_', '')} AS x").first().x
        assert may or N.similarity(a, b) < N.SIMILARITY
        found.add((may, N.similarity(a, b) >= N.SIMILARITY))
    assert (True, True) in found


def weights(texts):
    """Weight of each shingle of each text, straight from the definition: no hashes, no grid."""
    split = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for t in texts]
    grams = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for w in split]
    df = Counter(g for own in grams for g in own)
    n = max(len(texts), 2)
    return [{g: (1 + math.log(c)) * (1 + math.log(n / df[g]) / math.log(n)) for g, c in own.items()} for own in grams]


def weighted_jaccard(a, b):
    common = sum(min(a[g], b[g]) for g in a.keys() & b.keys())
    return common / (sum(a.values()) + sum(b.values()) - common) if a and b else 0.0


def test_classes_follow_the_definition(spark):
    """Every pair clearly above the line is in one class, and every class hangs together by pairs that are hardly below it."""
    rows = [(i, t) for i, t in corpus() if i is not None and i < 900]
    w = weights([t for _, t in rows])
    got = {r.doc_id: r.class_id for r in N.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = {i: {i} for i, _ in rows}
    above = 0
    for x, (i, _) in enumerate(rows):
        for y in range(x):
            j = weighted_jaccard(w[x], w[y])
            if j >= 0.82:
                above += 1
                assert got[i] == got[rows[y][0]]
            if j >= 0.78:
                near[i].add(rows[y][0])
                near[rows[y][0]].add(i)
    assert above > 100
    for c in set(got.values()):
        reached, todo = {c}, [c]
        while todo:
            for k in near[todo.pop()] - reached:
                reached.add(k)
                todo.append(k)
        assert {i for i, x in got.items() if x == c} <= reached


def test_recall_of_stated_queries(spark):
    """Of the pairs at the line or above it between ids divisible by 50 and all rows, nine in ten at least share a class."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    w = weights([r.text for r in rows])
    got = {r.doc_id: r.class_id for r in N.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [(r.doc_id, q.doc_id) for r, a in zip(rows, w) for q, b in zip(rows, w) if q.doc_id % 50 == 0 and r.doc_id != q.doc_id and weighted_jaccard(a, b) >= N.SIMILARITY]
    assert pairs and sum(got[x] == got[y] for x, y in pairs) >= 0.9 * len(pairs)


def test_clashing_names(spark):
    rows = [(1, "some text of more than five words", i, i, i, i) for i in range(2)] + [(2, "some text of more than five words", 5, 5, 5, 5), (3, "x", 6, 6, 6, 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_ int, d_ int, node int, row int")
    kept = N.keep_one(spark, d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_keys_of_many_rows_are_dealt(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("a", 1), ("none", 2)], "k string, v int")
    right = spark.createDataFrame([("hot", 7), ("a", 8)], "k string, x int")
    assert sorted(map(tuple, spread_join(left, right, "k", hot_rows=9).collect())) == sorted([("hot", i, 7) for i in range(50)] + [("a", 1, 8)])
    assert spread_join(left, right, "k", "left", 9).count() == 52


def test_large_buckets_keep_their_pivot(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT_BUCKET", 3)
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.class_id) for r in N.classes(spark, d).collect()), key=str) == brute(rows)


def test_very_long_text(spark):
    r = random.Random(3)
    long = " ".join(f"w{r.randrange(10**5)}" for _ in range(300_000))
    d = spark.createDataFrame([(1, long), (2, long + " end"), (3, "w1 w2 w3")], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in N.classes(spark, d).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_tree_sum_of_full_and_empty_arrays(spark):
    def make(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                x = np.zeros(1000, np.int64)
                x[: 1000 if i % 3 == 0 else i] = i
                yield packed_batch(x)

    want = sum(np.where(np.arange(1000) < (1000 if i % 3 == 0 else i), i, 0) for i in range(40))
    for parts in (1, 2, 9):
        assert (tree_sum(spark.range(40, numPartitions=parts).mapInArrow(make, PACKED), 1000, np.int64, fan=2) == want).all()
    assert tree_sum(spark.range(0).mapInArrow(make, PACKED), 1000, np.int64) is None

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.operators import batch, index, search
from scholia.plans import catalog


def texts(n, words, length, seed):
    draw = random.Random(seed)
    return [" ".join(draw.choices([f"w{i}" for i in range(words)], k=draw.randint(1, length))) for _ in range(n)]


def shuffled_rows(spark):
    """Rows that stages have written for other stages so far."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_batch_does_not_shuffle_pairs(spark, tmp_path):
    path = f"file://{tmp_path}"
    docs = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts(150, 30, 60, 1))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(texts(60, 30, 30, 2))), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    before = shuffled_rows(spark)
    assert catalog.QUERIES["bm25_batch_topk"](spark, path).count() == 300
    assert shuffled_rows(spark) - before < 10_000  # 104,526 when pairs of a query's word and a document were joined


@pytest.mark.parametrize("stemmed", [False, True])
def test_batch_finds_what_the_plan_finds(spark, monkeypatch, stemmed):
    body = texts(120, 25, 40, 3)
    rows = [(f"d{i:03d}", "en" if i % 3 else "de", 2000 + i % 9, f"w{i % 7} w{i % 5}" if i % 11 else None, body[i % 90] if i % 13 else None) for i in range(120)]
    docs = spark.createDataFrame([*rows, (None, "en", 2001, "w1", "w1 w2")], "id string, article_key string, year int, title string, body string").withColumn("citations", F.lit(0))
    ix = index.build(docs, stemmed, {"title": F.col("title"), "body": F.col("body"), "venue": F.lit("w1")})
    asked = [(f"q{i}", t) for i, t in enumerate(texts(30, 30, 12, 4))] + [("blank", " "), ("none", "zzz"), ("twice", "w3 w3 w4"), (None, "w5")]
    queries = spark.createDataFrame(asked, "query_id string, query_text string").repartition(3)
    allowed = spark.createDataFrame([("de",)], "k string")

    def found(few, filters=None, keys=None, boosts=None):
        monkeypatch.setattr(batch, "FEW_TERMS", few)
        got = search.search(ix, queries, 4, filters, keys, digits=9, boosts=boosts).where("rank <= 4").collect()
        return {(r.query_id, r["rank"]): (r.id, r.score) for r in got}

    for kwargs in ({},) if stemmed else ({"filters": search.Filters(2002, 2006)}, {"keys": allowed}, {"boosts": {"title": 2.0}}):
        plan, own = found(10**9, **kwargs), found(8, **kwargs)
        assert own.keys() == plan.keys() and len(own) > 100 and (None, 1) in own
        assert all(own[k][0] == plan[k][0] and abs(own[k][1] - plan[k][1]) < 1e-8 for k in plan)


def test_blocks_and_chunks_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(200, 25, 40, 5) + ["w1 w2"] * 40)], "id long, body string")
    ix = index.build(docs, False, {"body": F.col("body")})
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts(30, 25, 12, 6))], "query_id string, query_text string")
    asked = search.query_terms(ix, queries).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    t, rows = batch._terms(ix, asked, {"body": 1.0}), docs.select("id", ix.analysed["body"].alias("body")).toArrow().to_batches()
    every = []
    for most in (1 << 20, 200, 1):
        monkeypatch.setattr(batch, "CELLS", most)
        monkeypatch.setattr(batch, "TOKENS", most)
        out = batch.Best(30, 2, 9)
        blocks = [x for b in rows for x in batch._blocks(b, t)]
        for x in blocks:
            batch._score(x, t, out)
        every.append((len(blocks), [x.tolist() for x in out.thin()]))
    assert every[0][1] == every[1][1] == every[2][1] and every[0][0] < every[1][0] < every[2][0]


def test_rounding_is_half_up():
    x = np.array([0.125, 2.5e-9, 34.2553105, 1.0000000005, 0.3, 123456.7890125, 0.0])
    assert batch.rounded(x, 9).tolist() == [0.125, 3e-9, 34.2553105, 1.000000001, 0.3, 123456.7890125, 0.0]
    assert batch.rounded(np.array([0.125, 1.005, 2.675]), 2).tolist() == [0.13, 1.01, 2.68]


@pytest.mark.parametrize("few", [0, 10**9])
def test_digits_order_and_leave_scores(spark, monkeypatch, few):
    monkeypatch.setattr(batch, "FEW_TERMS", few)
    docs = spark.createDataFrame([(1, "w1 x x x x x"), (2, "w1 x x x x"), (3, "w1"), (4, "y")], "id long, body string").select("*", F.lit("k").alias("article_key"), F.lit("t").alias("title"), F.lit(2000).alias("year"), F.lit(0).alias("citations"))
    ix = index.build(docs, False, {"body": F.col("body")})
    q = spark.createDataFrame([("q", "w1")], "query_id string, query_text string")
    whole, own = ({r.id: (r["rank"], r.score) for r in search.search(ix, q, 3, digits=d).collect()} for d in (None, 0))
    assert [whole[i][0] for i in (3, 2, 1)] == [own[i][0] for i in (1, 2, 3)] == [1, 2, 3]
    assert {i: s for i, (_, s) in own.items()} == {i: s for i, (_, s) in whole.items()}

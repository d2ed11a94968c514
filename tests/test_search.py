import math

import pytest
from pyspark.sql import functions as F

from scholia import schemas
from scholia.operators import evaluation, index, relational, rerank, retrieval, search, vectors
from scholia.sources import readers, sinks


def rows(spark, items):
    names = [c.strip().split()[0] for c in schemas.INDEXABLE.replace("\n", " ").split(",")]
    return spark.createDataFrame([tuple(i.get(n) for n in names) for i in items], schemas.INDEXABLE)


@pytest.fixture(scope="module")
def corpus(spark):
    items = [{"id": f"W{i}", "article_key": f"W{i}", "title": "neuron", "body": "neuron", "authors": "Doe, Ann; Roe, Bob", "journal": "The Lancet", "year": 2025, "citations": 1000 + i, "work_type": "article"} for i in range(1, 41)]
    items += [{"id": "A1", "article_key": "A1", "title": "neuron", "body": "neuron", "authors": "Ann Doe", "journal": "Cell", "year": 2019, "citations": 10}, {"id": "A2", "article_key": "A2", "title": "neuron low", "body": None, "year": None, "citations": 20, "work_type": "dataset"}]
    ix = index.build(rows(spark, items))
    ix.docs, ix.tokens = ix.docs.cache(), ix.tokens.cache()
    return ix


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_allowlist_comes_before_the_top_and_leaves_scores(spark, corpus):
    q = spark.createDataFrame([("q", "neurons")], "query_id string, query_text string")
    allowed = spark.createDataFrame([("A1",), ("A2",)], "k string")
    every = {r.id: r.score for r in search.search(corpus, q, 100).collect()}
    for sort in (search.RELEVANCE, search.CITATIONS, search.YEAR):
        assert not {"A1", "A2"} & set(ids(search.search(corpus, q, 20, sort=sort, prior=2.0)))
    own = search.search(corpus, q, 20, allowed=allowed).collect()
    assert {r.id for r in own} == {"A1", "A2"} and all(r.score == every[r.id] for r in own)
    with pytest.raises(ValueError):
        retrieval.Corpus(spark, "x", corpus, allowed=allowed.limit(0))


def test_filters(spark, corpus):
    f = lambda **k: {r.id for r in search.matching(corpus, search.Filters(**k)).collect()}
    assert f(year_max=2020) == {"A1"} and f(exclude_types=("DATASET",)) == {r.id for r in corpus.docs.collect()} - {"A2"}
    assert f(author="Ann Doe") == f(author="Doe, Ann") == {f"W{i}" for i in range(1, 41)} | {"A1"}
    assert f(author="Roe AND Doe", journal="Lancet") == {f"W{i}" for i in range(1, 41)} and f(journal="Cell; Nature") == {"A1"}
    for bad in ("a AND b OR c", " ; ", ";".join("abcdefghijk")):
        with pytest.raises(ValueError):
            search.parse_names(bad)
    with pytest.raises(ValueError):
        search.parse_names("a AND b", allow_all=False)


def test_tools(spark, corpus):
    c = retrieval.Corpus(spark, "x", corpus, corpus)
    out = c.search_works("neuron", limit=5).orderBy("rank").collect()
    assert out[0].stage == "bm25+rerank" and len(out) == 1 and out[0].title == "neuron"  # one row per title; A2 is a dataset
    assert c.search_works(author="Ann Doe", sort="citations").first().stage == "sorted:citations"
    assert c.paper("A1").first().year == 2019 and c.paper("none").count() == 0
    assert c.stats().first().works == 42
    with pytest.raises(ValueError):
        c.search_works(" ")


def test_context_and_explain(spark):
    p = rows(spark, [{"id": f"K#{i:04d}", "article_key": "K", "title": "t", "body": f"body {i}"} for i in range(2)])
    c = retrieval.Corpus(spark, "x", index.build(p, stemmed=False), index.build(p, stemmed=False))
    assert [r.id for r in c.context("K#0001", 1, 1).collect()] == ["K#0000", "K#0001"]
    assert c.search_passages("body", per_article=1).count() == 1
    with pytest.raises(ValueError):
        c.context("nothing")


def test_index_round_trip(spark, corpus, tmp_path):
    corpus.save(str(tmp_path / "ix"), buckets=3)
    back = index.Index.load(spark, str(tmp_path / "ix"))
    assert back.postings.count() == corpus.postings.count() and back.terms.count() == corpus.terms.count()


def test_dedup_keeps_the_place(spark):
    r = spark.createDataFrame([("q", "a", "a", "T.", 3.0, 1, 5), ("q", "b", "b", "U", 2.0, 2, 0), ("q", "c", "c", "t", 1.0, 3, 9), ("q", "d", "d", "", 0.5, 4, 0)], "query_id string, id string, article_key string, title string, score double, rank int, citations long")
    assert [(x.id, x.rank, x.score) for x in search.dedup_titles(r).orderBy("rank").collect()] == [("c", 1, 1.0), ("b", 2, 2.0), ("d", 3, 0.5)]


def test_metrics(spark):
    runs = spark.createDataFrame([("s", "q", "a", 1), ("s", "q", "b", 2), ("s", "z", "a", 1)], "system string, query_id string, hit string, rank int")
    grades = spark.createDataFrame([("q", "b", 3), ("q", "c", 1)], "query_id string, hit string, grade int")
    m = evaluation.by_system(evaluation.judged(runs, grades, 10)).first()
    assert m.queries == 1 and m.rr == 0.5 and abs(m.ndcg - (7 / math.log2(3)) / (7 + 1 / math.log2(3))) < 1e-9


def test_small_operators(spark):
    a, b = spark.range(3), spark.range(1, 3)
    assert [r.id for r in relational.outstanding(a, b, "id").collect()] == [0] and relational.same_keys(b, b, "id") and not relational.same_keys(a, b, "id")
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(vectors.normalise(F.col("v")).alias("v")).collect()
    assert [list(r.v) for r in v] == [[0.6, 0.8], [0.0, 0.0]]
    assert rerank.pair_layout([5, 6], [7, 8, 9], 1, 2, 7) == ([1, 5, 6, 2, 7, 8, 2], [0, 0, 0, 0, 1, 1, 1])
    assert rerank.pair_layout_bos([5, 6], [7], 0, 2) == [0, 5, 6, 2, 2, 7, 2]
    assert rerank.lexical_scorer("neurons fire", ["a neuron", "x"]) == [0.5, 0.0]


def test_stamps_and_generations(spark, tmp_path):
    src = tmp_path / "src"
    spark.range(3).write.parquet(str(src))
    s = sinks.stamp(spark, f"file://{src}/*.parquet", "works")
    path, pointer = f"file://{tmp_path}/stamp.json", f"file://{tmp_path}/current.json"
    assert not sinks.is_current(spark, path, s)
    sinks.write_text(spark, path, __import__("json").dumps(s))
    assert sinks.is_current(spark, path, s) and not sinks.is_current(spark, path, s | {"layout": 0})
    assert sinks.publish(spark, pointer, f"file://{src}") and not sinks.publish(spark, pointer, f"file://{src}") and sinks.current(spark, pointer) == f"file://{src}"
    with pytest.raises(FileNotFoundError):
        sinks.publish(spark, pointer, f"file://{tmp_path}/none")
    assert sinks.write_verified(spark.range(5), f"file://{tmp_path}/v").count() == 5


def test_sets_and_configs(spark, tmp_path):
    ids_file = tmp_path / "ids.txt"
    ids_file.write_text("W1\n\n https://openalex.org/w1\nW22\n")
    assert {r[0] for r in readers.allowlist(spark, str(ids_file)).collect()} == {"https://openalex.org/W1", "https://openalex.org/W22"}
    ids_file.write_text("W1\nbad\n")
    with pytest.raises(ValueError):
        readers.allowlist(spark, str(ids_file))
    q = tmp_path / "q.jsonl"
    q.write_text('{"query_id":"a","query_text":"x"}\n{"query_id":"a","query_text":"y"}\n')
    with pytest.raises(ValueError):
        readers.questions(spark, str(q))
    assert readers.collections('[{"name":"one-2","path":"a/b"}]')[0].name == "one-2"
    for bad in ('[{"name":"one","path":"a","x":1}]', '[{"name":"One","path":"a"}]', '[{"name":"one","path":"../a"}]', '[{"name":"one","path":"a"},{"name":"one","path":"b"}]'):
        with pytest.raises(ValueError):
            readers.collections(bad)

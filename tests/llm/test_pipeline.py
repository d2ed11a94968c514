import random

import corpus_pipeline
from tokenizers import Tokenizer

from scholia.llm.common import cut, table
from scholia.llm.tokens import tokenizer_path


def fixture(spark, path):
    r = random.Random(6)
    vocab = [f"wort{i}" for i in range(900)]
    prose = lambda n: " ".join(r.choice(["the", "and", "of", r.choice(vocab), r.choice(vocab)]) for _ in range(n))
    item = " ".join(f"bench{i}" for i in range(15))
    clean = {i: prose(120) for i in range(20)}
    near = clean[3].split()
    near[50] = "changed"
    docs = [(i, t) for i, t in clean.items()] + [(30, clean[3]), (31, " ".join(near)), (30, clean[3]), (32, "*** " * 50), (33, "short"), (34, None)]
    docs += [(40, clean_text := prose(100) + " " + item + " " + prose(20)), (41, item), (42, prose(90) + " write to a.b@mail.example.com now")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return clean, item, clean_text


def test_stages_against_a_brute_force_version(spark, tmp_path):
    d = f"file://{tmp_path}/t"
    clean, item, dirty = fixture(spark, d)
    kept = {**clean, 40: dirty, 41: item, 42: None}
    docs = table(spark, d, "documents")
    want = [set(kept), set(kept), set(kept) - {41}, set(kept) - {41}]
    for (_, stage), ids in zip(corpus_pipeline.STAGES[:-1], want):
        columns = docs.columns
        docs = cut(spark, stage(spark, docs, d), "test")
        found = [r.doc_id for r in docs.collect()]
        if stage is corpus_pipeline.quality_rules:
            assert sorted(found) == sorted([*ids, 30, 30, 31]) and docs.columns == columns
        else:
            assert sorted(found) == sorted(ids) and docs.columns == columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[i] == t for i, t in clean.items()) and "bench7" not in texts[40] and "<EMAIL>" in texts[42]
    tok = Tokenizer.from_file(tokenizer_path())
    pieces = corpus_pipeline.run(spark, d).toPandas()
    assert {i: int(n) for i, n in pieces.groupby("doc_id").length.sum().items()} == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}

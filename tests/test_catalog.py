import math
import re

from scholia.operators import parsing
from scholia.plans import catalog

TEXTS = [(5, "the title\nthe and with the"), (99, "other\nand and tion"), (100, "the\nwith tion thanea"), (700, "none\nnothing here")]


def documents(spark, path, rows):
    rows = [(i, t, "en", "src1" if i % 2 else "src2", len(t or "")) for i, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return rows


def test_explain_terms_covers_all_documents(spark, tmp_path):
    rows = documents(spark, f"file://{tmp_path}", TEXTS)
    words = lambda x: re.findall("[a-z0-9]+", x.lower())
    want = {}
    for field, boost, of in (("title", 3.0, lambda r: r[1].split("\n")[0]), ("body", 1.0, lambda r: r[1].split("\n")[1]), ("authors", 2.0, lambda r: r[2]), ("venue", 1.5, lambda r: r[3])):
        toks = {r[0]: words(of(r)) for r in rows}
        mean = sum(map(len, toks.values())) / len(rows)
        for place, term in enumerate(words(catalog.QUERY + " en src1")):
            df = sum(term in t for t in toks.values())
            for i, t in toks.items():
                if tf := t.count(term):
                    want[field, term, i, place, tf] = boost * math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
    got = {(r.field, r.term, r.doc_id, r.place, r.tf): r.score for r in catalog.QUERIES["explain_terms"](spark, f"file://{tmp_path}").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want) and {k[2] for k in got} == {5, 99, 100, 700}


def test_text_queries_cover_whole_tables_and_texts(spark, tmp_path):
    path = f"file://{tmp_path}"
    texts = ["plain text", "shown in ( ) and [ , – ], end ,;", "a  b   c", "x" * 450, "y" * 402 + " z", "Ab ab " * 90 + "last Last", " lead", "", "word " * 85 + "health,. next"]
    rows = documents(spark, path, list(enumerate(texts)))
    spark.createDataFrame([(1, "," * 3100 + " word"), (2, ",; " * 1200), (3, None)], "page_id long, html string").write.parquet(f"{path}/pages.parquet")
    got = lambda name: {r[0]: r[1] for r in catalog.QUERIES[name](spark, path).collect()}

    def excerpt(t):
        at = t[:401].rfind(" ")
        return t if len(t) <= 400 else (t[:at] if at > 0 else t[:400]) + " ..."

    def names(t):
        first = {}
        for x in filter(None, (x.strip(" ") for x in t.split(" "))):
            first.setdefault(x.lower(), x)
        return "; ".join(first.values()) or None

    assert got("clean_text") == {r[0]: parsing.clean(r[1]) for r in rows}
    assert got("excerpt_last_space") == {r[0]: excerpt(r[1]) for r in rows}
    assert got("join_distinct") == {r[0]: names(r[1]) for r in rows}
    assert got("inverted_index_rebuild") == {r[0]: r[1] for r in rows}
    assert got("clean_markup") == {1: parsing.clean("," * 3100 + " word"), 2: "", 3: ""}

import json

import pytest
from pyspark.sql import functions as F

from scholia.operators import chunking, markup, parsing
from scholia.sources import readers, sinks

JATS = """<?xml version="1.0"?><article article-type="research-article" xmlns:xlink="http://www.w3.org/1999/xlink"><front><journal-meta><journal-title-group><abbrev-journal-title abbrev-type="pubmed">J Test</abbrev-journal-title></journal-title-group>
<issn pub-type="epub">1-2</issn><issn>3-4</issn><publisher><publisher-name>Pub</publisher-name></publisher></journal-meta>
<article-meta><article-id pub-id-type="pmc">123</article-id><article-id pub-id-type="doi">10.1/ABC</article-id><title-group><article-title>A <italic>title</italic><xref>1</xref></article-title></title-group>
<contrib-group><contrib contrib-type="author"><name><surname>Doe</surname><given-names>Ann</given-names></name></contrib><contrib contrib-type="editor"><name><surname>No</surname></name></contrib><contrib><collab>Group</collab></contrib></contrib-group>
<pub-date pub-type="ppub"><year>2001</year></pub-date><pub-date pub-type="epub"><year>2000</year><month>5</month></pub-date>
<permissions><license xlink:href="http://cc"><license-p>Free.</license-p></license></permissions>
<abstract abstract-type="graphical"><p>No</p></abstract><abstract><sec><p>First.</p><p>Second (<xref>2</xref>).</p></sec></abstract><kwd-group><kwd>k1</kwd><kwd> </kwd><kwd>k2</kwd></kwd-group></article-meta></front>
<body><p>Lead in.</p><sec><title>2. Methods</title><p>We did x<sup><xref>1</xref>-</sup> and 10<sup>-7</sup>.</p><sec><title>Results of it</title><p>Inner.</p></sec></sec><sec><title>Funding</title><p>Money.</p><sec><title>Results</title><p>Hidden.</p></sec></sec>
<fig><label>F1</label><caption><p>A caption that is long enough.</p></caption></fig></body><back><ref-list><ref/><ref/></ref-list></back></article>"""


def test_jats():
    a = parsing.parse_jats(JATS.encode(), "/x/file.xml", "c")
    assert (a["article_key"], a["doi"], a["title"], a["journal"], a["issn_electronic"], a["issn_print"]) == ("PMC123", "10.1/abc", "A title", "J Test", "1-2", "3-4")
    assert (a["authors"], a["keywords"], a["pub_year"], a["pub_month"], a["license_url"], a["license_text"], a["reference_count"]) == ("Doe, Ann; Group", "k1; k2", 2000, 5, "http://cc", "Free.", 2)
    assert a["abstract"] == "First. Second."
    assert [(b["kind"], b["section_path"], b["text"]) for b in a["blocks"]] == [
        ("Abstract", "Abstract", "First. Second."), ("Introduction", None, "Lead in."), ("Methods", "2. Methods", "We did x and 10-7."), ("Methods", "2. Methods > Results of it", "Inner."), ("FigureCaption", "F1", "A caption that is long enough."),
    ]
    assert parsing.parse_jats(b"<other/>", "x", "c") is None


def test_jats_frame(spark, tmp_path):
    (tmp_path / "a.xml").write_text(JATS)
    (tmp_path / "b.xml").write_text("<article><broken>")
    (tmp_path / "c.xml").write_text("<other/>")
    rows = parsing.jats_articles(readers.xml_files(spark, {"c": str(tmp_path)}))
    got = {r.article_key: r for r in rows.collect()}
    assert set(got) == {"PMC123", None} and got[None].error
    blocks = parsing.blocks(rows.where("article_key IS NOT NULL"))
    chunks = chunking.chunk(blocks).orderBy("chunk_index").collect()
    assert [c.chunk_id for c in chunks] == [f"PMC123#{i:04d}" for i in range(5)] and chunks[0].section_kind == "Abstract"
    sinks.corpus_tables(rows.where("error IS NULL"), chunking.chunk(blocks), str(tmp_path / "out"))
    tier = spark.read.parquet(str(tmp_path / "out/abstracts")).first()
    assert tier.publication_date == "2000-05-01" and tier.best_oa_landing_page_url == "https://doi.org/10.1/abc" and tier.cited_by_count is None
    index_rows = readers.abstract_articles(spark.read.parquet(str(tmp_path / "out/abstracts")), readers.jats_metadata(rows)).collect()
    assert index_rows[0].authors == "Doe, Ann; Group" and index_rows[0].citations == 0
    report = sinks.ingest_report(spark, rows, chunking.chunk(blocks), str(tmp_path / "report.json"), {})
    assert report["failed"] == 1 and report["chunks"] == 5


PAPER = {"metadata": {"title": "T", "authors": ["A B", {"text": "C"}], "publish date": "2020-02-30"}, "abstract": [{"text": "One."}, ["Two."]], "body": {"sections": [{"header title": "Methods", "text": ["m"], "tables": [{"caption": "cap"}], "subsections": [{"header title": "Results", "text": "r"}, {"header title": "Other thing", "text": "o"}]}, {"header title": "References", "text": "no", "subsections": [{"header title": "Results", "text": "no"}]}]}}


def test_pds(spark, tmp_path):
    a = parsing.parse_pds(json.dumps(PAPER), "k", "p", "col")
    assert (a["article_key"], a["authors"], a["abstract"], a["pub_year"]) == ("col:k", "A B; C", "One. Two.", None)
    assert [(b["kind"], b["section_path"], b["text"]) for b in a["blocks"]] == [("Abstract", "Abstract", "One. Two."), ("Methods", "Methods", "m"), ("TableCaption", "Methods", "cap"), ("Results", "Methods / Results", "r"), ("Methods", "Methods / Other thing", "o")]
    with pytest.raises(ValueError):
        parsing.parse_pds(json.dumps({"metadata": {"title": None}}), "k", "p", "col")
    path = tmp_path / "r.jsonl"
    path.write_text(json.dumps({"key": "b", "value": PAPER}) + "\n" + json.dumps({"key": "a", "value": {"metadata": {"title": "Only", "publish date": "1999"}}}))
    rows = {r.article_key: r for r in parsing.pds_articles(readers.pds_records(spark, str(path)), "col").collect()}
    assert set(rows) == {"col:a", "col:b"} and rows["col:a"].pub_year == 1999 and not rows["col:a"].has_body


def test_markup(spark):
    html = "<html><head><title>t</title></head><body><nav>menu</nav><h2>Head &amp; more</h2><p>One <b>two</b>.</p><script>x()</script><p>Three</p></body></html>"
    assert markup.visible(html) == [("Head & more", "One two."), ("Head & more", "Three")]
    assert markup.visible(None) == []
    assert markup.page_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).where(F.col("page_id") == 1).count() == 2

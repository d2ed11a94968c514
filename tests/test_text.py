import pytest
from pyspark.sql import functions as F

from scholia.functions import analysis, text
from scholia.operators import chunking, parsing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw",
    ["shown in ( ) and [ , – ].", "health,. next", "pathways,,, .", "state-of-the-art.", "a  b\n c\t!", "end ,;", "x [12] (y)", "nbsp here", "", "   ", "stress–. End—"],
)
def test_clean_twins_agree(spark, raw):
    assert one(spark, text.clean_text(F.lit(raw))) == parsing.clean(raw)


@pytest.mark.parametrize(
    ("kind", "title", "want"),
    [("intro", "x", "Introduction"), ("COI-statement", None, "Acknowledgements"), (None, "2.1 Materials and Methods", "Methods"), ("odd", "Results and Discussion", "Results"), (None, "Summary of findings", "Results"), (None, None, "Unknown"), (None, " ", "Unknown"), (None, "Funding", "Acknowledgements")],
)
def test_sections(spark, kind, title, want):
    assert one(spark, text.classify_section(F.lit(kind).cast("string"), F.lit(title).cast("string"))) == want
    assert parsing.classify(kind, title) == want


def test_excerpt(spark):
    assert one(spark, text.excerpt(F.lit("short"), 10)) == "short"
    assert one(spark, text.excerpt(F.lit("one two three"), 8)) == "one two ..."
    assert one(spark, text.excerpt(F.lit("one two three"), 7)) == "one two ..."
    assert one(spark, text.excerpt(F.lit("abcdefghijk"), 5)) == "abcde ..."


def test_lists_and_ids(spark):
    assert one(spark, text.join_distinct(F.array(*map(F.lit, [" B", "a", "b ", "", "A", "c"])))) == "B; a; c"
    assert one(spark, text.join_distinct(F.array().cast("array<string>"))) is None
    assert one(spark, text.split_names(F.lit("A; b;a ;;x"))) == []
    assert one(spark, text.split_names(F.lit("Ab; cd;ab ;;x"))) == ["ab", "cd"]
    assert one(spark, text.normalise_doi(F.lit(" HTTPS://doi.org/10.1/X"))) == "10.1/x"
    assert one(spark, text.normalise_doi(F.lit("11.1/x"))) is None
    assert one(spark, text.normalise_work_id(F.lit("https://openalex.org/w12"))) == "https://openalex.org/W12"
    assert one(spark, text.normalise_work_id(F.lit("W12x"))) is None
    assert one(spark, text.title_key(F.lit(" A Title..."))) == "a title"


def test_dates(spark):
    assert one(spark, text.full_date(F.lit(2020), F.lit(13), F.lit(None).cast("int"))) == "2020-01-01"
    assert one(spark, text.flexible_date(F.lit(2020), F.lit(3), F.lit(None).cast("int"))) == "2020-03"
    assert one(spark, text.flexible_date(F.lit(2020), F.lit(None).cast("int"), F.lit(4))) == "2020"


def test_inverted_index(spark):
    m = F.from_json(F.lit('{"a":[0,3],"b":[1,-1],"c":[3]}'), "map<string,array<int>>")
    assert one(spark, text.inverted_index_text(m)) == "a b c"
    assert one(spark, text.inverted_index_text(F.from_json(F.lit("{}"), "map<string,array<int>>"))) is None


def test_hard_split(spark):
    words = [str(i) for i in range(100)]
    got = one(spark, text.hard_split(F.array(*map(F.lit, words)), 40, 10, 30))
    assert got == chunking._windows(words, 40, 10, 30)
    assert one(spark, text.hard_split(F.array().cast("array<string>"))) == []


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("controlling", "control"), ("rate", "rate"), ("sky", "sky"), ("neurons", "neuron")],
)
def test_stems(word, want):
    assert analysis.stem(word) == want


def test_analysis(spark):
    assert analysis.analyze("The Doctor's café — and Neurons, 3.5 mg!") == ["doctor", "cafe", "neuron", "3.5", "mg"]
    got = spark.createDataFrame([("Running to the Hills",), (None,)], "t string").select(analysis.analyze_column("t").alias("x")).collect()
    assert [r.x for r in got] == [["run", "hill"], []]


def test_sentences_and_packing():
    assert chunking.sentences("See Fig. 3 now. Next one! (And) more? yes. 4 is.") == ["See Fig. 3 now.", "Next one!", "(And) more? yes.", "4 is."]
    words = " ".join(f"W{i} " + " ".join(["x"] * 8) + "." for i in range(60))
    out = chunking.pack(words, 100, 20, 30)
    assert all(len(p.split()) <= 100 for p in out[:-1]) and out[0].split()[-18:] == out[1].split()[:18]
    assert chunking.pack("Only a few words.") == ["Only a few words."]
    long = " ".join(["y"] * 500)
    assert [len(p.split()) for p in chunking.pack(long, 100, 20, 30)] == [100] * 6
    assert chunking.pack("") == []

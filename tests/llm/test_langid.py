from scholia.llm import langid


def test_rare_labels_are_all_eligible(spark):
    rows = spark.range(40000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'der hund liegt auf dem sofa', 'the cat sat on the mat') AS text", "if(id < 30, if(id % 2 = 0, 'de', 'en'), null) AS lang")
    model = langid.train(rows, sample_rows=20)
    assert model is not None and list(model.labels) == ["de", "en"]

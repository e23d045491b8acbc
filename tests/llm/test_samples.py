from graphweir.llm import language_id


def test_copies_do_not_thin_a_language(spark):
    rows = [(i, f"text number {'abcde'[i % 5]}", "xx") for i in range(8000)] + [(9000 + i, f"other {i}", "yy") for i in range(50)]
    sample = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 80, "doc_id", "text", "lang")
    assert len({t for y, t in sample if y == "xx"}) == 5 and len(sample) > 30

"""Answers of a model that turns texts into search strings."""

from lexfold.operators import rewriting


def test_an_empty_answer_is_no_failure(spark):
    d = spark.createDataFrame([(1, "nothing"), (2, " "), (3, "fails"), (4, "none"), (5, "word")], "id long, text string")

    def model(text):
        if text == "fails":
            raise TimeoutError
        return {"nothing": " ", "none": None}.get(text, text)

    assert dict(map(tuple, rewriting.search_strings(d, model).collect())) == {1: "", 2: None, 3: None, 4: None, 5: "word"}
    assert dict(map(tuple, rewriting.similar_terms(d, model).collect())) == {1: None, 2: None, 3: None, 4: None, 5: "word"}

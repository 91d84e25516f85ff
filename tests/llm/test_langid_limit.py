"""The bound on the number of languages leaves none out."""

import pytest

from quern.llm import langid


def test_more_languages_than_the_bound_are_an_error(spark):
    rows = [(i, f"some words of {lang}", lang) for i, lang in enumerate(["aa", "bb", "cc"] * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df, max_langs=3).langs == ["aa", "bb", "cc"]
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.fit(df, max_langs=2)

"""Words that share their place and number."""

import pytest

from folioframe.operators import layout

WORDS = [(1, 0, 5, 10.0, 30.0, 100.0, 112.0, "Ana"), (1, 0, 5, 10.0, 30.0, 100.0, 111.0, "Silva"), (1, 0, 6, 40.0, 60.0, 100.0, 111.0, ".")]


@pytest.mark.parametrize("words", [WORDS, WORDS[::-1]])
def test_tied_words_stand_in_a_line_as_it_gathered_them(spark, words):
    df = spark.createDataFrame([w + (None,) for w in words], "doc_id long, page long, word_no long, x0 double, x1 double, top double, bottom double, text string, gap double")
    got = layout.words_to_lines(df).select("line", "n_words", "text").collect()
    assert [tuple(r) for r in got] == [(0, 3, "Silva Ana.")]

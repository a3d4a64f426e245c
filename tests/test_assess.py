"""Confidence of fields that a profile does not have."""

from folioframe.operators import assess


def scores(df):
    return {r["cand_id"]: r["score"] for r in df.collect()}


def test_links_that_are_missing_count_nothing(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "cand_id long")
    links = spark.createDataFrame([(2, "https://github.com/x"), (2, "http://a.example"), (3, None)], "cand_id long, url string")
    assert scores(assess.link_confidence(people, links)) == {1: 0.0, 2: 0.75, 3: 0.0}


def test_lists_that_are_missing_count_nothing(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "cand_id long")
    items = spark.createDataFrame([(2, "Chess"), (2, "Go"), (3, None)], "cand_id long, item string")
    shown = spark.createDataFrame([(1, "awards"), (2, "awards")], "cand_id long, section string")
    assert scores(assess.list_confidence(people, items, shown, "awards")) == {1: 0.0, 2: 0.6, 3: 0.0}


def test_skills_that_are_missing_count_nothing(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "cand_id long")
    skills = spark.createDataFrame([(2, "Go"), (2, "• SQL"), (3, None)], "cand_id long, skill string")
    shown = spark.createDataFrame([(1, "skills"), (2, "skills")], "cand_id long, section string")
    assert scores(assess.skill_confidence(people, skills, shown)) == {1: 0.0, 2: 0.5, 3: 0.05}

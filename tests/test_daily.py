import pytest
from pyspark.sql import functions as F

from feedloom.plans import daily
from feedloom.schema import ARTICLE
from feedloom.sources.models import stub_scorer
from feedloom.sources.params import parameters

FEED = "id string, title string, link string, abstract string, author string, category string, announce string"


@pytest.fixture
def made(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    empty = spark.createDataFrame([], ARTICLE)
    papers = spark.createDataFrame([("p", "p", "Paper", 8, "2024-02-04 10:00", "text")], "id string, arxiv_id string, title string, rating int, updated_at string, abstract string")
    feed = spark.createDataFrame([(f"n{i:02d}", f"title {i}" + " casino" * (i == 3), "l", None, None, "c", "new") for i in range(30)], FEED)

    def run(preferences, **given):
        return daily.run(empty, papers, [feed], preferences, stub_scorer, F.lit("2024-02-05").cast("date"), F.lit("2024-02-05 08:00:00").cast("timestamp"), "2024-02-04", "s", parameters(given))

    return run


def test_a_cycle(made):
    out = made("likes x", daily_papers=10, filter_keywords=("Casino",))
    rows = {r.id: r for r in out.articles.collect()}
    assert len(rows) == 29
    assert out.inserted.count() == 29
    assert "n03" not in rows
    picks = sorted((r for r in rows.values() if r.recommend_date), key=lambda r: r.batch_order)
    pool = sum(r.score >= 0 for r in rows.values())
    assert [r.batch_order for r in picks] == list(range(min(10, pool)))
    by_score = [r for r in picks if r.recommendation_type == "score"]
    best = sorted((r.score for r in rows.values() if r.score >= 0), reverse=True)[:7]
    assert [r.score for r in by_score] == best
    assert out.preference_prompt.first().prompt == "likes x\n\n- [read in depth, rated 8/10] Paper: text"


def test_without_preferences_the_newest_are_picked_unscored(made):
    rows = made("", daily_papers=5, diversity_ratio=0.0).articles.where("recommend_date is not null").collect()
    assert len(rows) == 5
    assert {r.score for r in rows} == {0.0}

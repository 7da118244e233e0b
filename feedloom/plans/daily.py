"""The daily run as one composition: scan, filter, insert, score, select."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.json import exploded_scores
from feedloom.functions.text import truncated
from feedloom.operators.aggregates import ordered_text
from feedloom.operators.recommend import feedback, feedback_label, mark_daily, scoring_prompts
from feedloom.operators.select import unscored, without_keywords
from feedloom.operators.store import insert_ignore, update_scores
from feedloom.schema import ARTICLE, conformed
from feedloom.sources.feeds import fetched
from feedloom.sources.models import Model, replied
from feedloom.sources.params import Parameters


@dataclass
class Run:
    """What a run made: the next article table, the rows it inserted, the prompt about preferences."""

    articles: DataFrame
    inserted: DataFrame
    preference_prompt: DataFrame


def fetch_and_store(articles: DataFrame, feeds: list[DataFrame], at: Column, keywords: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(next table, inserted rows). A fetch by hand passes no keywords: it isn't filtered."""
    new = without_keywords(fetched(feeds, articles), list(keywords))
    new = new.withColumns({"created_at": at, "status": F.lit(0), "score": F.lit(0.0)})
    return insert_ignore(articles, conformed(new, ARTICLE), "id", [F.col("title")])


def preference_prompt(articles: DataFrame, papers: DataFrame, since: str, old: str) -> DataFrame:
    """One row ``prompt``, or none if there is no feedback."""
    rows = feedback(articles, papers, since)
    label = feedback_label(F.col("status"), F.col("source"), F.col("rating"))
    line = F.concat(F.lit("- ["), label, F.lit("] "), F.coalesce("title", F.lit("")), F.lit(": "), truncated(F.coalesce("abstract", F.lit("")), 300))
    text = rows.select(F.concat("source", "id").alias("k"), line.alias("line")).agg(ordered_text("k", F.col("line"), "\n").alias("lines"), F.count(F.lit(1)).alias("n"))
    return text.where("n > 0").select(F.concat(F.lit(old + "\n\n"), "lines").alias("prompt"))


def scored(articles: DataFrame, preferences: str, model: Model, size: int) -> DataFrame:
    """The table after scoring its newest unscored rows; without preferences nothing is scored."""
    if not preferences.strip():
        return articles
    prompts = scoring_prompts(unscored(articles), preferences, size)
    # one checkpoint: the replies are used once for each row of the table, and a call costs money
    replies = replied(prompts, model).checkpoint()
    return update_scores(articles, exploded_scores(replies, "reply", "batch"), [F.col("batch")])


def run(articles: DataFrame, papers: DataFrame, feeds: list[DataFrame], preferences: str, model: Model, date: Column, at: Column, since: str, seed: str, given: Parameters) -> Run:
    """A full cycle. Feedback is read before anything changes."""
    prompt = preference_prompt(articles, papers, since, preferences)
    stored, inserted = fetch_and_store(articles, feeds, at, given.filter_keywords)
    rated = scored(stored, preferences, model, given.scoring_batch_size)
    return Run(mark_daily(rated, date, given.daily_papers, given.diversity_ratio, seed), inserted, prompt)

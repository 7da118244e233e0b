"""Replies of language models: fenced JSON, scores, tool arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import trimmed

SCORES = "array<struct<id: string, score: double>>"


def unfenced(s: Column) -> Column:
    """Without a code fence around it."""
    x = F.regexp_replace(trimmed(s), r"^```(?:json)?", "")
    return trimmed(F.regexp_replace(x, r"```$", ""))


def parsed_scores(s: Column) -> Column:
    """``array<struct<id, score>>``: empty ids go, scores are clamped to [-1, 1]; null if invalid.

    Of an id that comes twice the last score stays.
    """
    items = F.filter(F.from_json(unfenced(s), SCORES), lambda x: F.coalesce(x["id"], F.lit("")) != "")
    clamp = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(x["score"], F.lit(0.0))))
    clean = F.transform(items, lambda x: F.struct(x["id"].alias("id"), clamp(x).alias("score")))
    ids = F.transform(clean, lambda x: x["id"])
    later = lambda i: F.slice(ids, i + 2, F.greatest(F.size(ids) - i - 1, F.lit(0)))
    return F.filter(clean, lambda x, i: ~F.array_contains(later(i), x["id"]))


def exploded_scores(replies: DataFrame, reply: str = "reply", *keep: str) -> DataFrame:
    """``id, score`` of all replies, with the columns to ``keep``; a reply that can't be read gives no row."""
    return replies.select(F.explode(parsed_scores(F.col(reply))).alias("x"), *keep).select("x.id", "x.score", *keep)


def json_object(s: Column) -> Column:
    """From the first ``{`` to the last ``}`` after the fence is off; null without both."""
    x = F.regexp_extract(unfenced(s), r"(?s)(\{.*\})", 1)
    return F.nullif(x, F.lit(""))


def tool_argument(arguments: Column, name: str) -> Column:
    return F.get_json_object(arguments, f"$.{name}")


def translation(reply: Column) -> Column:
    """``struct<title, abstract>`` of a translation reply; null if it can't be read."""
    return F.from_json(json_object(reply), "title string, abstract string")

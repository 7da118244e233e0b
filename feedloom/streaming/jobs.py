"""Scheduled and at-least-once work, written so that a repeated run changes nothing."""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import network_error, token_error, truncated
from feedloom.operators.aggregates import ordered_text
from feedloom.operators.recommend import in_batches
from feedloom.operators.select import shown_title
from feedloom.operators.store import mark_pushed_set
from feedloom.streaming.outbox import delivered
from feedloom.tables import materialized

#: What the outbox holds of each card.
SENT = "key string, page int, pages int, ids string, body string"


def due(now: datetime, time_of_day: str, last_run: str, enabled: bool = True) -> bool:
    """Whether the daily run starts in this minute: once a day, a missed minute is a missed day."""
    return enabled and now.strftime("%H:%M") == time_of_day and last_run != now.strftime("%Y-%m-%d")


def due_slots(ticks: DataFrame, slots: list[str], done: DataFrame) -> DataFrame:
    """``day, slot`` of ``ticks(now)`` that fall on a slot that is not in ``done(day, slot)``.

    A failed run isn't in ``done``, so its slot comes up again at the next tick of that minute.
    """
    at = ticks.select(F.to_date("now").alias("day"), F.date_format("now", "HH:mm").alias("slot")).where(F.col("slot").isin(slots))
    return at.distinct().join(done, ["day", "slot"], "left_anti")


class SingleFlight:
    """At most one run at a time; a second start is refused."""

    def __init__(self):
        self.lock = threading.Lock()

    def run(self, work: Callable[[], None]) -> bool:
        if not self.lock.acquire(blocking=False):
            return False
        try:
            work()
        finally:
            self.lock.release()
        return True


def pending(articles: DataFrame, path: str) -> DataFrame:
    """Recommended rows that are neither marked as pushed nor in the outbox at ``path``."""
    waiting = articles.where("pushed_at is null and recommend_date is not null")
    sent = delivered(articles.sparkSession, path, SENT).select(F.explode(F.split("ids", ",")).alias("id"))
    return waiting.join(sent, "id", "left_anti")


def drained(articles: DataFrame, path: str, size: int = 500, per_card: int = 8, format: str = "outbox") -> int:
    """Deliver the backlog as cards, oldest first, in batches of ``size`` rows; gives the number of rows.

    A batch is a job of its own: its cards go out page by page in one task, which has ``size`` rows at most, and the
    batch is committed once all have gone out. The first failure is raised and ends the drain: the batches
    before it are committed, the rest waits. Run again, it goes on with what the outbox lacks. Rows are
    numbered and cut by Spark; the driver sees the number of batches and counts.
    """
    order = (F.col("recommend_date"), F.asc_nulls_first("batch_order"), F.col("id"))
    rows = in_batches(shown_title(pending(articles, path)).select("id", "recommend_date", "batch_order", "title", "abstract"), size, *order)
    rows = materialized(card_pages(rows, per_card, size).repartition("batch"), "cards", by="batch")
    done, run = 0, uuid.uuid4().hex
    for r in rows.groupBy("batch").agg(F.sum("n").alias("n")).orderBy("batch").toLocalIterator():  # a row a batch
        batch = rows.where(F.col("batch") == r["batch"]).coalesce(1).sortWithinPartitions("page")
        batch.select("key", "page", "pages", "ids", "body").write.format(format).option("path", path).option("commit", f"{run}-{r['batch']:09d}").mode("append").save()
        done += r["n"]
    return done


def card_pages(rows: DataFrame, per_card: int, size: int) -> DataFrame:
    """``batch, key, page, pages, n, ids, body`` of rows in batches: pages of ``per_card`` rows, from 1 in each batch."""
    place = F.col("pos") % size
    line = F.concat(F.lit("**"), F.coalesce("title", F.lit("")), F.lit("**\n"), truncated(F.coalesce("abstract", F.lit("")), 200))
    pages = rows.withColumn("page", (F.floor(place / per_card) + 1).cast("int")).groupBy("batch", "page")
    pages = pages.agg(F.count(F.lit(1)).alias("n"), ordered_text("pos", F.col("id"), ",").alias("ids"), ordered_text("pos", line, "\n\n").alias("body"))
    counts = pages.groupBy("batch").agg(F.max("page").alias("pages"))
    first = F.split_part("ids", F.lit(","), F.lit(1))
    return pages.join(counts, "batch").withColumn("key", F.concat(first, F.lit("-"), "page"))


def marked(articles: DataFrame, path: str, at: Column) -> DataFrame:
    """``articles`` with ``pushed_at`` for all that the outbox holds; what was marked before keeps its time."""
    sent = delivered(articles.sparkSession, path, SENT).select(F.explode(F.split("ids", ",")).alias("id"))
    waiting = articles.where("pushed_at is null").select("id")
    return mark_pushed_set(articles, sent.join(waiting, "id", "left_semi"), at)


def with_retries(call: Callable[[], object], refresh: Callable[[], None] = lambda: None, sleep: Callable[[float], None] = time.sleep, seed: int = 0):
    """A token error: refresh and one more try. A network error: three more, waiting half a second,
    doubled each time, and up to a quarter more. Other errors are raised at once.

    Where no try helps, the first error is raised; after a refresh, the second.
    """
    try:
        return call()
    except Exception as error:
        if token_error(str(error)):
            try:
                refresh()
            except Exception:
                raise error from None
            return call()
        if not (isinstance(error, TimeoutError) or network_error(str(error))):
            raise
        jitter, first = random.Random(seed), error
    for i in range(3):
        sleep(0.5 * 2**i * (1 + jitter.random() / 4))
        try:
            return call()
        except Exception:  # the next try
            continue
    raise first

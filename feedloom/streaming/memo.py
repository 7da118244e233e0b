"""Answers that are remembered for a while: one call a key and period, however often it is asked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: how long an answer is good, in milliseconds.
KEEP = 24 * 3600 * 1000

Answer = Callable[[str], str]


class Memo(StatefulProcessor):
    def __init__(self, answer: Answer, keep: int):
        self.answer, self.keep = answer, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "answer string, at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        answer, at = self.known.get() if self.known.exists() else (None, None)
        for r in sorted(rows, key=lambda r: r["ts"]):
            now = round(r["ts"].timestamp() * 1_000_000)
            fresh = at is None or now - at >= self.keep * 1000
            if fresh:
                answer, at = self.answer(key[0]), now
            yield Row(key=key[0], ts=r["ts"], answer=answer, fresh=fresh)
        self.known.update((answer, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at // 1000 + self.keep + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.known.clear()
        return iter([])

    def close(self) -> None:
        pass


def remembered(asks: DataFrame, answer: Answer, keep: int = KEEP) -> DataFrame:
    """A stream of ``asks(key, ts)`` under a watermark to ``key, ts, answer, fresh``.

    ``fresh`` tells that the answer was asked for; else it is the one of the last ``keep`` milliseconds. A key
    is forgotten once the watermark has passed the end of that time. Failures of ``answer`` fail the batch, so
    nothing is remembered of them. The session needs the state store of :mod:`feedloom.streaming.chat`.
    """
    return asks.groupBy("key").transformWithState(Memo(answer, keep), "key string, ts timestamp, answer string, fresh boolean", "append", "eventTime")


def asked_anew(asks: DataFrame, keep: int = KEEP) -> DataFrame:
    """``key, ts, fresh`` of a table of asks, as :func:`remembered` has them: repeated rows are asks of their own.

    The asks of one key are told apart in steps: those within ``keep`` of the first are not fresh, and so on from the
    next. That is a fold in the order of time over the key's times, which carries the fresh ones: one for each ``keep``.
    """
    rows = asks.groupBy("key").agg(F.array_sort(F.collect_list(F.unix_micros("ts"))).alias("times"))
    start = F.array().cast("array<bigint>")
    fresh = lambda found, t: F.coalesce(t - F.get(found, F.size(found) - 1) >= keep * 1000, F.lit(True))
    rows = rows.withColumn("found", F.aggregate("times", start, lambda found, t: F.when(fresh(found, t), F.concat(found, F.array(t))).otherwise(found)))
    first = lambda t, i: F.array_contains("found", t) & F.coalesce(F.get("times", i - 1) != t, F.lit(True))
    marked = rows.select("key", F.explode(F.transform("times", lambda t, i: F.struct(t.alias("t"), first(t, i).alias("fresh")))).alias("x"))
    return marked.select("key", F.timestamp_micros("x.t").alias("ts"), "x.fresh")

"""Times of day, fetch slots and holidays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The hours of the feed slots, relative to the daily time.
SLOT_HOURS = (-1, 7, 15)


def is_time_of_day(s: Column) -> Column:
    return s.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")


def fetch_slots(time_of_day: Column) -> Column:
    """The three feed times of a daily time, as ``HH:MM``; null if it isn't one."""
    hour, minute = F.substring(time_of_day, 1, 2).try_cast("int"), F.substring(time_of_day, 4, 2)
    slot = lambda d: F.concat(F.lpad(F.pmod(hour + d, F.lit(24)).cast("string"), 2, "0"), F.lit(":"), minute)
    return F.when(is_time_of_day(time_of_day), F.array(*map(slot, SLOT_HOURS)))


def next_run(now: Column, time_of_day: Column) -> Column:
    """The next time at that time of day, after ``now``."""
    minutes = F.substring(time_of_day, 1, 2).try_cast("int") * 60 + F.substring(time_of_day, 4, 2).try_cast("int")
    today = F.date_trunc("DAY", now) + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    due = F.when(today <= now, today + F.expr("INTERVAL 1 DAY")).otherwise(today)
    return F.when(is_time_of_day(time_of_day), due)


def is_weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7)


def holiday_codes(kind: Column, status: Column, number: Column) -> list[Column]:
    """Whether each of three providers calls a day a holiday; null where it didn't answer."""
    return [kind.isin(1, 2), status == 2, number != 0]


def holidays(days: DataFrame, providers: list[tuple[str, DataFrame]]) -> DataFrame:
    """``day, is_holiday, name, source``: the first provider that answers, else the weekend rule.

    A provider is ``(day, is_holiday, name)`` with one row for each day; ``is_holiday`` null is no
    answer. Provider tables hold a row a day, so each join is a small one.
    """
    out, found = days.select("day").distinct(), []
    for i, (name, table) in enumerate(providers):
        side = table.select("day", F.col("is_holiday").alias(f"h{i}"), F.col("name").alias(f"n{i}"))
        out = out.join(side, "day", "left")
        found.append((F.col(f"h{i}"), F.col(f"n{i}"), name))
    yes, label, source = is_weekend(F.col("day")), F.lit(""), F.lit("weekend")
    for h, n, name in reversed(found):
        yes, label = F.coalesce(h, yes), F.when(h.isNotNull(), F.coalesce(n, F.lit(""))).otherwise(label)
        source = F.when(h.isNotNull(), F.lit(name)).otherwise(source)
    return out.select("day", yes.alias("is_holiday"), label.alias("name"), source.alias("source"))


def relative_day(at: Column, as_of: Column) -> Column:
    """today, yesterday, ``n`` days ago, or the date after a week."""
    n = F.datediff(as_of, at)
    return F.when(n <= 0, "today").when(n == 1, "yesterday").when(n < 7, F.concat(n.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(at, "yyyy-MM-dd"))

"""The algebra of an article's status: 0 unread, 3 read, 1 activated, 2 liked, -1 disliked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A status replaces another if it ranks higher.
RANKS = {0: 0, 3: 1, 1: 2, 2: 3, -1: 3}


def status_rank(status: Column) -> Column:
    out = F.lit(0)
    for value, rank in RANKS.items():
        out = F.when(status == value, rank).otherwise(out)
    return out


def merged_status(old: Column, new: Column) -> Column:
    """One step: the same non-zero status is taken back, liked and disliked switch, higher wins."""
    return (
        F.when((old == new) & (old != 0), 0)
        .when((old == 2) & (new == -1), -1)
        .when((old == -1) & (new == 2), 2)
        .when(status_rank(new) > status_rank(old), new)
        .otherwise(old)
        .cast("int")
    )


def merged_status_bulk(old: Column, new: Column) -> Column:
    """A step of a bulk action: only a higher rank replaces; nothing is taken back or switched."""
    return F.when(status_rank(new) > status_rank(old), new).otherwise(old).cast("int")


def folded_status(events: Column) -> Column:
    """The status after an array of ``struct<..order.., v>``, sorted by its first fields."""
    return F.aggregate(F.array_sort(events), F.lit(0), lambda acc, e: merged_status(acc, e["v"]))

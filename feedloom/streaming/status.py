"""Status events as a stream: the fold of one article's or user's events, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from feedloom.functions.state import RANKS, folded_status

#: What an event of the store's log means.
EVENT_STATUS = {"error": -1, "click": 1, "view": 3, "purchase": 2, "signup": 0}
#: What a reader's action writes.
ACTIONS = {"like": 2, "dislike": -1, "mark_page_read": 3, "activate": 1}


def event_status(event_type: Column) -> Column:
    out = F.lit(0)
    for name, value in EVENT_STATUS.items():
        out = F.when(event_type == name, value).otherwise(out)
    return out.cast("int")


def action_status(action: Column) -> Column:
    """The status an action writes; null for an unknown one."""
    out = F.lit(None).cast("int")
    for name, value in ACTIONS.items():
        out = F.when(action == name, value).otherwise(out)
    return out


def merge(old: int, new: int) -> int:
    if old == new and new:
        return 0
    if {old, new} == {2, -1} or RANKS.get(new, 0) > RANKS.get(old, 0):
        return new
    return old


def folded(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``key, status`` of a batch of ``events(key, order.., v)``."""
    rows = F.collect_list(F.struct(*order, "v"))
    return events.groupBy(key).agg(folded_status(rows).alias("status"))


def folded_stream(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """As :func:`folded` for a stream, in update mode: within a micro-batch by ``order``, later
    batches after earlier ones."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else 0
        for v in pd.concat(list(frames)).sort_values(order)["v"]:
            status = merge(status, int(v))
        state.update((status,))
        yield pd.DataFrame({key: [k[0]], "status": [status]})

    schema = f"{key} {dict(events.dtypes)[key]}, status int"
    return events.groupBy(key).applyInPandasWithState(step, schema, "status int", "update", GroupStateTimeout.NoTimeout)


def ingests(actions: DataFrame, articles: DataFrame) -> DataFrame:
    """Ids whose activation starts reading them in: those not activated before."""
    return actions.where("action = 'activate'").select("id").distinct().join(articles.select("id", "status"), "id").where("status <> 1").select("id")

"""Lookups at a service that allows few calls at once and few a second."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

#: Calls in flight, and lookups a second.
IN_FLIGHT, PER_SECOND = 5, 2.0

Lookup = Callable[[str], int | None]


class Ticks:
    """Lets one caller go on at each tick, in the order in which they came; ticks not used are lost."""

    def __init__(self, every: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.every, self.clock, self.sleep = every, clock, sleep
        self.lock, self.next = threading.Lock(), clock() + every

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            mine = max(self.next, now)
            self.next = mine + self.every
        if mine > now:
            self.sleep(mine - now)


def looked_up(keys: DataFrame, lookups: dict[str, Lookup], key: str = "id", in_flight: int = IN_FLIGHT, per_second: float = PER_SECOND, tasks: int = 1) -> DataFrame:
    """``key`` and a column (int) for each of ``lookups``, one row for each row of ``keys``.

    A tick starts all lookups of one key, one after the other, so several services are asked once a tick each. All
    tasks together have ``per_second`` ticks a second and ``in_flight`` keys at once: the keys are dealt to
    ``tasks`` tasks, each with its share of both (one key at least, so no more tasks than ``in_flight``). A
    lookup that fails gives null. A task holds one batch of keys and its answers.
    """
    if not 1 <= tasks <= in_flight:
        raise ValueError(f"1 to {in_flight} tasks, not {tasks}")
    share, every = in_flight // tasks, tasks / per_second

    def one(ticks: Ticks, value: str) -> list[int | None]:
        ticks.wait()
        found = []
        for lookup in lookups.values():
            try:
                found.append(lookup(value))
            except Exception:  # what can't be asked stays unknown
                found.append(None)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ticks = Ticks(every)
        with ThreadPoolExecutor(share) as pool:
            for batch in batches:
                rows = list(pool.map(lambda v: one(ticks, v), batch.column(key).to_pylist()))
                found = [pa.array([r[i] for r in rows], pa.int32()) for i in range(len(lookups))]
                yield pa.RecordBatch.from_arrays([batch.column(key), *found], names=[key, *lookups])

    schema = f"{key} {dict(keys.dtypes)[key]}" + "".join(f", {name} int" for name in lookups)
    return keys.select(key).repartition(tasks).mapInArrow(run, schema)

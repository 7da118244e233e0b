"""Feeds over HTTP as a Spark source: one partition a feed, tries again on failure, on the executors."""

from __future__ import annotations

import time
import urllib.request
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from feedloom.sources.feeds import fetched, items_of_texts, parsed
from feedloom.tables import materialized

Get = Callable[[str], bytes]
#: Tries after the first, and seconds to wait, times the number of the try.
RETRIES, BACK_OFF, TIMEOUT = 2, 1.0, 30


def http_get(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=TIMEOUT) as reply:
        return reply.read()


@dataclass
class Feed(InputPartition):
    place: int
    category: str


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], get: Get):
        self.categories = [c for c in options.get("categories", "").split(",") if c]
        self.url, self.file = options.get("url", ""), options.get("file")
        self.retries, self.wait = int(options.get("retries", RETRIES)), float(options.get("back_off", BACK_OFF))
        self.get = get

    def partitions(self) -> Sequence[InputPartition]:
        return [Feed(i, c) for i, c in enumerate(self.categories)] or [Feed(0, "")]

    def read(self, partition: Feed) -> Iterator[tuple]:
        if partition.category:
            yield partition.place, partition.category, self._body(partition.category)

    def _body(self, category: str) -> str:
        if self.file:
            with open(self.file, encoding="utf-8") as f:
                return f.read()
        url, last = self.url.replace("{category}", category.lower()), None
        for k in range(self.retries + 1):
            time.sleep(k * self.wait)
            try:
                body = self.get(url)
                ElementTree.fromstring(body)  # a reply that can't be parsed is no reply
                return body.decode("utf-8", errors="replace")
            except Exception as error:  # the next try
                last = error
        raise OSError(f"fetch category {category}: after {self.retries} retries: {last}")


def register(spark: SparkSession, get: Get = http_get, name: str = "feeds") -> None:
    """Make the format ``name`` known: rows ``place, category, body``, one a feed.

    Options: ``categories``, joined by commas; ``url``, with ``{category}`` for the lower-cased name; ``retries`` and
    ``back_off``; ``file``, a file that is read in place of all feeds. A feed that fails to the end fails the job.
    """

    class Feeds(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "place int, category string, body string"

        def reader(self, schema: StructType) -> FeedReader:
            return FeedReader(dict(self.options), get)

    spark.dataSource.register(Feeds)


def fetched_feeds(spark: SparkSession, categories: list[str], stored: DataFrame, most: int = 100, format: str = "feeds", **options: str) -> DataFrame:
    """New rows of the feeds of ``categories``, as :func:`feedloom.sources.feeds.fetched` has them.

    Each feed is fetched once: the bodies are written before they are read by several plans.
    """
    bodies = spark.read.format(format).option("categories", ",".join(categories)).options(**options).load()
    items = items_of_texts(materialized(bodies, "feeds"))
    feeds = [parsed(items.where((F.col("place") == i) & (F.col("category") == c)), c) for i, c in enumerate(categories)]
    return fetched(feeds, stored, most)

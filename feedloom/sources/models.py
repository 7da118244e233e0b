"""Language models behind one interface: a callable from prompts to replies, in Arrow batches.

A network client is the caller's. The functions here keep the contract: a batch that fails gives no
rows, replies are parsed by :mod:`feedloom.functions.json`, and rows without a reply stay as they
were. ``stub_scorer`` is deterministic, for tests.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import nonempty

Model = Callable[[str], str]


def replied(prompts: DataFrame, model: Model, key: str = "batch", per_second: float | None = None) -> DataFrame:
    """``key, reply`` for ``prompts(key, prompt)``; a failed call gives no row.

    ``per_second`` limits the calls of one task; the number of partitions limits tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, replies = [], []
            for i, prompt in enumerate(batch.column("prompt").to_pylist()):
                if per_second:
                    time.sleep(1 / per_second)
                try:
                    replies.append(model(prompt))
                    kept.append(i)
                except Exception:  # a batch whose call fails stays unscored
                    continue
            keys = batch.column(key).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(replies, pa.string())], names=[key, "reply"])

    return prompts.select(key, "prompt").mapInArrow(run, f"{key} {dict(prompts.dtypes)[key]}, reply string")


def stub_scorer(prompt: str) -> str:
    """A score for each ``ID:`` line: its digest, scaled to [-1, 1]."""
    ids = re.findall(r"(?m)^ID: (\S+)$", prompt)
    score = lambda i: round(int(hashlib.md5(i.encode()).hexdigest()[:4], 16) / 32767.5 - 1, 2)
    return "```json\n" + json.dumps([{"id": i, "score": score(i)} for i in ids]) + "\n```"


def stub_translator(prompt: str) -> str:
    title, _, abstract = prompt.partition("\n")
    return json.dumps({"title": title.upper(), "abstract": abstract.upper()})


def translations(articles: DataFrame, model: Model) -> DataFrame:
    """``id, translated_title, translated_abstract``; rows without title and abstract make no call."""
    from feedloom.functions.json import translation

    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    prompts = articles.where(F.coalesce(nonempty(F.col("title")), nonempty(F.col("abstract"))).isNotNull()).select("id", text.alias("prompt"))
    rows = replied(prompts, model, key="id").withColumn("t", translation(F.col("reply"))).where("t is not null")
    return rows.select("id", F.col("t.title").alias("translated_title"), F.col("t.abstract").alias("translated_abstract"))


def title_prompts(papers: DataFrame, most: int = 1000) -> DataFrame:
    return papers.select("ref", F.substring("content", 1, most).alias("prompt"))


def votes(articles: DataFrame, hf: DataFrame, ax: DataFrame) -> DataFrame:
    """``id, hf_upvotes, ax_net_votes`` from two lookup tables; a vote that isn't there is null."""
    out = articles.select("id").join(hf.select("id", "hf_upvotes"), "id", "left")
    return out.join(ax.select("id", (F.col("upvotes") - F.col("downvotes")).cast("int").alias("ax_net_votes")), "id", "left")

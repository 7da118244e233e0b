"""Papers and events as text: Markdown export, templates, server-sent events, overflow chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedloom.functions.fit import OVERFLOW_BYTES, split_markdown
from feedloom.functions.text import escaped_yaml, safe_filename
from feedloom.operators.aggregates import ordered_text

_MARK = re.compile(r"\{\{-?\s*(if\s+\.?(\w+)|else|end|\.?(\w+))\s*-?\}\}")


def rendered(template: str, values: dict[str, str]) -> str:
    """``{{X}}`` or ``{{.X}}`` gives a value, ``{{if X}}..{{else}}..{{end}}`` depends on whether X is empty."""
    out, shown, at = [], [], 0
    for m in _MARK.finditer(template):
        if all(shown):
            out.append(template[at : m.start()])
        at = m.end()
        if m[2]:
            shown.append(bool(values.get(m[2])))
        elif m[1] == "else" and shown:
            shown[-1] = not shown[-1]
        elif m[1] == "end" and shown:
            shown.pop()
        elif m[3] and all(shown):
            out.append(values.get(m[3]) or "")
    return "".join([*out, template[at:]])


def templated(rows: DataFrame, template: str) -> DataFrame:
    """``rows`` with ``body``: a user's template filled with each row's columns."""

    @F.pandas_udf(StringType())
    def run(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([rendered(template, {k: "" if v is None else str(v) for k, v in r.items()}) for r in frame.to_dict("records")], dtype=object)

    return rows.withColumn("body", run(F.struct(*[F.col(c).cast("string").alias(c) for c in rows.columns])))


def exported(papers: DataFrame, messages: DataFrame) -> DataFrame:
    """``ref, file, body``: front matter, summary, and the questions and answers of later rounds."""
    line = F.concat(F.when(F.col("role") == "user", "## Q: ").otherwise("## A\n\n"), F.coalesce("content", F.lit("")))
    talk = messages.where("round >= 1 and role <> 'tool'").groupBy("paper").agg(ordered_text("seq", line, "\n\n").alias("talk"))
    out = papers.join(talk.withColumnRenamed("paper", "ref"), "ref", "left")
    body = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit('title: "'), escaped_yaml(F.col("title")), F.lit('"')),
        F.concat(F.lit('source: "'), escaped_yaml(F.coalesce("source_url", F.lit(""))), F.lit('"')),
        F.lit("---\n"),
        F.when(F.coalesce("initial_summary", F.lit("")) != "", F.concat(F.lit("## Summary\n\n"), "initial_summary", F.lit("\n"))),
        F.col("talk"),
    )
    return out.select("ref", F.concat(safe_filename(F.col("title")), F.lit(".md")).alias("file"), body.alias("body"))


def sse(rows: DataFrame) -> DataFrame:
    """Each row as a server-sent event."""
    return rows.select(F.concat(F.lit("data: "), F.to_json(F.struct("*")), F.lit("\n\n")).alias("event"))


def overflow(rows: DataFrame, text: str, prefix: Column, most: int = OVERFLOW_BYTES) -> DataFrame:
    """``rows`` with ``part``, ``chunk``: long texts in parts, the prefix on the first one."""
    out = rows.select("*", F.posexplode(split_markdown(F.col(text), most)).alias("part", "chunk"))
    return out.withColumn("chunk", F.when(F.col("part") == 0, F.concat(prefix, "chunk")).otherwise(F.col("chunk")))

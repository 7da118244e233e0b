"""Context windows over conversation logs ``(paper, seq, round, role, content, ..., skip_context)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def context_messages(messages: DataFrame) -> DataFrame:
    """What goes into the next prompt: of each contiguous run of a round, the rows up to its last
    assistant row that isn't skipped."""
    order = Window.partitionBy("paper").orderBy("seq")
    change = (F.col("round") != F.lag("round").over(order)).cast("int")
    run = F.sum(F.coalesce(change, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = messages.withColumn("_run", run)
    answer = F.when((F.col("role") == "assistant") & ~F.coalesce("skip_context", F.lit(False)), F.col("seq"))
    return rows.withColumn("_last", F.max(answer).over(Window.partitionBy("paper", "_run"))).where("seq <= _last").drop("_run", "_last")


def recent_context(messages: DataFrame, anchors: DataFrame) -> DataFrame:
    """:func:`context_messages` from the paper's anchor round on, where it has one over 0."""
    out = context_messages(messages).join(anchors.select("paper", "anchor"), "paper", "left")
    return out.where((F.coalesce("anchor", F.lit(0)) <= 0) | (F.col("round") >= F.col("anchor"))).drop("anchor")


def anchors(rounds: DataFrame, budget: int = 30_000, least: int = 2) -> DataFrame:
    """``paper, round, anchor`` after each round of ``rounds(paper, round, prompt, completion)``.

    Where a round used more than the budget, the anchor moves so that ``least`` rounds remain; else
    it stays. 0 means none.
    """
    over = F.coalesce("prompt", F.lit(0)) + F.coalesce("completion", F.lit(0)) > budget
    moved = F.when(over, F.greatest(F.lit(1), F.col("round") - least + 1))
    order = Window.partitionBy("paper").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rounds.select("paper", "round", F.coalesce(F.last(moved, ignorenulls=True).over(order), F.lit(0)).alias("anchor"))


def recent_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last ``2 n`` rows of each paper, whatever their rounds."""
    rank = F.row_number().over(Window.partitionBy("paper").orderBy(F.desc("seq")))
    return messages.withColumn("_r", rank).where(F.col("_r") <= 2 * n).drop("_r")


def fetched_rounds(messages: DataFrame, n: int = 2) -> DataFrame:
    """``paper, round, question, answer`` of the last ``n`` rounds (1..20, else 2) with an answer.

    The answer is the round's last assistant row; the question the nearest user row before it.
    """
    n = n if 1 <= n <= 20 else 2
    user = F.when(F.col("role") == "user", F.struct("seq", "content"))
    before = Window.partitionBy("paper", "round").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = messages.where("round >= 1").withColumn("_q", F.last(user, ignorenulls=True).over(before)["content"]).where("role = 'assistant'")
    rounds = rows.groupBy("paper", "round").agg(F.max(F.struct("seq", F.col("_q").alias("question"), F.col("content").alias("answer"))).alias("x"))
    rank = F.dense_rank().over(Window.partitionBy("paper").orderBy(F.desc("round")))
    return rounds.withColumn("_r", rank).where(F.col("_r") <= n).select("paper", "round", F.coalesce("x.question", F.lit("")).alias("question"), F.col("x.answer").alias("answer"))


def retry_context(messages: DataFrame, target: int, anchor: int = 0) -> DataFrame:
    """Rows before the round that is tried again; here each row's own skip mark counts."""
    return messages.where(~F.coalesce("skip_context", F.lit(False)) & (F.col("round") < target) & (F.col("round") >= anchor))


def round_outline(messages: DataFrame, n: int = 50) -> DataFrame:
    """``paper, round, line``: the first line of each round's first user row, cut to ``n``."""
    first = messages.where("round >= 1 and role = 'user'").groupBy("paper", "round").agg(F.min_by("content", "seq").alias("c"))
    return first.select("paper", "round", F.substring(F.split("c", "\n")[0], 1, n).alias("line"))


def last_by_role(messages: DataFrame, role: str) -> DataFrame:
    return messages.where(F.col("role") == role).groupBy("paper").agg(F.max_by("content", "seq").alias("content"))


def first_content(messages: DataFrame) -> DataFrame:
    """``paper, content``: the document, i.e. the first user row of round 0."""
    return messages.where("round = 0 and role = 'user'").groupBy("paper").agg(F.min_by("content", "seq").alias("content"))


def with_last_answer(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """The last assistant row of each paper in ``answers(paper, content)`` gets its content."""
    last = messages.where("role = 'assistant'").groupBy("paper").agg(F.max("seq").alias("seq"))
    side = last.join(answers.select("paper", F.col("content").alias("_new")), "paper")
    return messages.join(side, ["paper", "seq"], "left").withColumn("content", F.coalesce("_new", "content")).select(*messages.columns)


def without_rounds(messages: DataFrame, rounds: DataFrame) -> DataFrame:
    """Without the rounds in ``rounds(paper, round)``."""
    return messages.join(rounds.select("paper", "round"), ["paper", "round"], "left_anti").select(*messages.columns)


def anchor_after_delete(anchor: Column, deleted: Column) -> Column:
    """Deleting the anchor's round resets it."""
    return F.when(anchor == deleted, 0).otherwise(anchor)


def without_last_round(messages: DataFrame) -> DataFrame:
    """Without the round of the last row (not the highest round); the anchor stays."""
    last = messages.groupBy("paper").agg(F.max_by("round", "seq").alias("round"))
    return without_rounds(messages, last)


def collapsed_blank_lines(lines: DataFrame) -> DataFrame:
    """``lines(doc, pos, line)`` without a blank line after a blank line."""
    before = F.lag("line").over(Window.partitionBy("doc").orderBy("pos"))
    return lines.withColumn("_b", before).where((F.trim("line") != "") | F.col("_b").isNull() | (F.trim("_b") != "")).drop("_b")

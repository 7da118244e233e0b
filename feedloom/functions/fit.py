"""Markdown made to fit cards: counts, safe cuts and fallbacks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# What one card may hold.
CARD_BYTES, CARD_ELEMENTS, CARD_TABLES, OVERFLOW_BYTES = 28_000, 180, 5, 20_000

#: Fixed value: what a card says of a text of which nothing fits.
TOO_LONG = "（内容过长，无法在卡片中展示）"

_TABLE_LINE = re.compile(r"^\s*\|.*\|\s*$")
_FENCE = re.compile(r"^\s*(?:```|~~~)")


def count_tables(s: Column) -> Column:
    """Runs of table lines, each counted once."""
    lines = F.transform(F.split(s, "\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$"))
    starts = F.filter(lines, lambda x, i: x & ((i == 0) | ~F.coalesce(F.get(lines, i - 1), F.lit(False))))
    return F.size(starts)


def count_elements(s: Column) -> Column:
    """An element for each line that isn't blank; a table row outside code counts a quarter of its cells more."""
    lines = F.transform(F.split(s, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    extra = lambda x: F.floor((F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) - 1) / 4).cast("int")

    def step(a: Column, x: Column) -> Column:
        row = (F.length(x) > 1) & x.startswith("|") & x.endswith("|") & ~a["code"]
        n = F.when(x == "", 0).when(row, extra(x) + 1).otherwise(1)
        return F.struct((a["n"] + n).cast("int").alias("n"), (a["code"] != x.startswith("```")).alias("code"))

    return F.aggregate(lines, F.struct(F.lit(0).alias("n"), F.lit(False).alias("code")), step, lambda a: a["n"])


def card_fits(s: Column) -> Column:
    return (F.octet_length(s) <= CARD_BYTES) & (count_elements(s) <= CARD_ELEMENTS) & (count_tables(s) <= CARD_TABLES)


def normalized_quotes(s: Column) -> Column:
    """A blank line after each quote that text follows."""
    return F.regexp_replace(s, r"(?m)^(>[^\n]*)\n(?=[^>\n])", "$1\n\n")


def without_tables(s: Column) -> Column:
    """Table lines taken out, runs of blank lines made one."""
    kept = F.filter(F.split(s, "\n"), lambda x: ~x.rlike(r"^\s*\|.*\|\s*$"))
    return F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")


def _pieces(text: str) -> Iterator[str]:
    """Lines, but a table or a fenced block in one piece."""
    block, kind = "", ""
    for line in text.splitlines(keepends=True):
        if kind == "fence":
            block += line
            if _FENCE.match(line):
                yield block
                block, kind = "", ""
        elif _FENCE.match(line):
            if block:
                yield block
            block, kind = line, "fence"
        elif _TABLE_LINE.match(line):
            block, kind = block + line, "table"
        else:
            if block:
                yield block
            block, kind = "", ""
            yield line
    if block:
        yield block


def split_bytes(text: str, most: int) -> list[str]:
    """Chunks of at most ``most`` bytes whose concatenation is the text.

    Cuts are made between lines, never inside a table or a fenced block unless that alone is too
    long; a line that is too long is cut at a code point.
    """
    out, now, size = [], "", 0
    for piece in _pieces(text):
        parts = [piece]
        if len(piece.encode()) > most:
            parts = []
            for line in piece.splitlines(keepends=True):
                raw = line.encode()
                while len(raw) > most:
                    head = raw[:most].decode(errors="ignore") or raw.decode()[0]
                    parts.append(head)
                    raw = raw[len(head.encode()) :]
                if raw:
                    parts.append(raw.decode())
        for part in parts:
            n = len(part.encode())
            if now and size + n > most:
                out.append(now)
                now, size = "", 0
            now, size = now + part, size + n
    return [*out, now] if now or not out else out


def split_markdown(s: Column, most: int = OVERFLOW_BYTES) -> Column:
    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_bytes(t, most), na_action="ignore")

    return run(s)


def fitted(s: Column, most_bytes: int = CARD_BYTES, elements: int = CARD_ELEMENTS, tables: int = CARD_TABLES) -> Column:
    """``struct<part, rest>``: as much of a text as fits one card, cut where a card may end, and what follows.

    A text that fits is its own part. Else the lines that fit in whole are looked through once, with running sums
    of bytes, elements and tables: the part ends after the last blank line that is in no table, fenced block or
    open formula, or without one after the last line that isn't. Where no line will do, it ends within the line
    that has too many bytes, at a code point, or after the last line that fits. If nothing fits, the part is
    ``TOO_LONG`` and the rest the whole text; otherwise part and rest make up the text.
    """
    lines = F.split(s, "\n", -1)
    zero, no = F.lit(0), F.lit(False)
    start = F.struct(zero.alias("bytes"), zero.alias("elements"), zero.alias("tables"), *[no.alias(n) for n in ("code", "table", "math", "over")], *[zero.alias(n) for n in ("fit", "safe", "blank", "cut")])

    def step(a: Column, line: Column) -> Column:
        own = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
        bar = (F.length(own) > 1) & own.startswith("|") & own.endswith("|")
        end = a["bytes"] + F.octet_length(line) + 1
        count = lambda mark: F.length(own) - F.length(F.replace(own, F.lit(mark), F.lit("")))
        n = a["elements"] + F.when(own == "", 0).when(bar & ~a["code"], F.floor((count("|") - 1) / 4).cast("int") + 1).otherwise(1)
        shown = line.rlike(r"^\s*\|.*\|\s*$")
        t = a["tables"] + F.when(shown & ~a["table"], 1).otherwise(0)
        code = a["code"] != own.startswith("```")
        math = a["math"] != (~code & (count("$") % 2 == 1))
        counted = (n <= elements) & (t <= tables)
        fits = ~a["over"] & counted & (end <= most_bytes)
        safe = fits & ~code & ~bar & ~math
        return F.struct(
            end.cast("int").alias("bytes"),
            n.cast("int").alias("elements"),
            t.cast("int").alias("tables"),
            code.alias("code"),
            shown.alias("table"),
            math.alias("math"),
            (~fits).alias("over"),
            F.when(fits, end).otherwise(a["fit"]).cast("int").alias("fit"),
            F.when(safe, end).otherwise(a["safe"]).cast("int").alias("safe"),
            F.when(safe & (own == ""), end).otherwise(a["blank"]).cast("int").alias("blank"),
            F.when(~a["over"] & counted & (end > most_bytes), most_bytes).otherwise(a["cut"]).cast("int").alias("cut"),
        )

    raw = F.encode(s, "UTF-8")
    at = F.aggregate(lines, start, step, lambda a: F.coalesce(*[F.nullif(a[n], zero) for n in ("blank", "safe", "cut", "fit")], zero))
    head = lambda n: F.substring(raw, F.lit(1), n).cast("string")
    part = head(at - 3)
    for back in (2, 1, 0):  # a cut within a line may fall into a code point
        part = F.when(F.is_valid_utf8(head(at - back)), head(at - back)).otherwise(part)
    whole = (F.octet_length(s) <= most_bytes) & (count_elements(s) <= elements) & (count_tables(s) <= tables)
    rest = F.substring(raw, F.octet_length(part) + 1, F.octet_length(s)).cast("string")
    return (
        F.when(s.isNull(), F.lit(None))
        .when(whole, F.struct(s.alias("part"), F.lit("").alias("rest")))
        .when(part == "", F.struct(F.lit(TOO_LONG).alias("part"), s.alias("rest")))
        .otherwise(F.struct(part.alias("part"), rest.alias("rest")))
    )


def fitted_prefix(s: Column, most: int = CARD_BYTES) -> Column:
    """The part of a text that fits one card of ``most`` bytes."""
    return fitted(s, most)["part"]


def page_fallback(s: Column, most: int = 500) -> Column:
    """What a page shows of a text that doesn't fit: no tables, cut to ``most`` code points."""
    plain = without_tables(s)
    return F.when(card_fits(s), s).otherwise(F.when(F.char_length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("..."))).otherwise(plain))

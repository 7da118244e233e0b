"""Fill-in-middle transformation by overlapping-chunk decomposition.

A unit is a run of ASCII letters or any other code point. In UTF-8 a unit begins at each byte that starts a
code point unless it and the byte before are both letters, so a chunk of bytes needs no more than the byte
before it. Chunks count their units, each on its own; the prefix sums of a text's counts say which chunk
owns a cut, and only those chunks are scanned again for the byte at which the cut falls.

Chunks of texts that have more than one are dealt out over all tasks to be counted; only their counts come
back. All other work needs nothing but the row itself, so no text is shuffled but to be counted in chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

#: Bytes of a chunk.
CHUNK = 1 << 16
#: The marks before prefix, suffix and middle.
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_START = np.ones(256, dtype=bool)  # of a code point
_START[0x80:0xC0] = False


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where each row begins and ends in them."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def _unit_starts(column: pa.Array, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the bytes that begin a unit, and the bounds of the rows. The first ``lead`` bytes of a row are
    context."""
    data, at = _bytes(column)
    letter = _LETTER[data]
    follows = np.zeros(len(data), dtype=bool)
    follows[1:] = letter[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    follows[first] = False  # the row before is another chunk
    starts = _START[data] & ~(letter & follows)
    starts[at[:-1][(lead > 0) & (at[:-1] < at[1:])]] = False
    return np.flatnonzero(starts), at


@F.arrow_udf(IntegerType())
def _counted(chunk: pa.Array, lead: pa.Array) -> pa.Array:
    """Units that begin in each chunk."""
    starts, at = _unit_starts(chunk, lead.to_numpy(zero_copy_only=False))
    return pa.array(np.diff(np.searchsorted(starts, at)), pa.int32())


@F.arrow_udf(LongType())
def _located(chunk: pa.Array, lead: pa.Array, rank: pa.Array) -> pa.Array:
    """The byte of each chunk (without its lead) at which unit ``rank`` of it begins; null stays null."""
    lead = lead.to_numpy(zero_copy_only=False)
    starts, at = _unit_starts(chunk, lead)
    asked = rank.fill_null(0).to_numpy(zero_copy_only=False)
    place = np.searchsorted(starts, at[:-1]) + asked
    found = starts[np.minimum(place, max(len(starts) - 1, 0))] if len(starts) else np.zeros(len(chunk), np.int64)
    return pa.array(found - at[:-1] - lead, pa.int64(), mask=rank.is_null().to_numpy(zero_copy_only=False))


def _chunk(raw: Column, k: Column, size: int) -> Column:
    """Chunk ``k`` with the byte before it."""
    return F.when(k == 0, F.substring(raw, F.lit(1), F.lit(size))).otherwise(F.substring(raw, k * size, F.lit(size + 1)))


def _lead(k: Column) -> Column:
    return (k > 0).cast("int")


def _at_most(most: Column) -> Callable[[Column], Column]:
    return lambda x: x <= most


def _counts_of_long(rows: DataFrame, size: int) -> DataFrame:
    """``id, t, counts``: the units of each chunk, in order, for texts of several chunks."""
    chunks = rows.select("id", "t", "raw", F.explode(F.sequence(F.lit(0), ((F.octet_length("raw") - 1) / size).cast("int"))).alias("k"))
    dealt = chunks.select("id", "t", "k", _chunk(F.col("raw"), F.col("k"), size).alias("chunk")).repartition("id", "t", "k")
    counted = dealt.select("id", "t", F.struct("k", _counted("chunk", _lead(F.col("k"))).alias("n")).alias("c"))
    return counted.groupBy("id", "t").agg(F.transform(F.array_sort(F.collect_set("c")), lambda c: c["n"]).alias("counts"))


def fill_in_middle(
    docs: DataFrame, a: Column, b: Column, plain: Column, spm: Column, id_: str = "doc_id", text: str = "text", size: int = CHUNK
) -> DataFrame:
    """``docs`` with ``n`` long (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    The prefix ends after the smaller of ``a % (n + 1)`` and ``b % (n + 1)`` units, the middle after the
    larger. ``plain`` and ``spm`` are conditions on the row: rows with ``plain``, without text or with a mark in
    it keep their text (form ``plain``, null lengths); of the rest ``spm`` puts the suffix first, else ``psm``.

    A null text is empty. Rows that repeat give the same output each. An empty table gives an empty one.
    Columns of ``docs`` with the names of the results are replaced. A text of any length is counted in chunks of
    ``size`` bytes in as many tasks; one row holds its counts.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_).alias("id"), F.xxhash64(text).alias("t"), raw.alias("raw"), a.alias("a"), b.alias("b"), plain.alias("plain"), spm.alias("spm"))
    one = rows.where(F.octet_length("raw") <= size).withColumn("counts", F.array(_counted("raw", F.lit(0))))
    more = rows.where(F.octet_length("raw") > size)
    counts = _counts_of_long(more, size).select(F.col("id").alias("c_id"), F.col("t").alias("c_t"), "counts")
    more = more.join(counts, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("t") == F.col("c_t"))).select(*rows.columns, "counts")
    return _cut(one.unionByName(more), docs.columns, text, size)


def _cut(rows: DataFrame, columns: list[str], text: str, size: int) -> DataFrame:
    zero = F.lit(0).cast("long")
    sums = F.aggregate("counts", F.array(zero), lambda s, c: F.concat(s, F.array(F.element_at(s, -1) + c)))
    rows = rows.withColumn("sums", sums).withColumn("n", F.element_at("sums", -1))
    ranks = [f(F.pmod("a", F.col("n") + 1), F.pmod("b", F.col("n") + 1)) for f in (F.least, F.greatest)]
    for i, rank in enumerate(ranks):  # the owner is the last chunk before whose end the unit begins; the end of the text has none
        rows = rows.withColumn(f"rank{i}", rank)
        until = F.filter(F.slice("sums", 2, F.size("counts")), _at_most(F.col(f"rank{i}")))
        rows = rows.withColumn(f"k{i}", F.when(F.col(f"rank{i}") < F.col("n"), F.size(until)))
    for i in range(2):
        k = F.coalesce(f"k{i}", F.lit(0))
        within = F.when(F.col(f"k{i}").isNotNull(), F.col(f"rank{i}") - F.get("sums", k))
        chunk = F.when(F.col(f"k{i}").isNotNull(), _chunk(F.col("raw"), k, size))
        at = _located(chunk, _lead(k), within) + k.cast("long") * size
        rows = rows.withColumn(f"at{i}", F.coalesce(at, F.octet_length("raw").cast("long")).cast("int"))
    part = lambda begin, end: F.substring("raw", begin + 1, end - begin).cast("string")
    end = F.octet_length("raw")
    rows = rows.withColumns({"prefix": part(F.lit(0), F.col("at0")), "middle": part(F.col("at0"), F.col("at1")), "suffix": part(F.col("at1"), end), "whole": F.col("raw").cast("string")})
    marked = F.lit(False)
    for mark in MARKS.values():
        marked = marked | F.contains("whole", F.lit(mark))
    form = F.when((end == 0) | marked | F.col("plain"), "plain").when(F.col("spm"), "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    joined = lambda *names: F.concat(*[x for name in names for x in (F.lit(MARKS[name]), F.col(name))])
    output = F.when(F.col("form") == "plain", F.col("whole")).when(F.col("form") == "spm", joined("suffix", "prefix", "middle")).otherwise(joined("prefix", "suffix", "middle"))
    cut = F.col("form") != "plain"
    new = {
        "n": F.col("n"),
        "form": F.col("form"),
        "prefix_chars": F.when(cut, F.char_length("prefix").cast("long")),
        "middle_chars": F.when(cut, F.char_length("middle").cast("long")),
        "output": output,
    }
    return rows.select(*[F.col(f"row.`{c}`") for c in columns if c not in new], *[c.alias(name) for name, c in new.items()])


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    parts = F.split(output, "|".join(MARKS.values()))
    order = lambda *at: F.concat(*[F.get(parts, F.lit(i)) for i in at])
    return F.when(form == "plain", output).when(form == "spm", order(2, 3, 1)).otherwise(order(1, 3, 2))


def hash_groups(id_: Column, n: int = 4) -> list[Column]:
    """The first ``n`` groups of eight digits of the SHA-256 of ``1:`` and the id, as unsigned numbers."""
    digits = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]

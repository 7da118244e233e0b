"""Line dedup: levelled sorted runs of line hashes, as tables bucketed and sorted by the hash.

A line's key is the line stripped and lower-cased; its hash is two 64-bit numbers. A batch of keys is
merge-joined against the runs: what no run holds is new (the anti-join's half) and this batch holds it,
of the rest only the count of documents is added. The batch then becomes a run of level 0 itself, and
whenever a level has ``FANOUT`` runs they are compacted into one of the next level. Batches and runs share
one number of buckets, so these joins move no run.

The corpus is dealt into batches by falling ids, so the document that holds a key is the one with the
largest id. Only hashes, ids and places of lines are written and shuffled until the places to drop meet
their documents again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.runtime import deleted, dropped, shared_dir, shuffle_partitions, written

#: Runs of a level that are compacted into one of the next.
FANOUT = 2
#: Batches that a whole table is dealt into. Reading the runs again costs each batch, so the number is fixed.
BATCHES = 4

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["h", "g"]


def ascii_lowered(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lowered(F.btrim(line, F.lit(_SPACE)))


class LineRuns:
    """Runs of ``h, g, n, holder``: a key's hash, how many documents of a batch have it, and the holder.

    Of all rows of a key in all runs exactly one names the holder: that of the first batch that had the key.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.buckets = spark, fanout, shuffle_partitions(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def add(self, keys: DataFrame) -> None:
        """Merge a batch ``h, g, n, holder`` (one row a key) with the runs, then add it as a run."""
        seen = F.lit(False)
        for i, name in enumerate(x for level in self.levels for x in level):
            run = self.spark.table(name).select(*_KEY, F.lit(True).alias(f"in{i}"))
            keys = keys.join(run, _KEY, "left")
            seen = seen | F.coalesce(f"in{i}", F.lit(False))
        self._put(0, keys.select(*_KEY, F.col("n").cast("long").alias("n"), F.when(~seen, F.col("holder")).alias("holder")))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged(names))
            self._drop(names)
            level += 1

    def merged(self) -> DataFrame:
        """One row a key over all runs."""
        return self._merged([x for level in self.levels for x in level])

    def drop(self) -> None:
        self._drop([x for level in self.levels for x in level])
        self.levels = []

    def _merged(self, names: list[str]) -> DataFrame:
        # by path: a union of bucketed tables passes for bucketed (Spark 4.1), but does not bring their buckets together
        rows = self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*[self.paths[name] for name in names])
        return rows.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.max("holder").alias("holder"))

    def _put(self, level: int, rows: DataFrame) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = f"{shared_dir(self.spark)}/{name}"
        rows.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", self.paths[name]).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            deleted(self.spark, self.paths.pop(name))


def _lines(docs: DataFrame, id_: str, text: str, least_chars: int) -> DataFrame:
    """``id, t, pos, h, g`` of the lines that are long enough; ``t`` tells rows that share an id apart."""
    lines = docs.select(F.col(id_).alias("id"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keys = lines.select("id", "t", (F.col("pos") + 1).alias("pos"), line_key(F.col("line")).alias("key"))
    long = keys.where(F.char_length("key") >= least_chars)
    return long.select("id", "t", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def deduplicated_lines(
    docs: DataFrame, least_docs: int = 3, least_chars: int = 20, id_: str = "doc_id", text: str = "text", batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, and ``n_lines`` (before), ``n_dropped``, both long.

    A line goes if its key has ``least_chars`` code points or more, is found in ``least_docs`` documents or
    more and this document's id (a number) isn't the largest that has it. Its other lines stay in order,
    joined by a line feed. A repeated line stays as often as its holder has it.

    A null or empty text is one empty line and becomes "". Rows that share an id are one document in counts
    and hold keys together. A row without an id counts for nothing and holds no line. An empty table gives an
    empty one. Columns of ``docs`` named ``n_lines`` or ``n_dropped`` are replaced. A very long text is
    handled as many lines; its places meet in one row again, as the text itself does.
    """
    spark = docs.sparkSession
    share = [1 - (i + 1) / batches for i in range(batches - 1)]
    bounds = docs.select(F.percentile_approx(id_, share) if share else F.lit(None)).first()[0] or []
    batch = F.lit(0)
    for bound in bounds:
        batch = batch + F.when(F.col("id") <= bound, 1).otherwise(0)
    lines = written(_lines(docs, id_, text, least_chars).withColumn("batch", batch), "lines", by="batch")

    runs = LineRuns(spark, fanout)
    for i in range(len(bounds) + 1):
        one_each = lines.where((F.col("batch") == i) & F.col("id").isNotNull()).select("id", *_KEY).distinct()
        runs.add(one_each.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("holder")))

    # written first, so that both sides of the join are plain exchanges, whose hot keys Spark splits
    repeated = written(runs.merged().where(F.col("n") >= least_docs).select(*_KEY, "holder"), "repeated")
    runs.drop()
    out = lines.join(repeated, _KEY).where(~F.col("id").eqNullSafe(F.col("holder")))
    places = written(out.groupBy("id", "t").agg(F.sort_array(F.collect_set("pos")).alias("places")), "places")
    dropped(lines, repeated)

    rows = docs.select(F.struct("*").alias("row"), F.col(id_).alias("own_id"), F.xxhash64(text).alias("own_t"), F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("lines"))
    met = rows.join(places, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_t") == F.col("t")), "left")
    size = F.size("lines")
    met = met.select("row", "lines", F.concat(F.array(F.lit(0)), F.coalesce("places", F.array().cast("array<int>")), F.array(size + 1)).alias("cuts"))
    between = lambda i: F.slice("lines", F.get("cuts", i - 1) + 1, F.get("cuts", i) - F.get("cuts", i - 1) - 1)
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), between)), "\n")
    own = [kept.alias(text) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return met.select(*own, size.cast("long").alias("n_lines"), (F.size("cuts") - 2).cast("long").alias("n_dropped"))

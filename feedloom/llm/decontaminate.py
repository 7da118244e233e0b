"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``width`` consecutive words of a benchmark item (all words of a shorter item), seen as
the set of its ``SHINGLE``-word runs. Every run must occur for the window to occur, so the
necessary prefix is one run: the rarest by its count over all documents. Documents look up their
runs among these prefixes only. A hit fixes where the window would begin (positional bound) and
whether it fits the document (length bound); the words of the window are then compared one by one.
Words are compared by 64-bit hashes.

Benchmark items are taken in blocks of about ``BLOCK_BYTES`` of text, so what is broadcast is
bounded whatever the size of the benchmark; each block scans the documents, and no document moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.wordhash import ALNUM, Words, runs, text_chunks

SHINGLE = 4
BLOCK_BYTES = 4_000_000


class Windows:
    """The windows of one block of items, and the runs they are found by."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.ids = [i for i, _ in items]
        hashes, begin, size, item = [], [], [], []
        done = row = 0
        for _, end, data, offsets in text_chunks(pa.array([t for _, t in items], pa.string())):
            words = Words(data, offsets, ALNUM)
            hashes.append(words.hash)
            for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
                starts = np.arange(a, max(b - width, a) + 1) if b > a else np.zeros(0, np.int64)
                begin.append(starts + done)
                size.append(np.full(len(starts), min(width, b - a)))
                item.append(np.full(len(starts), row))
                row += 1
            done += len(words.hash)
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.begin, self.size, self.item = cat(begin), cat(size), cat(item)
        self.runs = {int(min(SHINGLE, n)): None for n in np.unique(self.size)}
        for n in self.runs:
            own = self.begin[np.minimum(self.size, SHINGLE) == n]
            sizes = self.size[np.minimum(self.size, SHINGLE) == n]
            places = np.unique(np.concatenate([own + j for j in range(int(sizes.max()) - n + 1)]))
            places = places[places + n <= len(self.hash)]
            self.runs[n] = np.unique(runs(self.hash, n)[places])

    def rarest(self, counts: dict[int, np.ndarray]) -> dict[int, Prefixes]:
        """For each run length, the windows found by it, keyed by their rarest run."""
        out = {}
        for n, known in self.runs.items():
            at = runs(self.hash, n)
            own = np.flatnonzero(np.minimum(self.size, SHINGLE) == n)
            best = np.full(len(own), np.iinfo(np.int64).max)
            offset = np.zeros(len(own), np.int64)
            for j in range(int(self.size[own].max()) - n + 1):
                fits = np.flatnonzero(self.size[own] >= n + j)
                seen = counts[n][np.searchsorted(known, at[self.begin[own[fits]] + j])]
                less = seen < best[fits]
                best[fits[less]], offset[fits[less]] = seen[less], j
            live = best > 0
            own, offset = own[live], offset[live]
            out[n] = Prefixes(at[self.begin[own] + offset], own, offset)
        return out


class Prefixes:
    """Windows by the hash of one run: those of ``key[i]`` are ``window[first[i]:first[i+1]]``."""

    def __init__(self, hashes: np.ndarray, window: np.ndarray, offset: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.window, self.offset = window[order], offset[order]
        self.key, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(hashes))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.key >> np.uint64(44)] = True

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``at``, entry) for each window whose run is there."""
        place = np.flatnonzero(self.bits[at >> np.uint64(44)])
        if not len(place) or not len(self.key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(self.key, at[place]), len(self.key) - 1)
        same = self.key[i] == at[place]
        place, i = place[same], i[same]
        n = self.first[i + 1] - self.first[i]
        entry = np.repeat(self.first[i] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(place, n), entry.astype(np.int64)


def _counted(shared):
    """(run length, index, count) of the block's runs over the texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        bits = {}
        for n, keys in known.items():
            bits[n] = np.zeros(1 << 20, bool)
            bits[n][keys >> np.uint64(44)] = True
        total = {n: np.zeros(len(keys), np.int64) for n, keys in known.items()}
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text"), 1 << 19):
                words = Words(data, offsets, ALNUM)
                for n, keys in known.items():
                    at = runs(words.hash, n)
                    place = np.flatnonzero(bits[n][at >> np.uint64(44)])
                    text = np.searchsorted(words.bounds, place, "right")
                    place = place[place + n <= words.bounds[text]]
                    i = np.minimum(np.searchsorted(keys, at[place]), len(keys) - 1)
                    total[n] += np.bincount(i[keys[i] == at[place]], minlength=len(keys))
        for n, count in total.items():
            i = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), n, np.int32)), pa.array(i.astype(np.int32)), pa.array(count[i])],
                names=["run", "i", "n"],
            )

    return run


def _merge(spans: np.ndarray) -> np.ndarray:
    """The union of ``(begin, end)`` rows as sorted rows that neither overlap nor touch."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.ones(len(spans), bool)
    head[1:] = spans[1:, 0] > reach[:-1]
    last = np.append(np.flatnonzero(head)[1:] - 1, len(spans) - 1)
    return np.stack([spans[head, 0], reach[last]], axis=1)


def _found(shared, drop_text: bool):
    """Add the block's hits to the columns n_words, n_hit, items and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, prefixes = shared.value
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            n_hit = batch.column("n_hit").to_numpy().copy()
            spans = batch.column("spans").to_pylist()
            items = batch.column("items").to_pylist()
            for first, _, data, offsets in text_chunks(batch.column("text"), 1 << 19):
                words = Words(data, offsets, ALNUM)
                n_words[first : first + len(offsets) - 1] = np.diff(words.bounds)
                hits = []
                for n, prefix in prefixes.items():
                    place, entry = prefix.places(runs(words.hash, n))
                    window = prefix.window[entry]
                    begin = place - prefix.offset[entry]
                    text = np.searchsorted(words.bounds, place, "right") - 1
                    ok = (begin >= words.bounds[text]) & (begin + windows.size[window] <= words.bounds[text + 1])
                    window, begin, text = window[ok], begin[ok], text[ok]
                    for j in range(int(windows.size[window].max(initial=0))):
                        i = np.minimum(j, windows.size[window] - 1)
                        ok = words.hash[begin + i] == windows.hash[windows.begin[window] + i]
                        window, begin, text = window[ok], begin[ok], text[ok]
                    hits.append(np.stack([text, begin, windows.size[window], windows.item[window]], axis=1))
                hits = np.concatenate(hits) if hits else np.zeros((0, 4), np.int64)
                hits = hits[np.argsort(hits[:, 0], kind="stable")]
                for part in np.split(hits, np.flatnonzero(np.diff(hits[:, 0])) + 1) if len(hits) else []:
                    text = int(part[0, 0])
                    row = first + text
                    begin = part[:, 1] - words.bounds[text]
                    old = np.frombuffer(spans[row], np.int64).reshape(-1, 2)
                    new = _merge(np.concatenate([old, np.stack([begin, begin + part[:, 2]], axis=1)]))
                    spans[row], n_hit[row] = new.tobytes(), (new[:, 1] - new[:, 0]).sum()
                    new = {windows.ids[i] for i in np.unique(part[:, 3])} - {None}
                    items[row] = sorted(new.union(items[row]))
            columns = {f.name: batch.column(f.name) for f in batch.schema}
            columns |= {
                "n_words": pa.array(n_words),
                "n_hit": pa.array(n_hit),
                "items": pa.array(items, pa.list_(pa.string())),
                "spans": pa.array(spans, pa.binary()),
            }
            if drop_text:
                columns.pop("text")
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans`` of every document.

    ``n_hit``: words inside occurrences of windows; ``spans``: their merged ranges, packed as
    64-bit pairs of first word and end word; ``items``: ids, as sorted strings, of the items with
    a window there. Null, empty and wordless texts have no words and no hits; items like that have
    no windows. An item whose id is null hits but is not listed; items that share an id are listed
    once. Repeated documents are judged row by row. Empty tables give no hits or no rows.
    """
    return _hits(docs.select("doc_id", "text"), benchmark, width, keep_text=False)


def _hits(docs: DataFrame, benchmark: DataFrame, width: int, keep_text: bool) -> DataFrame:
    """The columns of ``docs``, of which ``text`` may go, and ``n_words, n_hit, items, spans``."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    found = docs.select(
        "*",
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<string>").alias("items"),
        F.lit(b"").alias("spans"),
    )
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        windows = Windows([tuple(r) for r in block.collect()], width)
        counts = {n: np.zeros(len(keys), np.int64) for n, keys in windows.runs.items()}
        if counts:
            known = spark.sparkContext.broadcast(windows.runs)
            seen = docs.select("text").mapInArrow(_counted(known), "run int, i int, n long").groupBy("run", "i")
            for r in seen.agg(F.sum("n").alias("n")).collect():
                counts[r.run][r.i] = r.n
        drop_text = b == blocks - 1 and not keep_text
        schema = found.drop("text").schema if drop_text else found.schema
        found = found.mapInArrow(_found(spark.sparkContext.broadcast((windows, windows.rarest(counts))), drop_text), schema)
    return found


def contaminated(n_hit, n_words):
    """The rule: a document is contaminated when a twentieth or more of its words are hit."""
    return (n_hit > 0) & (F.lit(20) * n_hit >= n_words)


def clean_of_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    Each row is judged by its own text, also rows without an id and those that share one.
    """
    names = {c: c if c == "text" else f"own_{i}" for i, c in enumerate(docs.columns)}  # no clash with the counts
    hits = _hits(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), benchmark, width, keep_text=True)
    kept = hits.where(~contaminated(F.col("n_hit"), F.col("n_words")))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])

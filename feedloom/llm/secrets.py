"""Secret scans: fixed patterns, and two Markov models that tell random strings from identifiers.

The patterns find ``assign``, ``access`` and ``hex`` spans. Beyond them, every run of
``RUN``-like characters that no pattern span touches is compared under two character Markov models
of order one: one learnt from the values that the patterns found (labelled random), one from other
runs (labelled ordinary). A run whose log-likelihood ratio for each character is over a threshold
is a span of kind ``markov``. The threshold is fitted on the samples that the models have not
seen: no more than ``FALSE_RATE`` of the ordinary runs may pass, and where the random ones lie
higher it is halfway to their lowest twentieth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.runtime import dropped, written

# Fixed values of the pattern scan.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 20
HEX = r"[0-9a-f]+"
HEX_LEAST = 24
KINDS = ("assign", "access", "hex", "markov")

RUN = r"[A-Za-z0-9+/_-]{20,}"
#: The models are learnt from at most this many labelled runs of each kind, by smallest hash.
SAMPLE_RUNS = 20_000
FALSE_RATE = 0.005

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4))
_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
_RUN = re.compile(RUN)
_NAMES = ("passw", "secret", "token", "api")
_CODE = np.full(128, 63, np.int64)
for _i, _c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"):
    _CODE[_c] = _i

Span = tuple[int, int, int]


def pattern_spans(text: str) -> list[Span]:
    """``(begin, end, kind)`` of the patterns, by begin and then kind; places of code points."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _other_runs(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Runs that no span touches."""
    out, i, reach = [], 0, 0
    for m in _RUN.finditer(text):
        while i < len(spans) and spans[i][0] < m.end():
            reach = max(reach, spans[i][1])
            i += 1
        if reach <= m.start():
            out.append(m.span())
    return out


def _pairs(runs: list[str]) -> np.ndarray:
    """Counts of character pairs over all runs; a long run weighs as 64 pairs."""
    codes = [_CODE[np.frombuffer(r.encode(), np.uint8)] for r in runs]
    weight = np.concatenate([np.full(len(c) - 1, min(1.0, 64 / len(c))) for c in codes])
    return np.bincount(np.concatenate([c[:-1] * 64 + c[1:] for c in codes]), weight, minlength=4096)


@dataclass
class Model:
    """``ratio[a * 64 + b]``: log of how much likelier b follows a in random strings."""

    ratio: np.ndarray
    threshold: float

    def score(self, run: str) -> float:
        code = _CODE[np.frombuffer(run.encode(), np.uint8)]
        return float(self.ratio[code[:-1] * 64 + code[1:]].mean())


def _ratio(random: list[str], ordinary: list[str]) -> Model:
    chance = []
    for runs in (random, ordinary):
        count = _pairs(runs).reshape(64, 64)
        start = (count.sum(axis=0) + 1) / (count.sum() + 64)
        chance.append((count + 16 * start) / (count.sum(axis=1, keepdims=True) + 16))
    return Model(np.log(chance[0] / chance[1]).ravel(), 0.0)


def fit(random: list[str], ordinary: list[str]) -> Model:
    """Learn from half of each sample, set the threshold on the other half.

    The ordinary sample is not free of secrets: runs that score over a quarter of the way from its
    median to the random one under a first model are taken out. With a sample missing, no run is
    a secret.
    """
    if len(random) < 4 or len(ordinary) < 4:
        return Model(np.zeros(4096), np.inf)
    first = _ratio(random, ordinary)
    high, low = (np.median([first.score(r) for r in runs]) for runs in (random, ordinary))
    ordinary = [r for r in ordinary if first.score(r) <= low + (high - low) / 4]
    model = _ratio(random[::2], ordinary[::2])
    other, own = (sorted(map(model.score, runs[1::2])) for runs in (ordinary, random))
    if not other:
        return Model(np.zeros(4096), np.inf)
    model.threshold = other[min(len(other) - 1, int(len(other) * (1 - FALSE_RATE)))]
    model.threshold = max(model.threshold, (model.threshold + own[len(own) // 20]) / 2)
    return model


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(random, run): values of pattern spans, and other runs."""
    for batch in batches:
        label, runs = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            spans = pattern_spans(text)
            for begin, end, kind in spans:
                value = _ASSIGN.match(text, begin, end)[2] if kind == 0 else text[begin:end]
                if len(value) >= 12:
                    label.append(True)
                    runs.append(value)
            for begin, end in _other_runs(text, spans):
                label.append(False)
                runs.append(text[begin:end])
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.bool_()), pa.array(runs, pa.string())], names=["random", "run"])


def _found(shared):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                spans = pattern_spans(text)
                more = [(b, e, 3) for b, e in _other_runs(text, spans) if model.score(text[b:e]) > model.threshold]
                if more:
                    spans = sorted(spans + more, key=lambda s: (s[0], s[2]))
                out.append([{"kind": KINDS[k], "begin": b, "end": e} for b, e, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return run


def train(docs: DataFrame) -> Model:
    """Learn from a bounded sample of the distinct runs in ``docs``."""
    runs = written(docs.select("text").mapInArrow(_sampled, "random boolean, run string").distinct(), "runs")
    order = [F.xxhash64("run"), "run"]
    sample = [[r.run for r in runs.where(F.col("random") == label).orderBy(*order).limit(SAMPLE_RUNS).collect()] for label in (True, False)]
    dropped(runs)
    return fit(*sample)


def secrets(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, spans`` of every row: array of ``(kind, begin, end)`` by begin, then kind.

    Places count code points; the end is exclusive. Null and empty texts have no spans. Repeated
    rows are scanned each; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, spans array<struct<kind: string, begin: long, end: long>>"
    return rows.mapInArrow(_found(docs.sparkSession.sparkContext.broadcast(model)), schema)

"""Toxicity by maximum-scoring segments of token log-odds.

*Tokens* are runs of letters, lower-cased. *Log-odds* of a token compare toxic with other training
documents, with a Dirichlet prior in proportion to its frequency in both. A token is counted by
its distinct neighbourhoods (the words before and after it), so copies of a text and repeated
lines count once. Tokens whose log-odds exceed ``MIN_Z`` standard errors make the model; every
other token scores a fixed loss, which makes the expected score negative.

*Segments.* One linear pass finds all maximal scoring segments of a document, each a candidate
toxic passage. Their scores follow an extreme-value law: a text of ``n`` tokens has
``E = K n exp(-lambda S)`` segments of score ``S`` or more by chance, with lambda from the score
distribution of clean text and K from the segments found there. Segments with ``E < 1`` are
significant passages. A document's evidence is the sum of ``-log(1 - exp(-E))`` over its segments,
which is next to nothing for chance ones, and the largest of these; a logistic curve over both, fitted on training documents that the log-odds were not
learnt from, gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.wordhash import Words, mix, text_chunks

#: The classifier is fitted on at most this many labelled rows, those of smallest hashed id.
SAMPLE_ROWS = 20_000
MIN_Z = 3.0
#: ... and at least these log-odds: a passage is made of words that are rare in clean text.
MIN_ODDS = 1.5
#: A token needs this many neighbourhoods in toxic documents.
MIN_SEEN = 5
#: The prior's weight, as a share of all that was counted.
PRIOR = 0.1
LOSS = 0.25

LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


@dataclass
class Model:
    """Log-odds by token hash, the law of chance segments, and the curve of the score."""

    token: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: float = 1.0
    k: float = 1.0
    curve: tuple[float, float, float] = (-50.0, 0.0, 0.0)

    def __post_init__(self):
        self.bits = np.zeros(1 << 16, bool)
        self.bits[self.token >> np.uint64(48)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the model's tokens and their log-odds."""
        at = np.flatnonzero(self.bits[hashes >> np.uint64(48)])
        if not len(at) or not len(self.token):
            return np.zeros(0, np.int64), np.zeros(0)
        i = np.minimum(np.searchsorted(self.token, hashes[at]), len(self.token) - 1)
        same = self.token[i] == hashes[at]
        return at[same], self.odds[i[same]]

    def surprise(self, score: float, n: int) -> float:
        """``-log P`` of a segment of this score or more by chance in ``n`` tokens."""
        log = math.log(self.k * n) - self.rate * score
        return -math.log(-math.expm1(-math.exp(min(log, 6.0)))) if log > -30 else -log

    def significant(self, score: float, n: int) -> bool:
        return self.k * n * math.exp(-self.rate * score) < 1

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
        each = [self.surprise(s, n) for _, _, s in segments]
        return sum(each), max(each, default=0.0)

    def score(self, total: float, largest: float) -> float:
        a, b, c = self.curve
        x = a + b * math.log1p(total) + c * math.log1p(largest)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def segments(places: np.ndarray, odds: np.ndarray, loss: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(begin, end, score)``: ``odds`` at ``places``, else ``-loss``.

    The stack holds the candidates with the running totals before and after each; a new one joins
    the nearest candidate that starts lower, unless that one ends at least as high.
    """
    stack: list[tuple[int, int, float, float]] = []
    total, last = 0.0, 0
    for at, gain in zip(places.tolist(), odds.tolist(), strict=True):
        low = total - loss * (at - last)
        total, last = low + gain, at + 1
        if gain <= 0:
            continue
        begin = at
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= total:
                break
            begin, low = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((begin, at + 1, low, total))
    return [(b, e, high - low) for b, e, low, high in stack]


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, near, toxic): a token with a hash of its neighbours, once a batch."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        found = []
        for first, _, data, offsets in text_chunks(batch.column("text"), 1 << 19):
            words = Words(data, offsets, LETTERS)
            n = np.diff(words.bounds)
            text = np.repeat(np.arange(len(n)), n)
            before, after = np.zeros(len(text), np.uint64), np.zeros(len(text), np.uint64)
            same = text[1:] == text[:-1]
            before[1:][same], after[:-1][same] = words.hash[:-1][same], words.hash[1:][same]
            near = mix(before + mix(after))
            found.append(np.stack([words.hash, near, toxic[first + text].astype(np.uint64)], axis=1))
        if found:
            rows = np.concatenate(found)
            order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
            rows = rows[order]
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
            rows = rows[fresh].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i].copy()) for i in range(3)], names=["token", "near", "toxic"])


def _segmented(shared):
    """(h, toxic, n, scores): the scores of a training document's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            sizes, scores = [], []
            for _, _, data, offsets in text_chunks(batch.column("text"), 1 << 19):
                words = Words(data, offsets, LETTERS)
                places, odds = model.hits(words.hash)
                cut = np.searchsorted(places, words.bounds)
                for i in range(len(offsets) - 1):
                    own = slice(cut[i], cut[i + 1])
                    sizes.append(int(words.bounds[i + 1] - words.bounds[i]))
                    scores.append([s for _, _, s in segments(places[own], odds[own], LOSS)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("toxic"), pa.array(sizes, pa.int64()), pa.array(scores, pa.list_(pa.float64()))],
                names=["h", "toxic", "n", "scores"],
            )

    return run


def _scored(model: Model, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
    """Score and significant passages of each text."""
    score = np.full(len(texts), model.score(0.0, 0.0))
    passages: list[list[dict]] = [[] for _ in range(len(texts))]
    for first, _, data, offsets in text_chunks(texts, 1 << 19):
        words = Words(data, offsets, LETTERS)
        places, odds = model.hits(words.hash)
        cut = np.searchsorted(places, words.bounds)
        for i in np.flatnonzero(np.diff(cut)):
            own = slice(cut[i], cut[i + 1])
            n = int(words.bounds[i + 1] - words.bounds[i])
            found = segments(places[own] - words.bounds[i], odds[own], LOSS)
            score[first + i] = model.score(*model.evidence(found, n))
            passages[first + i] = [{"begin": b, "end": e, "score": s} for b, e, s in found if model.significant(s, n)]
    return score, passages


def _judged(shared):
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, passages = _scored(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(passages, kind)], names=["doc_id", "score", "passages"])

    return run


def _below(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, _ = _scored(shared.value, batch.column("text"))
            yield batch.filter(pa.array(score < threshold))

    return run


def _rate(odds: np.ndarray, share: np.ndarray) -> float:
    """The positive lambda with ``sum p exp(lambda s) = 1`` for scores of clean text."""
    rest = 1 - share.sum()
    if rest * -LOSS + (share * odds).sum() >= 0:
        return 1.0
    low, high = 0.0, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        with np.errstate(over="ignore"):
            value = rest * math.exp(-LOSS * mid) + (share * np.exp(mid * odds)).sum()
        low, high = (mid, high) if value < 1 else (low, mid)
    return low


def _curve(total: np.ndarray, largest: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """A ridge logistic regression on the logs of both kinds of evidence."""
    x = np.stack([np.ones(len(total)), np.log1p(total), np.log1p(largest)], axis=1)
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(3) * 1e-2
        step = np.linalg.solve(hessian, x.T @ (toxic - p) - 1e-2 * w)
        w += np.clip(step, -3, 3)
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on ``labels(doc_id, toxic)``; a document with several labels is toxic if one says so.

    Rows without an id or a label are left out. If a class is missing nothing is toxic: score 0. Of
    the documents that share a label's id all count for the log-odds, and one for the curve. All
    tokens of the sample that pass the thresholds make the model.
    """
    spark = docs.sparkSession
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select(F.xxhash64("doc_id").alias("h"), "text", F.col("toxic").cast("long"))
    learn, fit = rows.where("h % 5 <> 0").drop("h"), rows.where("h % 5 = 0")

    seen = learn.mapInArrow(_seen, "token long, near long, toxic long").distinct().groupBy("token")
    seen = seen.agg(F.sum("toxic").alias("y"), F.sum(1 - F.col("toxic")).alias("x"))
    n = seen.agg(F.sum("y").alias("y"), F.sum("x").alias("x")).first()
    if not n.y or not n.x:
        return Model()
    prior, weight = PRIOR * (F.col("y") + F.col("x")), PRIOR * (n.y + n.x)
    odds = lambda c, size: F.log((F.col(c) + prior) / (size + weight - F.col(c) - prior))
    gain = odds("y", n.y) - odds("x", n.x)
    z = gain / F.sqrt(1 / (F.col("y") + prior) + 1 / (F.col("x") + prior))
    kept = seen.where(F.col("y") >= MIN_SEEN).select("token", "x", gain.alias("odds"), z.alias("z")).where((F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_ODDS))
    kept = sorted(kept.collect(), key=lambda r: r.token % 2**64)
    weights = np.array([r.odds for r in kept])
    share = np.array([(r.x + 0.5) / (n.x + 1) for r in kept])
    model = Model(np.array([r.token % 2**64 for r in kept], np.uint64), weights, _rate(weights, share))

    found = fit.mapInArrow(_segmented(spark.sparkContext.broadcast(model)), "h long, toxic long, n long, scores array<double>")
    # one row a label, however many documents share its id
    found = [r.one for r in found.groupBy("h").agg(F.min(F.struct("toxic", "n", "scores")).alias("one")).collect()]
    clean = [r for r in found if not r.toxic]
    chance = [s for r in clean for s in r.scores]
    if not clean or len(clean) == len(found):
        return Model()
    size = sum(r.n for r in clean) or 1
    middle = float(np.median(chance)) if chance else 0.0
    model.k = (1 + sum(s >= middle for s in chance)) * math.exp(model.rate * middle) / size
    both = np.array([model.evidence([(0, 0, s) for s in r.scores], r.n) for r in found])
    model.curve = _curve(both[:, 0], both[:, 1], np.array([r.toxic for r in found], float))
    return model


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, passages`` of every row.

    ``passages``: the significant segments as ``(begin, end, score)``, places of tokens, end
    exclusive. Null, empty and wordless texts have the score of a text without evidence. Repeated
    rows are judged each; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, score double, passages array<struct<begin: long, end: long, score: double>>"
    return rows.mapInArrow(_judged(docs.sparkSession.sparkContext.broadcast(model)), schema)


def held_out(doc_id):
    """Whether a row's label is kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def not_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns.

    Each row is judged by its own text, also rows without an id and those that share one.
    """
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return docs.mapInArrow(_below(docs.sparkSession.sparkContext.broadcast(model), threshold), docs.schema)

"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

Everything that touches the table is a native expression. The trees are fitted in the driver on a
bounded sample of labelled URLs (those that a rule judges, unless labels are given) and compiled
to ``CASE`` expressions, so the verdict is one projection over the scan, without a shuffle.

Suffix statistics are the smoothed share of blocked URLs for each last label of the host, over the
sample; they are joined as a broadcast table, which the sample bounds.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The trees are fitted on at most this many labelled URLs, those of smallest hash.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 30, 3, 32, 0.3, 1.0

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does.

    ``rules``: (verdict, ``host/path``). A rule fits its host and all subdomains if the path starts
    with the rule's path. Of two equal rules the first wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + rest))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _count(s: Column, mark: str) -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, mark, ""))


def features(url: Column) -> dict[str, Column]:
    """Lexical features by name; a null URL is empty."""
    u = F.coalesce(url, F.lit(""))
    host, path = host_of(u), path_of(u)
    size = F.greatest(F.length(u), F.lit(1))
    marks = F.filter(F.array_distinct(F.split(host, "(?!^)")), lambda c: c != "")
    share = lambda c: (F.length(host) - F.length(F.replace(host, c, F.lit("")))) / F.length(host)
    entropy = F.aggregate(marks, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return {
        "length": F.length(u),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": _count(path, "[/]"),
        "labels": _count(host, "[.]"),
        "digit_ratio": _count(u, "[0-9]") / size,
        "hyphens": _count(host, "[-]"),
        "parameters": _count(u, "[=]"),
        "escapes": _count(u, "[%]"),
        "fragment": F.contains(u, F.lit("#")).cast("int"),
        "secure": F.startswith(u, F.lit("https:")).cast("int"),
        "entropy": F.when(host == "", 0.0).otherwise(entropy),
    }


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


@dataclass
class Trees:
    """``start`` plus the leaves of all trees is the log-odds of a block."""

    start: float = -10.0
    trees: list = field(default_factory=list)
    suffix: dict[str, float] = field(default_factory=dict)
    base: float = 0.0

    def log_odds(self, columns: dict[str, Column]) -> Column:
        def tree(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, cut, low, high = node
            return F.when(columns[name] <= cut, tree(low)).otherwise(tree(high))

        total = F.lit(self.start)
        for t in self.trees:
            total = total + tree(t)
        return total

    def rates(self, spark: SparkSession) -> DataFrame:
        """``suffix, rate`` of the sample's suffixes, no more than ``SAMPLE_ROWS``."""
        known = json.dumps([{"suffix": s, "rate": r} for s, r in sorted(self.suffix.items())])
        return spark.range(1).select(F.inline(F.from_json(F.lit(known), "array<struct<suffix: string, rate: double>>")))


def boosted(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[float, list]:
    """Gradient boosting of the logistic loss: (start, trees); histogram splits, ties to the first."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    total = np.full(len(y), start)
    trees = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        value = lambda gs, hs: gs * gs / (hs + RIDGE)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        for j in range(x.shape[1] if depth else 0):
            left_g = np.cumsum(np.bincount(binned[rows, j], g[rows], BINS))[: len(cuts[j])]
            left_h = np.cumsum(np.bincount(binned[rows, j], h[rows], BINS))[: len(cuts[j])]
            gain = value(left_g, left_h) + value(gs - left_g, hs - left_h) - value(gs, hs)
            gain[(left_h < 1) | (hs - left_h < 1)] = 0
            if len(gain) and gain.max() > best[0] + 1e-9:
                best = (gain.max(), j, int(gain.argmax()))
        if best[1] is None:
            leaf = float(-RATE * gs / (hs + RIDGE))
            total[rows] += leaf
            return leaf
        _, j, cut = best
        low = binned[rows, j] <= cut
        return names[j], float(cuts[j][cut]), grow(rows[low], g, h, depth - 1), grow(rows[~low], g, h, depth - 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), DEPTH))
    return start, trees


def train(labelled: DataFrame) -> Trees:
    """Fit on ``labelled(url, blocked)``; rows with a null are left out.

    With one class only, or no row, everything is that class (none: allowed).
    """
    url = F.col("url")
    own = labelled.where("url is not null and blocked is not null").select("url", F.col("blocked").cast("int").alias("blocked"))
    sample = own.orderBy(F.xxhash64("url"), "url", "blocked").limit(SAMPLE_ROWS)
    columns = features(url)
    rows = sample.select("blocked", suffix_of(host_of(url)).alias("suffix"), *[c.cast("double").alias(n) for n, c in columns.items()]).collect()
    y = np.array([r.blocked for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Trees(start=10.0 if len(y) and y[0] else -10.0)
    base = float(y.mean())
    seen: dict[str, list[float]] = {}
    for r in rows:
        seen.setdefault(r.suffix, []).append(r.blocked)
    rate = {s: (sum(own) + 10 * base) / (len(own) + 10) for s, own in seen.items()}
    names = [*columns, "suffix_rate"]
    x = np.array([[*(r[n] for n in columns), rate.get(r.suffix, base)] for r in rows])
    start, trees = boosted(x, y, names)
    return Trees(start, trees, rate, base)


def judged(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    ``labelled(url, blocked)`` trains the trees; without it, the rules' own verdicts do. A null or
    schemeless URL has an empty host and path and gets the trees' verdict. Repeated rows are judged
    each; an empty table gives an empty result.
    """
    rows = pages.select("page_id", "url")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        labelled = rows.where("ruled is not null").select("url", (F.col("ruled") == "block").alias("blocked"))
    model = train(labelled)
    rows = rows.withColumn("suffix", suffix_of(F.col("host"))).join(F.broadcast(model.rates(pages.sparkSession)), "suffix", "left")
    lexical = features(F.col("url")) | {"suffix_rate": F.coalesce("rate", F.lit(model.base))}
    rows = rows.withColumns({f"x_{n}": c for n, c in lexical.items()})
    own = F.when(model.log_odds({n: F.col(f"x_{n}") for n in lexical}) > 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"))

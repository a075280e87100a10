"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins by quantiles. Training walks the features in a cycle; in each
step one shallow tree over one feature's bins (later over a pair's grid) is fitted to the gradient of the
logistic loss and added, scaled down, to that feature's lookup table. A score is the sum of the tables'
entries for a text's bins: no tree is left when scoring.

Features are computed once for each text, by Spark tasks, and written; the model is fitted on the driver from a
bounded sample of labelled rows (``most``), and all rows are scored from the written features.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from geoloom.llm.common import named
from geoloom.session import settle

FEATURES = ("log_words", "word_bytes", "symbols", "shouts", "bars", "capitals", "digits", "stops", "other_marks", "different_words",
            "same_as_before", "same_lines", "line_words", "longest_word", "bare_words")
SYMBOLS, CAPITALS, DIGITS, MARKS = b"#*$%&<>@^~", bytes(range(65, 91)), b"0123456789", b"\"'()-/:;=?[]_`{}+\\"


def features_of(text: bytes) -> list[float]:
    """Ratios that do not depend on the language or length of a text, and its length."""
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    lines = [line for line in text.split(b"\n") if line.strip()]
    count = lambda chars: len(text) - len(text.translate(None, chars))
    letters = sum(map(len, words))
    marks = count(b".,")
    return [float(np.log1p(len(words))), letters / n, count(SYMBOLS) / n, text.count(b"!") / n, text.count(b"|") / n, count(CAPITALS) / size,
            count(DIGITS) / size, marks / n, count(MARKS) / n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
            1 - len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1), max(map(len, words), default=0), float(np.log1p(n / (marks + 1)))]


@F.arrow_udf(ArrayType(FloatType()))
def features(texts: pa.Array) -> pa.Array:
    rows = [features_of(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
    return pa.array(rows, pa.list_(pa.float32()))


@dataclass
class Gam:
    """Bin edges of each feature, the lookup tables, and the intercept."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]
    start: float

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.start)
        for table, b in zip(self.tables, at):
            total += table[b]
        for (f, g), grid in zip(self.pairs, self.grids):
            total += grid[at[f], at[g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g, h, pull):
    return g / (h + pull)


def _gain(g, h, pull):
    return g * g / (h + pull)


def _step(g: np.ndarray, h: np.ndarray, pull: float) -> np.ndarray:
    """A tree of up to four leaves over ordered bins: the best cut, then the best cut of each side."""
    out = np.full(g.size, _leaf(g.sum(), h.sum(), pull))

    def cut(x, y):
        if y - x < 2:
            return None
        cg, ch = np.cumsum(g[x:y]), np.cumsum(h[x:y])
        gains = _gain(cg[:-1], ch[:-1], pull) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1], pull) - _gain(cg[-1], ch[-1], pull)
        best = int(gains.argmax())
        return x + best + 1 if gains[best] > 1e-9 else None

    middle = cut(0, g.size)
    if middle is None:
        return out
    for x, y in ((0, middle), (middle, g.size)):
        inner = cut(x, y)
        for a, b in ((x, y),) if inner is None else ((x, inner), (inner, y)):
            out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), pull)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, pull: float) -> tuple[np.ndarray, float]:
    """The best cut of a grid into four parts, one cut along each side: (values, gain)."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    def corners(c):
        a = c[:-1, :-1]
        b = c[:-1, -1:] - a
        d = c[-1:, :-1] - a
        return a, b, d, c[-1, -1] - a - b - d
    gs, hs = corners(cg), corners(ch)
    gains = sum(_gain(x, y, pull) for x, y in zip(gs, hs)) - _gain(cg[-1, -1], ch[-1, -1], pull)
    if not gains.size:
        return np.zeros(g.shape), 0.0
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    low, left = np.arange(g.shape[0])[:, None] <= i, np.arange(g.shape[1])[None, :] <= j
    values = [_leaf(x[i, j], y[i, j], pull) for x, y in zip(gs, hs)]
    return np.where(low, np.where(left, values[0], values[1]), np.where(left, values[2], values[3])), float(gains[i, j])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.1, n_bins: int = 32,
        pull: float = 5.0) -> Gam:
    """Cyclic boosting. One class alone, or no rows, gives a model without shape: the smoothed share of ones."""
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    quantiles = np.linspace(0, 1, n_bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, f], quantiles)) if len(x) else np.empty(0) for f in range(x.shape[1])]
    model = Gam(edges, [np.zeros(e.size + 1) for e in edges], [], [], start)
    if not 0 < y.sum() < len(y):
        return model
    at, total = model.bins(x), np.full(len(y), start)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _step(np.bincount(at[f], g, table.size), np.bincount(at[f], h, table.size), pull)
            table += step
            total += step[at[f]]
    # Pairs by what one cut into four gains on what the single tables leave.
    g, h = slopes()
    gains = []
    for a in range(x.shape[1]):
        for b in range(a):
            shape = (model.tables[a].size, model.tables[b].size)
            flat = at[a] * shape[1] + at[b]
            grid = lambda v: np.bincount(flat, v, shape[0] * shape[1]).reshape(shape)  # noqa: E731, B023
            gains.append((_quadrants(grid(g), grid(h), pull)[1], a, b))
    model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:n_pairs]]
    model.grids = [np.zeros((model.tables[a].size, model.tables[b].size)) for a, b in model.pairs]
    flats = [at[a] * grid.shape[1] + at[b] for (a, b), grid in zip(model.pairs, model.grids)]
    for _ in range(pair_rounds):
        for grid, flat in zip(model.grids, flats):
            g, h = slopes()
            step = rate * _quadrants(np.bincount(flat, g, grid.size).reshape(grid.shape), np.bincount(flat, h, grid.size).reshape(grid.shape), pull)[0]
            grid += step
            total += step.ravel()[flat]
    return model


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; rows of fold 0 are held out."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(5))


def sampled(docs: DataFrame, labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """The rows of ``docs`` whose key is one of about ``most`` labelled keys outside fold 0, with y: the share of ones among the key's labels.

    Keys are chosen by a hash. Rows without a key, a label or a match are not used.
    """
    told = labels.select(named(key).alias("key"), named(label).cast("int").alias("y")).where("key IS NOT NULL AND y IN (0, 1)").where(fold(F.col("key")) != 0)
    told = told.groupBy("key").agg(F.avg("y").alias("y"))
    n = told.count()
    share = min(1.0, most / n) if n else 1.0
    some = told.where(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.join(some.hint("broadcast"), "key")  # about ``most`` rows


def train(rows: DataFrame) -> Gam:
    """Fit on rows of (key, y, features), of which each key gives one to the driver: that with the smallest features."""
    sample = rows.groupBy("key").agg(F.min("y").alias("y"), F.min("features").alias("features")).toPandas()
    x = np.array(sample["features"].tolist(), np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, sample["y"].to_numpy(float)))  # the same rows give the same sums
    return fit(x[order], sample["y"].to_numpy(float)[order])


def scorer(model: Gam):
    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(FEATURES))
        return pa.array(model.score(x), pa.float64())

    return score


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 30_000,
           cut: float = 0.3) -> DataFrame:
    """One row per document: key, held_out, score (0 to 1), predicted (1 if score >= cut).

    Null texts count as empty and get a score like any other; very long ones are read whole; a null key is not held out; repeated rows stay, and the
    rows of a repeated key train as one; other columns are not read; without labels every score is 0.5; an empty table gives no rows.
    """
    rows = settle(docs.select(named(key).alias("key"), features(named(text)).alias("features")))
    model = train(sampled(rows, labels, key, label, most))
    out = rows.select("key", F.coalesce(fold(F.col("key")) == 0, F.lit(False)).alias("held_out"), scorer(model)("features").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 30_000,
              cut: float = 0.3) -> DataFrame:
    """The documents whose score reaches ``cut``, with all their columns."""
    told = sampled(docs.select(named(key).alias("key"), named(text).alias("text")), labels, key, label, most)
    model = train(told.select("key", "y", features("text").alias("features")))
    return docs.where(scorer(model)(features(named(text))) >= cut)

"""Quality classifier: a Bradley-Terry model of preference pairs, cut at a quantile of its scores.

``features`` describes every whole text by ratios that hold no language, source or id. ``learn`` draws pairs of a good
and a bad training document, fits worths by the logistic loss on differences of their features, and looks for the
quantile of the training scores at which labels are told apart best. ``judge`` scores all rows: the worth, shifted so
that the chosen quantile becomes 0.5. Training sees a bounded sample of labelled rows (``SAMPLE``) and of pairs
(``PAIRS``); scores cover all rows.

Defined cases: a null text counts as empty, and an empty text gets the score of its (zero) features; very long texts are
measured whole; an empty table gives an empty result; without labels of both kinds every score is 0.5; rows without id
are scored and not held out; repeated rows and copies get equal scores; of contradicting labels of one id the lower
counts; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from casetrail.llm.common import batches, plain, text_of
from casetrail.llm.quality import measure

#: Labelled documents that the model learns from, at most; chosen by a hash of their id.
SAMPLE = 20_000
#: Preference pairs drawn from them.
PAIRS = 100_000
#: Knots of every feature: quantiles of the training rows.
KNOTS = 8
#: Weight of the squared worths in the loss of one pair.
RIDGE = 1e-4
PUNCTUATION = list(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""")
NAMES = [
    "words", "word_length", "symbols", "dup_lines", "repeated", "upper", "digits", "words_per_line", "distinct", "commonest", "longest_run", "punctuation", "line_ends",
]


def features(text: str) -> list[float]:
    """NAMES of one text."""
    n_words, chars, symbols, dups, repeated, lines, upper, digits = measure(text)
    raw = text.encode()
    words = raw.split()
    n, c = max(n_words, 1), max(chars, 1)
    counts = Counter(words)
    run = longest = 0
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 0
        longest = max(longest, run)
    marks = int(np.bincount(np.frombuffer(raw, np.uint8), minlength=256)[PUNCTUATION].sum())
    ends = sum(line.rstrip()[-1:] in (".", "!", "?") for line in text.split("\n"))
    return [
        float(np.log1p(n_words)),
        chars / n,
        symbols / n,
        dups / max(lines, 1),
        repeated / n,
        upper / c,
        digits / c,
        float(np.log1p(n_words / max(lines, 1))),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        longest / n,
        marks / c,
        ends / max(lines, 1),
    ]


def described(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the features of every row."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in batch.column("text").to_pylist()], float).reshape(-1, len(NAMES))
        cells = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), cells], names=["doc_id", "x"])

    return batches(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), make, "doc_id long, x array<double>")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels the model must not see."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """Features (``x``) and label (``good``) of at most ``sample`` labelled documents, none held out, on the driver."""
    chosen = (
        plain(labels, "doc_id", "quality")
        .dropna()
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    known = plain(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    rows = described(known).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "x").limit(sample).toPandas()
    return rows.assign(good=(rows.pop("quality") == 1))


# ---- learning -----------------------------------------------------------------------------------


@dataclass
class Model:
    knots: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    worths: np.ndarray
    cut: float = 0.0
    slope: float = 1.0

    def basis(self, x: np.ndarray) -> np.ndarray:
        """Every feature as ramps between its knots, so that both low and high values can count against a text."""
        low, high = self.knots[:-1], self.knots[1:]
        step = np.where(high > low, high - low, 1.0)
        ramps = np.clip((x[:, None, :] - low) / step, 0.0, 1.0) * (high > low)
        return (ramps.reshape(len(x), -1) - self.centre) / self.scale

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.worths

    def score(self, x: np.ndarray) -> np.ndarray:
        """Strictly rising in the worth, 0.5 at the cut."""
        z = self.slope * (self.raw(x) - self.cut)
        return 0.5 + 0.5 * z / (1.0 + np.abs(z))


def _fitted(d: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Worths that minimise the mean of log(1 + exp(-d w)) and the ridge, by Newton steps."""
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -30, 30)))  # how wrong the model is about a pair
        slope = -(d * p[:, None]).mean(0) + RIDGE * w
        bend = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _best_quantile(scores: np.ndarray, good: np.ndarray) -> float:
    """The score quantile that separates the labels best (mean of both hit rates); of equals, nearest to the share of bad ones."""
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    bad_below = np.concatenate([[0], np.cumsum(~g)])
    good_below = np.concatenate([[0], np.cumsum(g)])
    worth = bad_below / max((~g).sum(), 1) + (g.sum() - good_below) / max(g.sum(), 1)
    possible = np.flatnonzero(np.concatenate([[True], s[1:] > s[:-1], [True]]))
    best = possible[worth[possible] >= worth[possible].max() - 1e-12]
    k = int(best[np.argmin(np.abs(best / len(s) - (~g).mean()))])
    if k == 0:
        return float(s[0])
    if k == len(s):
        return float(np.nextafter(s[-1], np.inf))
    return float((s[k - 1] + s[k]) / 2)


def learn(rows: pd.DataFrame, pairs: int = PAIRS, seed: int = 11) -> Model:
    good = rows["good"].to_numpy(bool)
    width = len(NAMES)
    if not good.any() or good.all():
        flat = np.zeros((2, width))
        return Model(flat, np.zeros(width), np.ones(width), np.zeros(width))
    x = np.array(rows["x"].tolist(), float)
    levels = np.linspace(0, 1, KNOTS)
    # knots of both kinds of documents: rare values of the bad ones get knots of their own
    knots = np.sort(np.concatenate([np.quantile(x[good], levels, axis=0), np.quantile(x[~good], levels, axis=0)]), axis=0)
    count = (len(knots) - 1) * width
    model = Model(knots, np.zeros(count), np.ones(count), np.zeros(count))
    b = model.basis(x)
    spread = b.std(0)
    model.centre, model.scale = b.mean(0), np.where(spread > 1e-9, spread, 1.0)
    b = model.basis(x)
    draw = np.random.default_rng(seed)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    n = int(min(pairs, 4 * len(better) * len(worse)))
    d = b[draw.choice(better, n)] - b[draw.choice(worse, n)]
    model.worths = _fitted(d)
    raw = model.raw(x)
    model.cut = _best_quantile(raw, good)
    model.slope = 1.0 / max(float(np.abs(raw - model.cut).mean()), 1e-9)
    return model


# ---- applying -----------------------------------------------------------------------------------


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in batch.column("text").to_pylist()], float).reshape(-1, len(NAMES))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = batches(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), make, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return judge(docs, learn(training_rows(docs, labels, sample)))

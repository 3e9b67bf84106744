"""Quality rules: decision lists learned from labelled documents, run as Spark conditional expressions.

``text_statistics`` measures every whole text. ``learn_rules`` grows and prunes conjunctions of thresholds on labelled
statistics by sequential covering; ``verdict`` turns the list into one ordered CASE. Training sees a bounded sample of
labelled rows (``SAMPLE``); statistics and verdict cover all rows.

Defined cases: a null text counts as no words; an empty table gives an empty result; without labels the list is empty
and only the base rule decides; repeated rows are judged one by one; further columns are ignored.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from casetrail.llm.common import batches, plain, text_of, unused

#: Labelled documents that the rules are learned from, at most; chosen by a hash of their id.
SAMPLE = 20_000
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + MORE)

#: Ratios that the rules may test: numerator and denominator.
RATIOS = {
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
}


def _repeated(words: list[bytes]) -> int:
    """Words inside windows that occur twice or more."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    if len(words) <= WINDOW:
        return 0
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            h = (h ^ (ids[k : len(h) + k] + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    _, back, n = np.unique(h, return_inverse=True, return_counts=True)
    hit = n[back] > 1
    if not hit.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    edges[at] += 1
    edges[at + WINDOW] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str) -> list[int]:
    """COUNTS and MORE of one text."""
    raw = text.encode()
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return [
        len(words),
        len(text) - int(n[list(BLANKS.encode())].sum()),
        int(n[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
        int(n[ord("A") : ord("Z") + 1].sum()),
        int(n[ord("0") : ord("9") + 1].sum()),
    ]


def text_statistics(docs: DataFrame) -> DataFrame:
    """One row of counts per document."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(t) for t in batch.column("text").to_pylist()]
        cols = list(zip(*rows, strict=True)) or [[] for _ in COUNTS + MORE]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", *COUNTS, *MORE]
        )

    return batches(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), make, SCHEMA)


def base_failed(at: str = "") -> Column:
    words, repeated = F.col(f"{at}n_words"), F.col(f"{at}n_repeat_words")
    return (words < 20) | (100 * repeated > 30 * words)


def labelled_statistics(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """Statistics and label (1: bad) of at most ``sample`` labelled documents, on the driver."""
    chosen = (
        plain(labels, "doc_id", "quality")
        .dropna()
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    known = plain(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    stats = text_statistics(known).join(F.broadcast(chosen), "doc_id")
    rows = stats.orderBy("doc_id", *COUNTS).limit(sample).toPandas()
    return rows.assign(bad=(rows.pop("quality") == 0).astype(int))


# ---- learning -----------------------------------------------------------------------------------


def ratios(stats: pd.DataFrame) -> pd.DataFrame:
    out = {n: stats[a] / stats[b].clip(lower=1) for n, (a, b) in RATIOS.items()}
    return pd.DataFrame({"n_words": stats["n_words"].astype(float), **out})


def _covers(x: np.ndarray, rule: list[tuple[int, bool, float]]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, above, cut in rule:
        hit &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return hit


def _best_condition(x: np.ndarray, bad: np.ndarray) -> tuple[float, tuple[int, bool, float] | None]:
    """The threshold with the largest gain in information about bad rows (FOIL)."""
    total, best = bad.sum(), (0.0, None)
    before = np.log2(max(total, 1e-9) / len(bad))
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, b = x[order, f], np.cumsum(bad[order])
        ends = np.flatnonzero(v[1:] > v[:-1])
        if not len(ends):
            continue
        cuts = (v[ends] + v[ends + 1]) / 2
        for above, p, n in ((False, b[ends], ends + 1), (True, total - b[ends], len(v) - ends - 1)):
            gain = p * (np.log2(np.maximum(p, 1e-9) / n) - before)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), (f, above, float(cuts[k])))
    return best


def _worth(x: np.ndarray, bad: np.ndarray, rule: list) -> float:
    hit = _covers(x, rule)
    p, n = bad[hit].sum(), (1 - bad[hit]).sum()
    return (p - n) / max(p + n, 1)


def learn_rules(
    stats: pd.DataFrame, precision: float = 0.9, least: int = 10, longest: int = 4, seed: int = 7
) -> list[list[tuple[str, bool, float]]]:
    """Ordered rules for rejection, each a conjunction of (ratio, above?, threshold).

    A rule is grown on two thirds of the rows still uncovered, its tail is pruned on the other third, and it joins
    the list only if it is right on at least ``precision`` of what it covers in both parts. Rows that fail the base
    rule never reach the list, so they are left out.
    """
    stats = stats[(stats["n_words"] >= 20) & (100 * stats["n_repeat_words"] <= 30 * stats["n_words"])]
    x, bad = ratios(stats), stats["bad"].to_numpy()
    names, x = list(x.columns), x.to_numpy()
    grow = np.random.default_rng(seed).random(len(x)) < 2 / 3
    left, rules = np.ones(len(x), bool), []
    while bad[left].sum() >= least:
        gx, gb = x[left & grow], bad[left & grow]
        px, pb = x[left & ~grow], bad[left & ~grow]
        rule: list[tuple[int, bool, float]] = []
        while len(rule) < longest and 0 < gb.sum() < len(gb):
            _, cond = _best_condition(gx, gb)
            if cond is None:
                break
            rule.append(cond)
            hit = _covers(gx, [cond])
            gx, gb = gx[hit], gb[hit]
        if not rule:
            break
        if len(pb):
            rule = max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (_worth(px, pb, r), -len(r)))
        hit = left & _covers(x, rule)
        right = [bad[hit & part].mean() if (hit & part).sum() >= least / 3 else 0.0 for part in (grow, ~grow)]
        if hit.sum() < least or min(right) < precision:
            break
        rules.append([(names[f], above, cut) for f, above, cut in rule])
        left &= ~hit
    return rules


# ---- applying -----------------------------------------------------------------------------------


def _ratio(name: str, at: str) -> Column:
    if name not in RATIOS:
        return F.col(at + name).cast("double")
    a, b = RATIOS[name]
    return F.col(at + a) / F.greatest(F.col(at + b), F.lit(1))


def verdict(rules: list[list[tuple[str, bool, float]]], at: str = "") -> Column:
    """True: keep. The first rule that holds rejects. ``at``: where the counts lie, as in ``"stats."``."""
    case = F.when(base_failed(at), F.lit(False))
    for rule in rules:
        tests = [_ratio(n, at) > F.lit(cut) if above else _ratio(n, at) <= F.lit(cut) for n, above, cut in rule]
        case = case.when(functools.reduce(operator.and_, tests), F.lit(False))
    return case.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[list[tuple[str, bool, float]]]) -> DataFrame:
    """Counts, base verdict and verdict per document."""
    return text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules))


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return judge(docs, learn_rules(labelled_statistics(docs, labels, sample)))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    rules = learn_rules(labelled_statistics(docs, labels, sample))
    text, stats = unused(docs, "_text"), unused(docs, "_stats")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(t) for t in batch.column(text).to_pylist()]
        cols = list(zip(*rows, strict=True)) or [[] for _ in COUNTS + MORE]
        counts = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=COUNTS + MORE)
        return batch.drop_columns([text]).append_column(stats, counts)

    struct = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS + MORE])
    seen = batches(docs.withColumn(text, text_of()), make, T.StructType([*docs.schema.fields, T.StructField(stats, struct)]))
    return seen.filter(verdict(rules, f"{stats}.")).drop(stats)

"""Severity of toxic text by cumulative-link ordinal regression.

``P(grade > k) = sigmoid(w.x - t_k)`` with one weight vector for all ordered thresholds
``t_1 < t_2 < t_3``; the expected severity is the sum of these probabilities. Features are
the presence of hashed words and word beginnings; only those that the labelled sample ties
to toxic text beyond chance (likelihood ratio) are kept, so that length does no harm.

Labels only say toxic or not. The grades 1 to 3 of toxic rows are thirds of the share of
their features that speak for toxicity; clean rows have grade 0.

The model is fitted on at most ``per_class`` labelled rows of each class. Null and empty
texts have no features and so the lowest severity. If one class is missing, all have
severity 0. Extra columns are carried along; clashing ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import by_batch
from opsight.llm.labelled import class_counts, sample
from opsight.llm.linear import sigmoid
from opsight.llm.words import SLICE, mixed, spans

BITS = 22
GRADES = 3
PREFIXES = (3, 4, 5, 6)
#: From this probability of a grade above 0 on a document is called toxic. It lies below a
#: half since one telling word in a long text is enough for the label.
TOXIC_FROM = 0.25
_letters = np.zeros(256, bool)
_letters[ord("a") : ord("z") + 1] = True
_letters[128:] = True
_BETWEEN = ~_letters
#: A number for each place in a word and byte; places behind the last begin again, mixed
#: with how often that has happened.
_codes = np.random.default_rng(20240301).integers(0, 2**64, (24, 256), dtype=np.uint64)


def _pieces(text: str | None):
    """The lower-cased text in bytes, cut where a letter run ends."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    start = 0
    while start < len(data):
        end = min(start + SLICE, len(data))
        while end < len(data) and _letters[data[end]]:
            end += 1
        yield data[start:end]
        start = end


def features(text: str | None) -> np.ndarray:
    """Distinct hashed words and word beginnings of a whole text."""
    found = []
    for data in _pieces(text):
        starts, ends = spans(data, _BETWEEN)
        if not len(starts):
            continue
        length = ends - starts
        sums = np.zeros(len(starts), np.uint64)
        for at in range(int(length.max())):
            inside = np.flatnonzero(length > at)
            turn, place = divmod(at, len(_codes))
            if turn and not place:
                sums[inside] = mixed(sums[inside] + np.uint64(turn))
            sums[inside] += _codes[place][data[starts[inside] + at]]
            if at + 1 in PREFIXES:
                longer = sums[length > at + 1]
                found.append(np.unique(longer >> np.uint64(64 - BITS)))
        found.append(np.unique((sums * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)))
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


@dataclass
class OrdinalModel:
    kept: np.ndarray  # ids of the features, ascending
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, found: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` for k = 0, 1, 2."""
        if not len(self.kept):
            return np.zeros(GRADES)
        at = np.minimum(np.searchsorted(self.kept, found), len(self.kept) - 1)
        return sigmoid(self.weights[at[self.kept[at] == found]].sum() - self.thresholds)


def _telling(rows, toxic: np.ndarray, least: int, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Features tied to either class beyond chance, and their log odds for toxic text."""
    width = 1 << BITS
    a = np.bincount(np.concatenate([r for r, t in zip(rows, toxic, strict=True) if t] or [np.zeros(0, int)]), minlength=width)
    b = np.bincount(np.concatenate([r for r, t in zip(rows, toxic, strict=True) if not t] or [np.zeros(0, int)]), minlength=width)
    ids = np.flatnonzero(a + b >= least)
    a, b, n, m = a[ids].astype(float), b[ids].astype(float), toxic.sum(), (~toxic).sum()
    share = (a + b) / (n + m)
    gain = sum(
        x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12))
        for x, e in ((a, n * share), (b, m * share), (n - a, n * (1 - share)), (m - b, m * (1 - share)))
    )
    odds = np.log((a + 0.5) / (n - a + 0.5)) - np.log((b + 0.5) / (m - b + 0.5))
    keep = 2 * gain >= strength
    return ids[keep], odds[keep]


def fit(
    rows: list[np.ndarray],
    toxic: np.ndarray,
    counts: dict[int, int],
    least: int = 5,
    strength: float = 25.0,
    penalty: float = 2e-4,
    steps: int = 400,
) -> OrdinalModel:
    """Fit weights and thresholds by gradient descent with adaptive steps."""
    if toxic.all() or not toxic.any():
        return OrdinalModel(np.zeros(0, int), np.zeros(0), np.full(GRADES, 40.0))
    kept, odds = _telling(rows, toxic, least, strength)
    if not len(kept):
        return OrdinalModel(np.zeros(0, int), np.zeros(0), np.full(GRADES, 40.0))
    inside = [np.flatnonzero(np.isin(kept, r, assume_unique=True)) for r in rows]
    evidence = np.array([(odds[i] > 1.0).sum() / max(len(r), 1) for i, r in zip(inside, rows, strict=True)])
    cuts = np.quantile(evidence[toxic], np.arange(1, GRADES) / GRADES)
    grade = np.where(toxic, 1 + np.searchsorted(cuts, evidence, side="left"), 0)

    flat = np.concatenate(inside)
    owner = np.repeat(np.arange(len(rows)), [len(i) for i in inside])
    stands_for = np.where(toxic, counts[1] / toxic.sum(), counts[0] / (~toxic).sum())
    stands_for = stands_for / stands_for.sum()
    above = (grade[:, None] > np.arange(GRADES)).astype(float)
    # Thresholds are a first one and positive gaps, which keeps them in order.
    values = np.concatenate([np.zeros(len(kept)), [2.0], np.zeros(GRADES - 1)])
    first, second = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, steps + 1):
        weights, gaps = values[: len(kept)], np.exp(values[len(kept) + 1 :])
        thresholds = values[len(kept)] + np.concatenate([[0.0], np.cumsum(gaps)])
        sums = np.bincount(owner, weights[flat], minlength=len(rows))
        error = (sigmoid(sums[:, None] - thresholds) - above) * stands_for[:, None]
        slope = np.bincount(flat, error.sum(1)[owner], minlength=len(kept)) + penalty * weights
        by_threshold = -error.sum(0)
        tail = np.cumsum(by_threshold[::-1])[::-1]
        gradient = np.concatenate([slope, [tail[0]], tail[1:] * gaps])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        values = values - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    gaps = np.exp(values[len(kept) + 1 :])
    return OrdinalModel(kept, values[: len(kept)], values[len(kept)] + np.concatenate([[0.0], np.cumsum(gaps)]))


def train(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = 2500) -> OrdinalModel:
    """Fit on the rows of ``labels`` (doc_id, toxic) that are ``learnable``."""
    rows, marks = sample(docs, labels, learnable, "toxic", per_class, features)
    return fit(rows, marks == 1, class_counts(labels, learnable, "toxic"))


def severity(docs: DataFrame, model: OrdinalModel, text_column: str = "text") -> DataFrame:
    """Add ``toxic_probability``, ``grade`` (0 to 3) and ``expected_severity`` to all rows."""
    added = ("toxic_probability", "grade", "expected_severity")
    kept = [c for c in docs.columns if c not in added]
    docs = docs.select(*kept)

    def graded(batch: pa.RecordBatch) -> dict[str, list]:
        out = {c: batch.column(c) for c in kept} | {c: [] for c in added}
        for text in batch.column(text_column).to_pylist():
            above = model.probabilities(features(text))
            out["toxic_probability"].append(float(above[0]))
            out["grade"].append(int((above >= 0.5).sum()))
            out["expected_severity"].append(float(above.sum()))
        return out

    zeros = dict(zip(added, (F.lit(0.0), F.lit(0), F.lit(0.0)), strict=True))
    return by_batch(docs, graded, docs.withColumns(zeros).schema)

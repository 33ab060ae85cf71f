"""Quality scores by naive Bayes support vectors.

N-gram indicators are scaled by the log-count ratio of the two classes, rows are brought to
unit length, and a hinge-loss machine is fitted to them by dual coordinate descent. N-grams
are hashed byte trigrams and runs of one or two word shapes (case, length, last character,
whether the word repeats the one before); for shapes there is one indicator for each share
of the words that the run reaches.

The model is fitted on at most ``per_class`` labelled rows of each class; a fifth of them
serves to turn margins into probabilities at the class shares of all labels.

Null and empty texts are scored like a text without n-grams. If one class is missing, all
scores are the share of label 1 (0.5 without labels). Labels other than 0 and 1 and null
ids are not learned from. Extra columns are carried along; clashing ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import by_batch
from opsight.llm.labelled import class_counts, sample
from opsight.llm.linear import dual_coordinate_descent, logistic_scale, margins, sigmoid
from opsight.llm.words import SLICE, as_bytes, spans, word_hashes

BITS = 17
WIDTH = 1 << BITS
SHARES = np.array([0.01, 0.05, 0.2, 0.5])
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_kind = np.zeros(256, np.uint8)
_kind[ord("a") : ord("z") + 1] = 1
_kind[ord("A") : ord("Z") + 1] = 2
_kind[ord("0") : ord("9") + 1] = 3
_kind[128:] = 1


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - BITS)).astype(np.int64)


def shapes(data: np.ndarray) -> np.ndarray:
    """One number for each word: case, length class, last character, repetition."""
    starts, ends = spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    kinds = _kind[data]
    lower = np.add.reduceat(kinds == 1, starts, dtype=np.int64)
    upper = np.add.reduceat(kinds == 2, starts, dtype=np.int64)
    digit = np.add.reduceat(kinds == 3, starts, dtype=np.int64)
    length = ends - starts
    other = length - lower - upper - digit
    last = data[ends - 1].astype(np.int64)
    last[kinds[ends - 1] != 0] = 0
    words = word_hashes(data)
    repeats = np.zeros(len(words), np.int64)
    repeats[1:] = words[1:] == words[:-1]
    case = np.minimum(lower, 1) + 2 * np.minimum(upper, 2) + 6 * np.minimum(digit, 1)
    size = np.minimum(np.log2(length).astype(np.int64), 5)
    code = (((case * 6 + size) * 3 + np.minimum(other, 2)) * 2 + repeats) * 256 + last
    return code.astype(np.uint64)


def indicators(text: str | None) -> np.ndarray:
    """The distinct hashed features of a whole text."""
    data = as_bytes(text)
    present = np.zeros(WIDTH, bool)
    for start in range(0, max(len(data) - 2, 0), SLICE):
        wide = data[start : start + SLICE + 2].astype(np.uint64)
        present[_slot((wide[:-2] << np.uint64(16)) + (wide[1:-1] << np.uint64(8)) + wide[2:])] = True
    single = shapes(data)
    for run, mark in ((single, 1), (single[:-1] * np.uint64(1 << 24) + single[1:], 2)):
        if not len(run):
            continue
        values, counts = np.unique(run, return_counts=True)
        base = values * np.uint64(16) + np.uint64(mark << 60)
        present[_slot(base)] = True
        for level, share in enumerate(SHARES, 1):
            present[_slot(base[counts >= share * len(run)] + np.uint64(level))] = True
    return np.flatnonzero(present)


@dataclass
class QualityModel:
    weights: np.ndarray  # of a row after scaling; the last one is the bias
    ratios: np.ndarray
    slope: float
    offset: float

    def score(self, features: np.ndarray) -> float:
        if not len(self.weights):
            return self.offset
        scaled = self.ratios[features]
        norm = np.sqrt(scaled @ scaled) or 1.0
        margin = self.weights[features] @ scaled / norm + self.weights[-1]
        return float(sigmoid(self.slope * margin + self.offset))


def fit(rows: list[np.ndarray], labels: np.ndarray, counts: dict[int, int], cost: float = 1.0) -> QualityModel:
    total = sum(counts.values())
    if not (labels == 0).any() or not (labels == 1).any():
        return QualityModel(np.zeros(0), np.zeros(0), 0.0, counts.get(1, 0) / total if total else 0.5)
    check = np.arange(len(rows)) % 5 == 4 if min((labels == 0).sum(), (labels == 1).sum()) >= 20 else np.zeros(len(rows), bool)
    use = np.flatnonzero(~check)
    by_class = [
        1.0 + np.bincount(np.concatenate([rows[i] for i in use if labels[i] == c]), minlength=WIDTH)
        for c in (0, 1)
    ]
    ratios = np.log(by_class[1] / by_class[1].sum()) - np.log(by_class[0] / by_class[0].sum())

    def scaled(i: int) -> tuple[np.ndarray, np.ndarray]:
        values = ratios[rows[i]]
        return rows[i], values / (np.sqrt(values @ values) or 1.0)

    signs = np.where(labels == 1, 1.0, -1.0)
    share = np.array([(labels[use] == c).mean() for c in (0, 1)])
    weights = dual_coordinate_descent(
        [scaled(i) for i in use], signs[use], WIDTH, cost * 0.5 / share[labels[use]]
    )
    seen = np.flatnonzero(check) if check.any() else use
    stands_for = np.array([counts.get(c, 0) / max((labels == c).sum(), 1) for c in (0, 1)])
    slope, offset = logistic_scale(
        margins([scaled(i) for i in seen], weights), labels[seen] == 1, stands_for[labels[seen]] / stands_for.mean()
    )
    return QualityModel(weights, ratios, slope, offset)


def train(
    docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = 2500, cost: float = 1.0
) -> QualityModel:
    """Fit on the rows of ``labels`` (doc_id, quality) that are ``learnable``."""
    rows, marks = sample(docs, labels, learnable, "quality", per_class, indicators)
    return fit(rows, marks, class_counts(labels, learnable, "quality"), cost)


def score(docs: DataFrame, model: QualityModel, text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from ``threshold`` on) to all rows."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*kept)

    def scored(batch: pa.RecordBatch) -> dict[str, list]:
        values = [model.score(indicators(text)) for text in batch.column(text_column).to_pylist()]
        return {c: batch.column(c) for c in kept} | {
            "score": values,
            "predicted": [int(value >= threshold) for value in values],
        }

    return by_batch(docs, scored, docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)

"""Language identification in two levels: family first, then pairs within the family.

The family is chosen by linear support vector machines, one against the rest. Inside the
family each pair of languages has its own machine and the languages are ranked by votes,
then by summed probability. Features are relative frequencies of hashed byte n-grams.

The models are fitted on a bounded sample (at most ``per_language`` rows of each language,
those with the least hashes of id and text; equal rows may stand for each other); every
text is predicted whole, a very long one in pieces of bounded size. Languages with equal
votes and probabilities are ordered by name.

Null text and texts without a letter give ``und`` with score 0. Rows with a null id are
predicted but never learned from. An empty table, or one without a learnable row, gives
``und`` for all. Other columns are carried along untouched unless their name clashes with
a result column, which then replaces them.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import by_batch
from opsight.llm.linear import dual_coordinate_descent, logistic_scale, margins, sigmoid
from opsight.llm.words import SLICE

#: Closely related languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
}
UNKNOWN = "und"
WIDTH_BITS = 15
SCALE = 20.0


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), language)


def gram_ids(data: np.ndarray) -> list[np.ndarray]:
    """Hashed byte 1-, 2- and 3-grams of one piece of text."""
    wide = data.astype(np.uint32)
    shift = np.uint32(32 - WIDTH_BITS)
    keys = [wide + np.uint32(0x01000000)]
    if len(wide) > 1:
        keys.append((wide[:-1] << np.uint32(8)) + wide[1:] + np.uint32(0x02000000))
    if len(wide) > 2:
        keys.append(
            (wide[:-2] << np.uint32(16)) + (wide[1:-1] << np.uint32(8)) + wide[2:]
        )
    return [(k * np.uint32(2654435761)) >> shift for k in keys]


def pieces(text: str):
    """The lower-cased text in UTF-8, in pieces that overlap by two bytes."""
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    for start in range(0, max(len(data) - 2, 1), SLICE):
        yield data[start : start + SLICE + 2]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(1 << WIDTH_BITS)
    for piece in pieces(text):
        for ids in gram_ids(piece):
            counts += np.bincount(ids, minlength=len(counts))
    index = np.flatnonzero(counts)
    return index, counts[index] * (SCALE / counts.sum())


@dataclass
class Machine:
    """One linear machine: its classes when positive and negative, weights, calibration."""

    positive: str
    negative: str
    weights: np.ndarray
    slope: float
    offset: float


@dataclass
class LanguageModel:
    families: dict[str, list[str]]
    rest: list[Machine]
    pairs: list[Machine]

    def matrix(self) -> np.ndarray:
        machines = self.rest + self.pairs
        return np.array([m.weights for m in machines]).reshape(len(machines), -1 if machines else (1 << WIDTH_BITS) + 1).T.copy()

    def decide(self, values: np.ndarray) -> tuple[str, float]:
        """Language and score from the margins of all machines."""
        machines = self.rest + self.pairs
        p = {
            (m.positive, m.negative): float(sigmoid(m.slope * v + m.offset))
            for m, v in zip(machines, values, strict=True)
        }
        family_p = {f: p.get((f, ""), 1.0) for f in self.families}
        total = sum(family_p.values()) or 1.0
        family = max(sorted(family_p), key=family_p.get)
        members = self.families[family]
        votes = dict.fromkeys(members, 0)
        sums = dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            for one, share in ((a, p[a, b]), (b, 1 - p[a, b])):
                votes[one] += share > 0.5
                sums[one] += share
        best = max(members, key=lambda m: (votes[m], sums[m]))
        within = 2 * sums[best] / (len(members) * (len(members) - 1)) if len(members) > 2 else (sums[best] or 1.0)
        return best, min(1.0, family_p[family] / total * within)


def _machine(rows, sides, positive, negative, cost) -> Machine:
    labels = np.where(sides, 1.0, -1.0)
    weights = dual_coordinate_descent(rows, labels, 1 << WIDTH_BITS, cost)
    scores = margins(rows, weights)
    slope, offset = logistic_scale(scores, sides)
    return Machine(positive, negative, weights, slope, offset)


def fit(rows, languages: list[str], cost: float = 1.0) -> LanguageModel:
    """Fit the family machines and one machine for each pair within a family."""
    families: dict[str, list[str]] = {}
    for language in sorted(set(languages)):
        families.setdefault(family_of(language), []).append(language)
    names = np.array(languages)
    kin = np.array([family_of(x) for x in languages])
    rest = [
        _machine(rows, kin == f, f, "", cost) for f in sorted(families) if len(families) > 1
    ]
    pairs = []
    for members in families.values():
        for a, b in combinations(members, 2):
            keep = np.flatnonzero((names == a) | (names == b))
            pairs.append(_machine([rows[i] for i in keep], names[keep] == a, a, b, cost))
    return LanguageModel(families, rest, pairs)


def _cut(rows: int, per_language: int) -> int:
    """The largest hash of the rows of a language that are looked at.

    Hashes are spread evenly, so about ``per_language`` rows and three standard deviations
    more lie up to it.
    """
    wanted = per_language + 3 * math.isqrt(per_language) + 3
    return min(2**64 * wanted // max(rows, 1), 2**64 - 1) - 2**63


def training_rows(
    docs: DataFrame, learnable: Column, id_column: str, text_column: str, lang_column: str, per_language: int
) -> DataFrame:
    """The rows of each language with the least hashes of id and text, as sparse frequencies.

    The rows of each language are counted, which gives the hash up to which they are taken.
    So the choice is a filter of the scan: no row is moved or ranked, whatever share of the
    rows a language or an id has.
    """
    identity, lang = F.col(id_column), F.col(lang_column)
    labelled = docs.filter(learnable & lang.isNotNull() & identity.isNotNull())
    cuts = {row[0]: _cut(row[1], per_language) for row in labelled.groupBy(lang).count().collect()}
    hashed = F.xxhash64(identity, F.col(text_column))
    near = [(lang == language) & (hashed <= cut) for language, cut in sorted(cuts.items())]
    chosen = labelled.filter(reduce(operator.or_, near, F.lit(False)))
    texts = chosen.select(identity.alias("id"), hashed.alias("hash"), lang.alias("lang"), F.col(text_column).alias("text"))

    def featured(batch: pa.RecordBatch) -> dict[str, list]:
        out = {"id": [], "hash": [], "lang": [], "index": [], "value": []}
        for *row, text in zip(*(batch.column(c).to_pylist() for c in ("id", "hash", "lang", "text")), strict=True):
            if has_letter(text):
                for key, item in zip(out, (*row, *frequencies(text)), strict=True):
                    out[key].append(item)
        return out

    schema = "id bigint, hash bigint, lang string, index array<int>, value array<double>"
    return by_batch(texts, featured, schema)


def _first_of_each(languages: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """``order`` with the first ``most`` rows of each language."""
    kept = [order[languages[order] == language][:most] for language in np.unique(languages)]
    return np.concatenate(kept)


def train(
    docs: DataFrame,
    learnable: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    per_language: int = 1000,
    cost: float = 1.0,
) -> LanguageModel | None:
    """The model, or None if there is no row to learn from."""
    found = training_rows(docs, learnable, id_column, text_column, lang_column, per_language).toArrow()
    if not found.num_rows:
        return None
    ids, hashes = (found[c].to_numpy() for c in ("id", "hash"))
    languages = np.array(found["lang"].to_pylist())
    order = _first_of_each(languages, np.lexsort((ids, hashes)), per_language)
    order = order[np.argsort(ids[order], kind="stable")]
    index, value = (found[c].combine_chunks() for c in ("index", "value"))
    ends, flat, weight = index.offsets.to_numpy(), index.values.to_numpy(), value.values.to_numpy()
    rows = [(flat[ends[i] : ends[i + 1]], weight[ends[i] : ends[i + 1]]) for i in order]
    return fit(rows, languages[order].tolist(), cost)


def identify(docs: DataFrame, model: LanguageModel | None, text_column: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to all rows."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*kept)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    weights = model.matrix()

    def predicted(batch: pa.RecordBatch) -> dict[str, list]:
        out = {c: batch.column(c) for c in kept}
        names, scores = [], []
        for text in batch.column(text_column).to_pylist():
            if not has_letter(text):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            sums, total = np.zeros(weights.shape[1]), 0
            for piece in pieces(text):
                for ids in gram_ids(piece):
                    sums += weights.take(ids, axis=0).sum(axis=0)
                    total += len(ids)
            name, score = model.decide(sums * (SCALE / total) + weights[-1])
            names.append(name)
            scores.append(score)
        return out | {"lang_pred": names, "score": scores}

    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return by_batch(docs, predicted, schema)

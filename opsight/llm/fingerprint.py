"""Homomorphic multiset fingerprints of documents.

Each paragraph (text between newlines) is hashed to a wide vector and the vectors of a
document are summed, lane by lane, modulo a power of two. So the order of paragraphs does
not matter, and a paragraph is inserted or deleted by adding or subtracting its vector.

A vector has two blocks. ``EXACT`` lanes modulo 2**64 come from an extendable hash of the
whole paragraph and decide equality. ``NEAR`` lanes modulo 2**16, read as signed numbers,
hold a signed count of the paragraph's word pairs, each in one lane picked by its hash; the
cosine of two such blocks estimates how much of the word pairs two documents share. A lane
wraps only if one document repeats a pair more than 32 767 times; that can lower a likeness,
never equality.

Null text is empty text, which is one empty paragraph. Rows are ordered by id and then by
text, so repeated ids have a defined next row; rows with a null id come first. One row is
its own next row, and its edited text the same text. Rows with one id, or without, are one
range: they are read by one task, as a stream, of which two texts are held. Very long texts
are hashed whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import arrow_schema, sliced
from opsight.llm.words import mixed, shingle_hashes, words_at

EXACT, NEAR = 16, 256
SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string,"
    " edited_fingerprint string, near_edited double, near_next double"
)


class Fingerprint:
    """The summed vector of a multiset of paragraphs."""

    def __init__(self, text: str | None = None):
        self.exact = np.zeros(EXACT, np.uint64)
        self.near = np.zeros(NEAR, np.uint16)
        if text is not None:
            self.update(text.split("\n"), 1)

    def update(self, paragraphs: list[str], times: int) -> Fingerprint:
        """Add the paragraphs ``times`` times; negative numbers delete them."""
        if not paragraphs:
            return self
        data = [p.encode("utf-8", "surrogatepass") for p in paragraphs]
        exact = np.frombuffer(b"".join([hashlib.shake_128(d).digest(8 * EXACT) for d in data]), "<u8")
        self.exact += exact.reshape(-1, EXACT).sum(0, dtype=np.uint64) * np.uint64(times % 2**64)
        keys = self._pairs(b"\n".join(data))
        if len(keys):
            signs = 1.0 - 2.0 * ((keys >> np.uint64(32)) & np.uint64(1)).astype(float)
            sums = np.bincount((keys % np.uint64(NEAR)).astype(np.int64), signs, minlength=NEAR)
            self.near += (sums.astype(np.int64) * times).astype(np.uint16)
        return self

    @staticmethod
    def _pairs(data: bytes) -> np.ndarray:
        """Hashes of the word pairs of all paragraphs, and of words that stand alone in one."""
        text = np.frombuffer(data, np.uint8)
        words, starts = words_at(text)
        if not len(words):
            return words
        paragraph = np.searchsorted(np.flatnonzero(text == 10), starts)
        same = paragraph[1:] == paragraph[:-1]
        joined = np.concatenate(([False], same, [False]))
        alone = shingle_hashes(words[~joined[1:] & ~joined[:-1]], 1)
        pairs = shingle_hashes(words, 2)[same] if len(words) > 1 else words[:0]
        return mixed(np.concatenate((pairs, alone)))

    def text(self) -> str:
        """The vector as base64 of its little-endian lanes."""
        return base64.b64encode(self.exact.astype("<u8").tobytes() + self.near.astype("<u2").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        data = base64.b64decode(text)
        out = cls()
        out.exact = np.frombuffer(data[: 8 * EXACT], "<u8").astype(np.uint64)
        out.near = np.frombuffer(data[8 * EXACT :], "<u2").astype(np.uint16)
        return out

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.exact == other.exact).all())

    __hash__ = None

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints, else the cosine of the near lanes, from 0 to 1."""
        if self == other:
            return 1.0
        a, b = self.near.view(np.int16).astype(float), other.near.view(np.int16).astype(float)
        norm = np.sqrt((a @ a) * (b @ b))
        return float(min(max(a @ b / norm, 0.0), 1.0)) if norm else 0.0


def edited(text: str, following: str) -> tuple[str, str, str]:
    """The edited text; with it the paragraphs' part that went and the part that came.

    The last quarter of the code points is replaced by as many of the next text's first.
    """
    cut = len(text) // 4
    keep = text[: len(text) - cut]
    return keep + following[:cut], keep, following[:cut]


def edited_fingerprint(own: Fingerprint, text: str, following: str) -> tuple[Fingerprint, str]:
    """Fingerprint of the edited text: only the paragraphs that change are hashed, unless
    that is more than the whole new text."""
    new, keep, _ = edited(text, following)
    same = keep.rfind("\n") + 1
    if len(text) + len(new) - 2 * same >= len(new):
        return Fingerprint(new), new
    out = Fingerprint()
    out.exact, out.near = own.exact.copy(), own.near.copy()
    out.update(text[same:].split("\n"), -1).update(new[same:].split("\n"), 1)
    return out, new


def in_order(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Deal the rows into ranges of the id; each range also gets the first row behind it.

    The bounds are ids that occur, one for each range, found by an approximate percentile.
    The text is shuffled once. Rows carry ``part`` and ``ahead`` (true for the row that only
    serves as the next one of the range before).
    """
    rank = F.col("doc_id")
    bounds = docs.agg(
        F.percentile_approx(rank, [i / parts for i in range(1, parts)], 100 * parts).alias("at"),
        F.min(rank).alias("least"),
        F.max(rank.isNull()).alias("nulls"),
    ).first()
    cuts = sorted(set(bounds["at"] or []) - {bounds["least"]})
    last = len(cuts)
    part = F.lit(0)
    if cuts:
        # Number of cuts at or below the id: whole blocks of the sorted list first, then the
        # cuts of one block, so an id is compared with few of them.
        width = max(1, int(len(cuts) ** 0.5))
        blocks = [cuts[at : at + width] for at in range(0, len(cuts), width)]
        firsts = F.array(*[F.lit(block[0]) for block in blocks])
        inside = F.array(*[F.array(*[F.lit(c) for c in block]) for block in blocks])
        block = F.size(F.filter(firsts, lambda c: c <= rank))
        within = F.size(F.filter(F.element_at(inside, block), lambda c: c <= rank))
        part = F.when(rank.isNull() | (block == 0), 0).otherwise((block - 1) * width + within)
    first_of_all = rank.isNull() if bounds["nulls"] else rank == bounds["least"]
    before = F.when(first_of_all, last).when(rank.isin(*cuts) if cuts else F.lit(False), F.col("own") - 1)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("own", part)
    copies = F.array(
        F.struct(F.col("own").alias("part"), F.lit(False).alias("ahead")),
        F.struct(before.cast("int").alias("part"), F.lit(True).alias("ahead")),
    )
    dealt = rows.select("doc_id", "text", F.inline(copies)).filter("part is not null")
    return dealt, last + 1


def _pairs_of_rows(schema: pa.Schema):
    """Stream over ranges: each row is finished when the row behind it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, out, room = None, None, [], 0

        def finish(row, following):
            doc, text, own = row
            other = Fingerprint(following)
            changed, new = edited_fingerprint(own, text, following)
            result = (
                doc,
                len(text),
                hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                own.text(),
                changed.text(),
                own.likeness(changed),
                own.likeness(other),
            )
            return result, other

        def packed():
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

        for batch in (piece for whole in batches for piece in sliced(whole)):
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "ahead"))
            for doc, text, here, ahead in zip(*columns, strict=True):
                if here != part:
                    part, waiting = here, None
                own = None
                if waiting is not None:
                    result, own = finish(waiting, text)
                    out.append(result)
                waiting = None if ahead else (doc, text, own or Fingerprint(text))
                if len(out) >= 2000:
                    yield packed()
                    out = []
        if out:
            yield packed()

    return run


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likenesses."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt, count = in_order(docs, parts)
    schema = SCHEMA
    return (
        dealt.repartitionById(count, F.col("part"))
        .sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(_pairs_of_rows(arrow_schema(schema)), schema)
    )

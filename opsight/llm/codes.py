"""Compressed vectors: product codes whose distances are read from value dictionaries.

Components become integers ``floor(scale * x)``. Vectors are cut into ``parts`` consecutive
parts and every part position has a codebook, which starts as that part of the first vectors
by id. A round assigns each part to its nearest entry (squared Euclidean distance, ties to the
lower index) and then moves each entry to the componentwise floor of its parts' mean; an
unused entry stays. A last assignment gives the codes.

A component takes few integers, so nothing is squared per vector. For each dimension a batch
has a dictionary of its distinct integers and codes into it; one table holds the squared
differences of every dictionary value to all entries of the codebook. The distances of a part
are then gathers from the tables of its dimensions, added up over blocks that stay in cache.

A pass reads the vectors once and gives one row of counts and sums for each entry and task,
``parts * entries`` rows whatever the input; Spark adds them up and the driver holds codebooks
only, whose size depends on the vector length. Passes shuffle no vectors.

Arithmetic is exact at every magnitude: tables use 32 or 64 bits where the largest distance
fits, and Python's integers otherwise; sums travel as four limbs of 42 bits.

Null vectors and vectors with null or non-finite components are left out. The first kept row
by (id, vector), null ids last, tells the vector length; a vector of another length keeps its
row with null code and error and moves no entry. Lengths that the number of parts does not
divide give the first parts one component more; an empty part has distance 0 and code 0.
Fewer rows than entries give smaller codebooks. Rows that repeat an id or a vector each count.
An error above a long is null; so is the sum of such a label. Null labels are one label. An
empty table, or one without a usable vector, gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from opsight.llm.common import arrow_schema, sliced, written

LIMB_BITS = 42
LIMBS = 4
#: Rows whose distances to all entries of a codebook stay in cache.
BLOCK = 1024


@dataclass(frozen=True)
class Codebooks:
    """``entries[p][e]`` is entry ``e`` of part position ``p``, a tuple of integers."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]

    @property
    def length(self) -> int:
        return sum(len(book[0]) for book in self.entries)

    def digest(self) -> str:
        """SHA-256 of all integers by part, entry and position, joined by commas."""
        return hashlib.sha256(
            ",".join(str(x) for book in self.entries for entry in book for x in entry).encode()
        ).hexdigest()


def kept(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector has finite components only."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)))


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``: 64-bit integers, or Python's where they don't fit."""
    floors = np.floor(values.astype(np.float64) * scale)
    if not floors.size or np.abs(floors).max() < 2.0**62:
        return floors.astype(np.int64)
    return np.array([[int(x) for x in row] for row in floors], dtype=object)


def _cuts(length: int, parts: int) -> list[tuple[int, int]]:
    sizes = [length // parts + (p < length % parts) for p in range(parts)]
    ends = np.cumsum([0, *sizes])
    return [(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def start(vectors: DataFrame, parts: int, entries: int, scale: int, id_column: str, column: str) -> Codebooks | None:
    """Codebooks of the parts of the first rows; ``entries`` rows come to the driver."""
    order = [F.col(id_column).asc_nulls_last(), F.col(column)]
    first = vectors.select(id_column, column).orderBy(*order).limit(entries).collect()
    if not first:
        return None
    rows = [row[1] for row in first if len(row[1]) == len(first[0][1])]
    whole = _integers(np.array(rows, np.float64).reshape(len(rows), -1), scale)
    cuts = _cuts(whole.shape[1], parts)
    return Codebooks(tuple(tuple(tuple(int(x) for x in row[a:b]) for row in whole) for a, b in cuts))


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry nearest to each row of ``values``.

    The columns of ``values`` are encoded by dictionaries; distances are gathered from one
    table for each column and added.
    """
    rows, width = values.shape
    if not width or not rows:
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    reach = max(abs(int(x)) for a in (values, book) for x in (a.max(), a.min()))
    most = width * 4 * reach * reach
    kind = np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object
    tables, codes = [], []
    for place in range(width):
        words, coded = np.unique(values[:, place], return_inverse=True)
        tables.append((words.astype(kind)[:, None] - book[:, place].astype(kind)[None, :]) ** 2)
        codes.append(coded.reshape(-1))
    chosen = np.empty(rows, np.int64)
    errors = np.empty(rows, kind if kind is object else np.int64)
    for at in range(0, rows, BLOCK):
        block = slice(at, at + BLOCK)
        sums = tables[0][codes[0][block]]
        for table, coded in zip(tables[1:], codes[1:], strict=True):
            sums += table[coded[block]]
        chosen[block] = sums.argmin(axis=1)
        errors[block] = sums[np.arange(len(sums)), chosen[block]]
    return chosen, errors


def _matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of that length as a matrix, and the rows they are in."""
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero(sizes == length)
    if len(rows) != len(column):
        column = column.take(pa.array(rows))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), length), rows


def _limbs(total: int) -> list[int]:
    out = []
    for _ in range(LIMBS - 1):
        out.append(total & ((1 << LIMB_BITS) - 1))
        total >>= LIMB_BITS
    return [*out, total]


def _sums(values: np.ndarray, chosen: np.ndarray, count: int) -> np.ndarray:
    """Sum of the rows of ``values`` by entry, exact."""
    kind = np.int64
    if values.dtype == object or (values.size and int(np.abs(values).max()) * len(values) >= 1 << 62):
        kind = object
    out = np.zeros((count, values.shape[1]), kind)
    np.add.at(out, chosen, values.astype(kind))
    return out.astype(object)


def _moved(vectors: DataFrame, books: Codebooks, scale: int, column: str) -> Codebooks:
    """One round: assign all parts and move the entries."""
    parts, count = len(books.entries), len(books.entries[0])
    cuts = _cuts(books.length, parts)
    width = max(b - a for a, b in cuts)
    names = [f"s{place}_{limb}" for place in range(width) for limb in range(LIMBS)]
    schema = ", ".join(["part int, entry int, n bigint", *(f"{name} bigint" for name in names)])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [np.array(book, object if _wide(book) else np.int64).reshape(count, -1) for book in books.entries]
        sums = [np.zeros((count, b - a), object) for a, b in cuts]
        uses = np.zeros((parts, count), np.int64)
        for batch in batches:
            for piece in sliced(batch):
                values, _ = _matrix(piece.column(0), books.length)
                values = _integers(values, scale)
                for part, (a, b) in enumerate(cuts):
                    chosen, _ = nearest(values[:, a:b], arrays[part])
                    uses[part] += np.bincount(chosen, minlength=count)
                    sums[part] += _sums(values[:, a:b], chosen, count)
        rows = []
        for part, entry in zip(*np.nonzero(uses), strict=True):
            limbs = [limb for total in sums[part][entry] for limb in _limbs(int(total))]
            limbs += [0] * (len(names) - len(limbs))
            rows.append((int(part), int(entry), int(uses[part][entry]), *limbs))
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

    found = vectors.select(column).mapInArrow(run, schema).groupBy("part", "entry")
    entries = [list(book) for book in books.entries]
    for row in found.agg(*(F.sum(name).alias(name) for name in ("n", *names))).collect():
        own = len(entries[row["part"]][0])
        totals = [sum(row[f"s{p}_{k}"] << (LIMB_BITS * k) for k in range(LIMBS)) for p in range(own)]
        entries[row["part"]][row["entry"]] = tuple(total // row["n"] for total in totals)
    return Codebooks(tuple(map(tuple, entries)))


def _wide(book) -> bool:
    return any(abs(x) >= 1 << 62 for entry in book for x in entry)


def train(
    vectors: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    id_column: str = "vec_id",
    column: str = "embedding",
) -> Codebooks | None:
    """Codebooks of all rows of ``vectors``; None where no row has a usable vector."""
    vectors = kept(vectors, column)
    books = start(vectors, parts, entries, scale, id_column, column)
    for _ in range(rounds if books else 0):
        books = _moved(vectors, books, scale, column)
    return books


def encode(
    vectors: DataFrame,
    books: Codebooks,
    scale: int = 256,
    id_column: str = "vec_id",
    column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """(id, label, code, error): two hex digits for each part, and its distances summed up."""
    parts, length = len(books.entries), books.length
    if len(books.entries[0]) > 256:
        raise ValueError("a code of two hex digits has at most 256 entries")
    cuts = _cuts(length, parts)
    narrow = kept(vectors, column).select(id_column, label_column, column)
    new = [StructField("code", StringType()), StructField("error", LongType())]
    schema = StructType([vectors.schema[id_column], vectors.schema[label_column], *new])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [np.array(book, object if _wide(book) else np.int64).reshape(len(book), -1) for book in books.entries]
        for batch in batches:
            for piece in sliced(batch):
                values, rows = _matrix(piece.column(2), length)
                values = _integers(values, scale)
                codes = np.zeros((len(rows), parts), np.uint8)
                total = np.zeros(len(rows), object)
                for part, (a, b) in enumerate(cuts):
                    chosen, errors = nearest(values[:, a:b], arrays[part])
                    codes[:, part] = chosen
                    total += errors.astype(object)
                code, error = [None] * piece.num_rows, [None] * piece.num_rows
                for row, one, sum_ in zip(rows, codes, total, strict=True):
                    code[row] = one.tobytes().hex()
                    error[row] = int(sum_) if sum_ < 1 << 63 else None
                columns = [piece.column(0), piece.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return narrow.mapInArrow(run, schema)


def with_label_error(coded: DataFrame, label_column: str = "label") -> DataFrame:
    """Add ``label_error``, the errors of the rows with an equal label summed up.

    Sums are made before the shuffle, one row for each label then meets the rows; a label with
    a third of them is split by adaptive execution.
    """
    coded = written(coded, "vector-codes")
    whole = F.count("*") == F.count("error")
    sums = coded.groupBy(F.col(label_column).alias("_label")).agg(
        F.when(whole, F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)")).alias("label_error")
    )
    return coded.join(sums, coded[label_column].eqNullSafe(sums["_label"])).drop("_label")

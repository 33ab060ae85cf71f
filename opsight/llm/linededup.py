"""Line deduplication over the whole corpus, giving one keep bitmap for each document.

Lines become rows (hash of the key, document, position), range-partitioned by all three and
sorted, so that a key with a third of all lines is spread over many partitions. A streaming
pass over a partition sees the documents of a key from the largest id down: the first
occurrence is kept, the others are dropped. What a partition cannot know, the rows of its
first and last key, it hands on; these few keys are summed up over the partitions and
decided in a join. The result holds bitmaps, not texts.

A line's key is the line without blanks (space, tab to carriage return) at both ends and
with A-Z in lower case. Only keys of ``min_chars`` code points or more count. A key found in
``min_docs`` documents or more loses all its lines except those of the largest id.

Null and empty texts are one empty line. Rows that repeat an id are the same document: they
count once and lose lines alike if their texts are equal, and each by its own lines if not.
Rows with a null id keep all lines and count for no key. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import arrow_schema, by_batch, written
from opsight.llm.words import BLANK_CHARACTERS

_TO_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
KEYED = ("high", "low", "doc_id", "text_key", "place")
DROPS = "doc_id bigint, text_key bigint, place int, high bigint, low bigint, part int, docs bigint, first_doc bigint, last_doc bigint"


def _text_key():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line whose key is long enough."""

    def cut(batch: pa.RecordBatch) -> dict[str, list]:
        out = {"high": [], "low": [], "doc_id": [], "text_key": [], "place": []}
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text")), strict=True)
        for doc, text_key, text in rows:
            if text is None or doc is None:
                continue
            for place, line in enumerate(text.split("\n")):
                key = line.strip(BLANK_CHARACTERS)
                if len(key) < min_chars:
                    continue
                key = key.translate(_TO_LOWER).encode("utf-8", "surrogatepass")
                digest = hashlib.blake2b(key, digest_size=16).digest()
                out["high"].append(int.from_bytes(digest[:8], "big", signed=True))
                out["low"].append(int.from_bytes(digest[8:], "big", signed=True))
                out["doc_id"].append(doc)
                out["text_key"].append(text_key)
                out["place"].append(place)
        return out

    narrow = docs.select("doc_id", _text_key().alias("text_key"), "text")
    return by_batch(narrow, cut, "high bigint, low bigint, doc_id bigint, text_key bigint, place int")


def _stream(min_docs: int, schema: pa.Schema):
    """Decide the keys that lie wholly inside a partition, hand on the outer ones.

    A row with ``part`` null is a line to drop. ``part`` 0 marks a line of a key that is
    handed on: the first and the last key of the partition, and one that fills batches.
    ``part`` 1 sums up such a key: its documents here, the first and the last of them.
    Only the rows of one batch and of one unfinished key are held.
    """

    def rows(columns: list[np.ndarray], part: int | None, **more) -> pa.RecordBatch:
        values = dict(zip(KEYED, columns, strict=True)) | more
        if part is not None:
            values["part"] = np.full(len(columns[0]), part, np.int32)
        arrays = [
            pa.array(values[f.name], f.type) if f.name in values else pa.nulls(len(columns[0]), f.type)
            for f in schema
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        handed = None  # key that is being handed on
        docs, first_doc, last_doc = 0, None, None

        def hand_on(columns):
            nonlocal handed, docs, first_doc, last_doc
            doc = columns[2]
            handed = (columns[0][0], columns[1][0])
            docs += int((doc[1:] != doc[:-1]).sum()) + (last_doc is None or doc[0] != last_doc)
            first_doc = doc[0] if first_doc is None else first_doc
            last_doc = doc[-1]
            return rows(columns, 0)

        def summary():
            nonlocal docs, first_doc, last_doc
            one = [np.array([v]) for v in (*handed, first_doc, 0, -1)]
            out = rows(one, 1, docs=np.array([docs]), first_doc=np.array([first_doc]), last_doc=np.array([last_doc]))
            docs, first_doc, last_doc = 0, None, None
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in KEYED]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
                held = None
            high, low = columns[0], columns[1]
            starts = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
            key = (high[0], low[0])
            if handed is None or key == handed or len(starts) == 1:
                if docs and key != handed:
                    yield summary()
                end = starts[1] if len(starts) > 1 else len(high)
                yield hand_on([c[:end] for c in columns])
                columns = [c[end:] for c in columns]
                starts = starts[1:] - end
            if not len(starts):
                continue
            if docs:
                yield summary()
            if len(starts) > 1:
                inner = [c[: starts[-1]] for c in columns]
                gone = _inner(inner, starts[:-1], min_docs)
                if gone.any():
                    yield rows([c[gone] for c in inner], None)
            held = [c[starts[-1] :] for c in columns]
        if held is not None:
            yield hand_on(held)
        if docs:
            yield summary()

    return run


def _inner(columns, starts: np.ndarray, min_docs: int) -> np.ndarray:
    """Which lines of whole keys are dropped; documents come from the largest id down."""
    doc = columns[2]
    sizes = np.diff(np.append(starts, len(doc)))
    new = np.concatenate(([True], doc[1:] != doc[:-1]))
    new[starts] = True
    docs = np.add.reduceat(new.astype(np.int64), starts)
    return np.repeat(docs >= min_docs, sizes) & (doc != np.repeat(doc[starts], sizes))


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text_key, place) of the lines to drop, as a written table."""
    lines = line_rows(docs, min_chars)
    order = [F.col("high"), F.col("low"), F.col("doc_id").desc(), F.col("text_key"), F.col("place")]
    schema = DROPS
    found = written(
        lines.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_stream(min_docs, arrow_schema(schema)), schema),
        "lines",
    )
    # Keys at the edges: at most a few rows for each partition that was streamed. The same
    # document may end one partition and begin the next, where it must count once.
    edges = found.filter("part = 1").groupBy("high", "low").agg(
        F.max("first_doc").alias("keeper"),
        F.expr(
            "aggregate(array_sort(collect_list(struct(-first_doc as f, -last_doc as l, docs as n))),"
            " struct(cast(0 as bigint) as n, cast(null as bigint) as l),"
            " (s, x) -> struct(s.n + x.n - if(s.l = x.f, 1, 0) as n, x.l as l), s -> s.n)"
        ).alias("docs"),
    )
    decided = edges.filter(F.col("docs") >= min_docs).select("high", "low", "keeper")
    outer = (
        found.filter("part = 0")
        .select("high", "low", "doc_id", "text_key", "place")
        .join(F.broadcast(decided), ["high", "low"])
        .filter(F.col("doc_id") != F.col("keeper"))
    )
    columns = ["doc_id", "text_key", "place"]
    return found.filter("part is null").select(*columns).unionByName(outer.select(*columns))


def pack_bits(count: int, dropped: np.ndarray) -> bytes:
    """A compressed bitmap of the lines that stay."""
    keep = np.ones(count, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_bits(bitmap: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=count).astype(bool)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text_key, n_lines, n_dropped, keep) for each distinct row of ``docs``."""
    rows = docs.select(
        "doc_id",
        _text_key().alias("text_key"),
        (F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1)
        .cast("long")
        .alias("n_lines"),
    ).distinct()
    drops = (
        dropped_lines(docs, min_chars, min_docs)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("place").alias("places"))
    )

    def packed(batch: pa.RecordBatch) -> dict[str, list]:
        lines = batch.column("n_lines").to_pylist()
        places = [np.asarray(p or [], np.int64) for p in batch.column("places").to_pylist()]
        return {c: batch.column(c) for c in ("doc_id", "text_key", "n_lines")} | {
            "n_dropped": [len(p) for p in places],
            "keep": [pack_bits(n, p) for n, p in zip(lines, places, strict=True)],
        }

    joined = rows.join(drops, ["doc_id", "text_key"], "left")
    return by_batch(joined, packed, "doc_id bigint, text_key bigint, n_lines bigint, n_dropped bigint, keep binary")


def kept_text(text: str | None, bitmap: bytes | None, count: int | None) -> str:
    lines = (text or "").split("\n")
    if bitmap is None:
        return "\n".join(lines)
    keep = unpack_bits(bitmap, count)
    return "\n".join(line for line, stays in zip(lines, keep, strict=True) if stays)


def without_dropped(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut down to the lines that stay.

    Texts that lose nothing are left as they are, null included. Columns named like those
    of the bitmaps are kept.
    """
    lossy = bitmaps.filter("n_dropped > 0").select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("n_lines").alias("__lines"), F.col("keep").alias("__keep")
    )
    joined = docs.join(lossy, (F.col("doc_id") == F.col("__id")) & (_text_key() == F.col("__key")), "left").drop("__id", "__key")
    names = docs.columns

    def cut(batch: pa.RecordBatch) -> dict[str, list]:
        out = {c: batch.column(c) for c in names}
        rows = zip(*(batch.column(c).to_pylist() for c in ("text", "__keep", "__lines")), strict=True)
        out["text"] = [text if keep is None else kept_text(text, keep, n) for text, keep, n in rows]
        return out

    return by_batch(joined, cut, docs.schema)


def digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for each row of ``docs``."""
    left = docs.select("doc_id", _text_key().alias("text_key"), "text")
    right = bitmaps.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"}).filter("n_dropped > 0")
    joined = left.join(right, (F.col("doc_id") == F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")

    def hashed(batch: pa.RecordBatch) -> dict[str, list]:
        out = {"doc_id": batch.column("doc_id"), "n_lines": [], "n_dropped": [], "kept_sha256": []}
        rows = zip(*(batch.column(c).to_pylist() for c in ("text", "keep", "n_lines", "n_dropped")), strict=True)
        for text, keep, lines, dropped in rows:
            out["n_lines"].append(lines or (text or "").count("\n") + 1)
            out["n_dropped"].append(dropped or 0)
            kept = kept_text(text, keep, lines).encode("utf-8", "surrogatepass")
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        return out

    return by_batch(joined, hashed, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")

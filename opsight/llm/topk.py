"""Exact top-k search by inner product over vectors grouped by length.

Candidates are range-partitioned by length and stored in buckets of similar length, longest
first. A query meets the longest buckets first, which gives it a lower bound for its k-th
score. Every other bucket is then met only if its longest vector could reach that bound;
for the rest, the local cosine threshold (bound / query length / bucket length) chooses the
pruning inside the bucket: near 1 only the vectors whose coordinate in the query's largest
dimension lies in the feasible range are verified, else those long enough. Products are
verified exactly, and bounds only exclude scores strictly below.

Components are scaled, floored and held as doubles; products are exact as long as a sum of
their absolute values stays below 2**53, and are otherwise formed in Python integers and
kept within the range of a long. Vectors that are null or hold a null or non-finite component
take no part, nor do null ids. Vectors of different dimension are compared over the
dimensions both have. Rows that repeat an id are candidates each; a query never meets rows
of its own id, and repeated query rows give one result. Fewer candidates than ``k`` give
all. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsight.llm.common import arrow_schema, written

BUCKET = 1024
SHARD_BUCKETS = 16
QUERY_BLOCK = 2048
BUCKETS = "bucket bigint, dimension int, longest double, ids binary, vectors binary"
HITS = "query_id bigint, vec_id bigint, score bigint"


def scaled(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(vec_id, vector, length) of the rows that take part."""
    values = F.transform(vector_column, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    finite = F.forall(
        vector_column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    rows = vectors.filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & finite)
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), values.alias("vector"))
    return rows.withColumn(
        "length", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    )


def _matrix(rows: list, dimension: int) -> np.ndarray:
    out = np.zeros((len(rows), dimension))
    for at, row in enumerate(rows):
        out[at, : len(row)] = row
    return out


def bucketed(candidates: DataFrame) -> DataFrame:
    """One row for each bucket, ordered by number from the longest vectors on.

    Length and id together decide the range, so equal lengths are split too.
    """

    schema = arrow_schema(BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, rows, lengths = [], [], []

        def bucket(size):
            nonlocal ids, rows, lengths, number
            dimension = max(map(len, rows[:size]))
            values = [
                [number], [dimension], [max(lengths[:size])],
                [np.asarray(ids[:size], "<i8").tobytes()], [_matrix(rows[:size], dimension).tobytes()],
            ]
            ids, rows, lengths = ids[size:], rows[size:], lengths[size:]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            rows += batch.column("vector").to_pylist()
            lengths += batch.column("length").to_pylist()
            while len(ids) >= BUCKET:
                yield bucket(BUCKET)
        if ids:
            yield bucket(len(ids))

    order = [F.col("length").desc(), F.col("vec_id")]
    return candidates.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, BUCKETS)


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers, over the shared dimensions."""
    shared = min(queries.shape[1], vectors.shape[1])
    queries, vectors = queries[:, :shared], vectors[:, :shared]
    if not shared or not len(queries) or not len(vectors):
        return np.zeros((len(queries), len(vectors)), np.int64)
    if np.abs(queries).max() * np.abs(vectors).max() * shared < 2.0**53:
        return (queries @ vectors.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in side] for side in (queries, vectors)]
    most = 2**63 - 1
    return np.array(
        [[min(max(sum(a * b for a, b in zip(q, v, strict=True)), -most - 1), most) for v in whole[1]] for q in whole[0]],
        np.int64,
    )


class Block:
    """A block of queries with the best hits so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.lengths = np.sqrt((vectors**2).sum(1))
        self.bounds = bounds  # lower bounds of the k-th score, -inf if there is none
        self.scores = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), -1, np.int64)
        self.filled = np.zeros((len(ids), k), bool)

    def meet(self, ids: np.ndarray, vectors: np.ndarray, longest: float) -> None:
        """Let the queries that the bucket can serve meet its vectors."""
        # A little slack: lengths and cosines are rounded, scores are not.
        reach = self.lengths * longest * (1 + 1e-9) + 1e-6
        active = np.flatnonzero(reach >= self.bounds)
        if not len(active):
            return
        lengths = np.sqrt((vectors**2).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach[active] > 0, self.bounds[active] / reach[active], -1.0)
        near = active[cosine > 0.9]
        for at in near:
            keep = self._coordinate(self.vectors[at], vectors, lengths, self.bounds[at])
            self._verify(np.array([at]), ids[keep], vectors[keep])
        rest = active[cosine <= 0.9]
        if len(rest):
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(self.lengths[rest] > 0, self.bounds[rest] / self.lengths[rest], -np.inf).min()
            keep = lengths * (1 + 1e-9) + 1e-6 >= need
            self._verify(rest, ids[keep], vectors[keep])

    def _coordinate(self, query, vectors, lengths, bound) -> np.ndarray:
        """Vectors whose part along the query's largest coordinate can reach the bound.

        With q, v of unit length, cosine c and largest coordinate f, the rest of the product
        is at most sqrt(1 - q_f**2) * sqrt(1 - v_f**2).
        """
        shared = min(len(query), vectors.shape[1])
        norm = np.sqrt(query @ query)
        if not shared or not norm:
            return np.ones(len(vectors), bool)
        f = int(np.argmax(np.abs(query[:shared])))
        q = query[f] / norm
        with np.errstate(divide="ignore", invalid="ignore"):
            v = np.where(lengths > 0, vectors[:, f] / lengths, 0.0)
        most = q * v + np.sqrt(max(0.0, 1 - q * q)) * np.sqrt(np.maximum(0.0, 1 - v * v))
        return most * norm * lengths * (1 + 1e-9) + 1e-6 >= bound

    def _verify(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids):
            return
        for start in range(0, len(rows), 256):
            part = rows[start : start + 256]
            scores = _products(self.vectors[part], vectors)
            valid = ids[None, :] != self.ids[part][:, None]
            # Only what reaches the bound can matter; most rows are gone after this.
            valid &= scores >= self.bounds[part][:, None]
            for at, own, ok in zip(part, scores, valid, strict=True):
                hit = np.flatnonzero(ok)
                if len(hit):
                    self._merge(at, own[hit], ids[hit])

    def _merge(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        old = self.filled[at]
        scores = np.concatenate((self.scores[at][old], scores))
        ids = np.concatenate((self.found[at][old], ids))
        order = np.lexsort((ids, -scores.astype(object) if scores.min() == np.iinfo(np.int64).min else -scores))[: self.k]
        count = len(order)
        self.scores[at, :count], self.found[at, :count] = scores[order], ids[order]
        self.filled[at, :count] = True
        if count == self.k:
            self.bounds[at] = max(self.bounds[at], float(self.scores[at, -1]))

    def hits(self) -> dict[str, np.ndarray]:
        where = np.nonzero(self.filled)
        return {"query_id": self.ids[where[0]], "vec_id": self.found[where], "score": self.scores[where]}


def _searched(queries: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """Hits of the queries (query_id, vector, bound, block, shard) in the buckets (.., block, shard)."""
    schema = arrow_schema(HITS)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        vectors = left.column("vector").to_pylist()
        bounds = np.array([-np.inf if b is None else b for b in left.column("bound").to_pylist()])
        block = Block(left.column("query_id").to_numpy(), _matrix(vectors, max(map(len, vectors))), bounds, k)
        for row in sorted(right.to_pylist(), key=lambda r: r["bucket"]):
            ids = np.frombuffer(row["ids"], "<i8")
            block.meet(ids, np.frombuffer(row["vectors"]).reshape(len(ids), row["dimension"]), row["longest"])
        return pa.table(block.hits(), schema=schema)

    keys = ["block", "shard"]
    return queries.groupBy(*keys).cogroup(buckets.groupBy(*keys)).applyInArrow(run, HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: float = 64.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all other rows for each query."""
    candidates = written(scaled(vectors, id_column, vector_column, scale), "vectors")
    buckets = bucketed(candidates)
    # Buckets are few: their numbers, without the vectors, tell how they are dealt to shards.
    buckets = written(buckets, "buckets")
    numbers = Window.orderBy("bucket")
    shards = buckets.groupBy("bucket").agg(F.max("longest").alias("reach"))
    shards = shards.withColumn("shard", F.floor((F.row_number().over(numbers) - 1) / SHARD_BUCKETS))
    shards = written(shards, "shards")
    buckets = buckets.join(F.broadcast(shards.select("bucket", "shard")), "bucket")

    queries = candidates.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector", "length")
    # Of rows that repeat an id the least vector asks.
    queries = queries.groupBy("query_id").agg(F.min(F.struct("vector", "length")).alias("asks"))
    queries = queries.select("query_id", "asks.vector", "asks.length")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def met(shard_rows: DataFrame, asked: DataFrame) -> DataFrame:
        dealt = buckets.join(F.broadcast(shard_rows.select("shard").distinct()), "shard")
        return _searched(asked, dealt.select("*", all_blocks.alias("at")).withColumn("block", F.col("at").cast("long")), k)

    first = shards.filter("shard = 0")
    opening = queries.select("query_id", "vector", F.lit(None).cast("double").alias("bound"), "block", F.lit(0).cast("long").alias("shard"))
    early = written(_best(met(first, opening), k).drop("rank"), "early")
    bounds = early.groupBy("query_id").agg(F.min("score").cast("double").alias("bound"), F.count("*").alias("found"))
    bounds = bounds.filter(F.col("found") >= k).drop("found")
    reach = shards.filter("shard > 0").groupBy("shard").agg(F.max("reach").alias("reach"))
    # The stated query set meets every shard that can still serve it: a row for each of both.
    later = queries.join(bounds, "query_id", "left").join(
        F.broadcast(reach), F.col("bound").isNull() | (F.col("length") * F.col("reach") * (1 + 1e-9) + 1e-6 >= F.col("bound"))
    )
    late = met(reach, later.select("query_id", "vector", "bound", "block", F.col("shard").alias("asked_shard")).withColumnRenamed("asked_shard", "shard"))
    return _best(early.unionByName(late), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""A bounded sample of labelled documents, as sparse features on the driver."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import by_batch


def class_counts(labels: DataFrame, learnable: Column, label: str) -> dict[int, int]:
    """Learnable rows of each class, over all labels."""
    rows = labels.filter(learnable & F.col(label).isin(0, 1)).groupBy(label).count().collect()
    return {row[label]: row["count"] for row in rows}


def sample(
    docs: DataFrame,
    labels: DataFrame,
    learnable: Column,
    label: str,
    per_class: int,
    features: Callable[[str | None], np.ndarray],
    id_column: str = "doc_id",
    text_column: str = "text",
) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most ``per_class`` rows of each class.

    The rows are chosen by the hash of the id on the narrow label table. Their ids are
    bounded by ``per_class`` and so may be broadcast; texts are not shuffled.
    """
    usable = labels.filter(learnable & F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(label).cast("int").alias("label")
    )
    chosen = reduce(
        DataFrame.unionByName,
        (
            usable.filter(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(per_class)
            for value in (0, 1)
        ),
    )
    chosen = chosen.groupBy("id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(
        F.broadcast(chosen), "id"
    )

    def featured(batch: pa.RecordBatch) -> dict[str, list]:
        return {
            "id": batch.column("id"),
            "label": batch.column("label"),
            "features": [features(text) for text in batch.column("text").to_pylist()],
        }

    found = by_batch(texts, featured, "id bigint, label int, features array<int>").toPandas()
    found = found.sort_values("id", kind="stable")
    rows = [np.asarray(x, np.int64) for x in found["features"]]
    return rows, found["label"].to_numpy(int)

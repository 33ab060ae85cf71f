"""Tables, working tables and Arrow helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from opsight.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(frame: DataFrame, label: str) -> DataFrame:
    """Write a working table to the shared folder and read it back.

    Later steps then start from files that every executor can reach, so neither a lost
    executor nor a second use runs the steps before again.
    """
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    table = frame.sparkSession.read.schema(frame.schema).parquet(path)
    table.working_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove working tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(table.working_path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fold(column: str, folds: int) -> Column:
    """``crc32`` of the id written as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def by_batch(
    frame: DataFrame,
    function: Callable[[pa.RecordBatch], dict[str, list]],
    schema: str | StructType,
) -> DataFrame:
    """Apply ``function`` to the Arrow batches; it gives the columns of ``schema``."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                yield pa.RecordBatch.from_pydict(function(part), schema=arrow)

    return frame.mapInArrow(run, schema)


def arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def sliced(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece has one row or about ``most_bytes`` at most."""
    if not batch.num_rows:
        return
    rows = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, rows):
        piece = batch.slice(start, rows)
        if piece.num_rows > 1 and piece.get_total_buffer_size() and piece.nbytes > 2 * most_bytes:
            for row in range(piece.num_rows):
                yield piece.slice(row, 1)
        else:
            yield piece


def text_groups(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in groups of about ``most`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held

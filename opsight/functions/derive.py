"""Derived columns that are worked out once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections only refer to.

    Catalyst replaces a projected column by its expression in every filter it pushes
    down. For chains of derived times that multiplies the work and outgrows the
    generated code. Output of a generator is not replaced, while filters on the
    stored columns still pass below it to the scan.
    """
    once = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    kept = [F.col(f"`{name}`") for name in rows.columns if name not in columns]
    return rows.select(*kept, F.inline_outer(once))


def by_shuffle(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that Spark must not broadcast on its own estimate.

    The estimate shrinks whenever a wide column, as a parsed document, is worked out by
    ``computed`` and left out again. Rows of many megabytes then look like a few kilobytes,
    and the driver would gather them all.
    """
    return rows.hint("merge")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

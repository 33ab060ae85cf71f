"""Columns over JSON values of unknown shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsight.functions.derive import let

NESTED_LISTS = 3


def as_object(value: Column) -> Column:
    """The members of a JSON object; null for any other value."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_list(value: Column) -> Column:
    """The items of a JSON list; null for any other value."""
    return F.try_variant_get(value, "$", "array<variant>")


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def as_text(value: Column) -> Column:
    """A JSON string; null for any other value, numbers included."""
    return F.when(is_text(value), F.try_variant_get(value, "$", "string"))


def member_text(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "string")


def _quoted_strings(value: Column) -> Column:
    """All strings of a JSON list at any depth of lists, but none inside an object.

    Quoted texts and braces are picked from the text; a string counts while no brace is
    open. Member names stand inside braces, so they never count.
    """
    tokens = F.regexp_extract_all(
        F.to_json(value), F.lit(r'"(?:[^"\\]|\\.)*"|[{}]'), F.lit(0)
    )
    start = F.struct(F.lit(0).alias("open"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, token: Column) -> Column:
        moved = F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        counts = (moved == 0) & (state["open"] == 0)
        return F.struct(
            (state["open"] + moved).alias("open"),
            F.when(counts, F.concat(state["found"], F.array(token)))
            .otherwise(state["found"])
            .alias("found"),
        )

    quoted = F.aggregate(tokens, start, step, lambda state: state["found"])
    return F.from_json(
        F.concat(F.lit("["), F.concat_ws(",", quoted), F.lit("]")), "array<string>"
    )


def string_values(value: Column, depth: int = NESTED_LISTS) -> Column:
    """Strings of a value: itself, or those in a list and its inner lists.

    Lists nested deeper than ``depth`` are read from their text by the same rule, so
    the depth only decides how a string is found, not which.
    """
    nothing = F.array().cast("array<string>")

    def inner(items: Column) -> Column:
        return F.flatten(F.transform(items, lambda item: string_values(item, depth - 1)))

    def of(item: Column) -> Column:
        text = F.array(F.try_variant_get(item, "$", "string"))
        if depth == 0:
            listed = _quoted_strings(item)
            is_list = F.schema_of_variant(item).startswith("ARRAY")
            return F.when(is_text(item), text).when(is_list, listed).otherwise(nothing)
        return F.when(is_text(item), text).otherwise(
            F.coalesce(inner(as_list(item)), nothing)
        )

    return F.coalesce(let(value, of), nothing)

"""Which values of which inputs were requested, and how often."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight import fixed
from opsight.functions import text, variants
from opsight.functions.derive import computed
from opsight.operators.insights import named_process
from opsight.operators.keys import top_per_group

LEAVES = T.ArrayType(
    T.StructType(
        [T.StructField("path", T.StringType()), T.StructField("leaf", T.StringType())]
    )
)


@F.pandas_udf(LEAVES)
def _leaves(path: pd.Series, document: pd.Series) -> pd.Series:
    """All leaves of JSON documents: members extend the path, list items keep it."""

    def walk(prefix, value):
        if isinstance(value, dict):
            for name, child in value.items():
                yield from walk(f"{prefix}.{name}", child)
        elif isinstance(value, list):
            for child in value:
                yield from walk(prefix, child)
        else:
            yield {"path": prefix, "leaf": json.dumps(value, ensure_ascii=False)}

    return pd.Series(
        [list(walk(p, json.loads(d))) for p, d in zip(path, document)], dtype=object
    )


def flatten_json(nodes: DataFrame) -> DataFrame:
    """Leaves of JSON values with their dotted paths, at any nesting depth.

    ``nodes`` has ``path`` and ``node`` (JSON text) plus columns to keep; the result
    replaces them by ``path`` and ``leaf`` (JSON text). Built-in generators unroll a
    fixed number of levels and cost about ten times this Arrow function.
    """
    kept = [name for name in nodes.columns if name not in ("path", "node")]
    return nodes.where("node is not null").select(
        *kept, F.inline_outer(_leaves("path", "node"))
    ).where("path is not null")


def compact_components(path: Column, leaf: Column) -> Column:
    """Year lists inside time-component texts are written as ranges."""
    listed = F.regexp_extract(leaf, r'(?:^"|\|)year:([^|"]+)', 1)
    years = years_in(listed)
    compact = F.replace(leaf, listed, text.compact_years(years))
    applies = path.endswith(".time_components") & leaf.startswith('"') & (F.size(years) > 0)
    return F.when(applies, compact).otherwise(leaf)


def years_in(value: Column) -> Column:
    """Distinct years named in a text, in order."""
    found = F.regexp_extract_all(value, F.lit(fixed.YEAR), F.lit(0))
    return F.sort_array(F.array_distinct(found.cast("array<int>")))


def input_values(requests: DataFrame) -> DataFrame:
    """One row per given input value: ``process, name, value`` (VARIANT)."""
    named = requests.select(
        named_process().alias("process"),
        F.explode_outer(variants.as_object(F.col("inputs"))).alias("name", "given"),
    )
    return named.select(
        "process",
        "name",
        F.explode_outer(variants.as_list(F.col("given"))).alias("value"),
    ).where("value is not null")


def _workflow_nodes(prefix: Column, payload: Column) -> Column:
    """The inputs of a workflow and the parameters of each of its steps."""
    inputs = F.try_variant_get(payload, "$.inputs", "variant")
    steps = F.map_values(F.try_variant_get(payload, "$.steps", "map<string,variant>"))
    parameters = F.transform(
        F.filter(
            steps,
            lambda step: F.try_variant_get(step, "$.in", "map<string,variant>").isNotNull(),
        ),
        lambda step: F.struct(
            F.concat(
                prefix,
                F.lit(".steps."),
                F.coalesce(
                    F.nullif(variants.member_text(step, "run"), F.lit("")),
                    F.lit("unknown"),
                ),
            ).alias("path"),
            F.to_json(F.try_variant_get(step, "$.in", "variant")).alias("node"),
        ),
    )
    first = F.array(
        F.struct(
            F.concat(prefix, F.lit(".inputs")).alias("path"),
            F.to_json(inputs).alias("node"),
        )
    )
    return F.concat(first, parameters)


def coverage_items(requests: DataFrame) -> DataFrame:
    """Dotted input name and rendered value of everything that was requested."""
    value = F.col("value")
    complex_text = F.when(
        variants.member_text(value, "type") == "ComplexData",
        variants.as_text(F.try_variant_get(value, "$.value", "variant")),
    )
    rows = (
        computed(
            computed(
                input_values(requests),
                path=F.concat_ws(".", "process", "name"),
                complex_text=complex_text,
            ),
            payload=F.try_parse_json("complex_text"),
        ).withColumn(
            "kind",
            F.when(F.col("complex_text").isNull(), "plain")
            .when(F.col("payload").isNull(), "malformed")
            .when(~F.col("complex_text").rlike(r"^\s*\{"), "plain")
            .when(
                F.try_variant_get("payload", "$.inputs", "map<string,variant>").isNotNull()
                & F.try_variant_get("payload", "$.steps", "map<string,variant>").isNotNull(),
                "workflow",
            )
            .otherwise("document"),
        )
    )
    content = F.try_variant_get(value, "$.value", "variant")
    plain = F.array(F.struct(F.col("path"), F.to_json(F.coalesce(content, value)).alias("node")))
    document = F.array(F.struct(F.col("path"), F.col("complex_text").alias("node")))
    nodes = rows.where("kind != 'malformed'").select(
        F.when(F.col("kind") == "plain", True).otherwise(False).alias("is_plain"),
        F.inline_outer(
            F.when(F.col("kind") == "plain", plain)
            .when(
                F.col("kind") == "workflow",
                _workflow_nodes(F.col("path"), F.col("payload")),
            )
            .otherwise(document)
        ),
    )
    whole = nodes.where("is_plain").select("path", F.col("node").alias("leaf"))
    leaves = flatten_json(nodes.where("not is_plain").select("path", "node"))
    return whole.unionByName(leaves).select(
        F.col("path").alias("dimension"),
        compact_components(F.col("path"), F.col("leaf")).alias("value"),
    )


def coverage_counts(requests: DataFrame) -> DataFrame:
    return (
        coverage_items(requests)
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def coverage(counts: DataFrame) -> DataFrame:
    """Uses and distinct values per dimension, from the value counts."""
    return counts.groupBy("dimension").agg(
        F.sum("count").alias("uses"), F.count(F.lit(1)).alias("distinct_values")
    )


def coverage_top(counts: DataFrame, top: int = 10) -> DataFrame:
    """The most used values of each dimension; equal counts in value order."""
    return top_per_group(
        counts, ["dimension"], [F.col("count").desc(), F.col("value")], top
    )

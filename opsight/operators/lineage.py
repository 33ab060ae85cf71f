"""Which datasets and years the orchestrated workflows asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight import fixed
from opsight.functions import text, variants
from opsight.functions.derive import computed, let
from opsight.operators.coverage import years_in
from opsight.operators.insights import failed_with_category, named_outcome
from opsight.operators.keys import top_per_group

ENTRY = "struct<collection:string,years:array<int>,ranges:array<string>>"


def component_years(values: Column) -> Column:
    """Years of the first ``year:`` part of each time-component text."""
    return F.sort_array(
        F.array_distinct(
            F.flatten(
                F.transform(
                    values,
                    lambda value: years_in(
                        F.regexp_extract(value, fixed.COMPONENT_YEARS, 1)
                    ),
                )
            )
        )
    )


def range_years(values: Column) -> Column:
    """Every year from the first to the last one named in each range text."""
    named = F.filter(
        F.transform(values, years_in), lambda years: F.size(years) > 0
    )
    spans = F.transform(
        named, lambda years: F.sequence(F.array_min(years), F.array_max(years))
    )
    return F.sort_array(F.array_distinct(F.flatten(spans)))


def requested_years(ranges: Column, components: Column) -> Column:
    """Component years win over the years of the ranges."""
    return let(
        component_years(components),
        lambda years: F.when(F.size(years) > 0, years).otherwise(range_years(ranges)),
    )


def workflow_payloads(inputs: Column) -> Column:
    """Parsed workflow documents of a request (array of VARIANT objects)."""
    given = F.filter(
        F.try_variant_get(inputs, "$.workflow", "array<variant>"),
        lambda item: variants.member_text(item, "type") == "ComplexData",
    )
    texts = F.transform(
        given, lambda item: variants.as_text(F.try_variant_get(item, "$.value", "variant"))
    )
    documents = F.transform(
        F.filter(texts, lambda body: body.rlike(r"^\s*\{")), F.try_parse_json
    )
    return F.coalesce(
        F.filter(documents, lambda document: document.isNotNull()),
        F.array().cast("array<variant>"),
    )


def _is_source(collection: Column) -> Column:
    return ~collection.rlike(fixed.STEP_OUTPUT)


def _resolve(reference: Column, aliases: Column) -> Column:
    """Collections a step reference stands for; an unknown one stands for itself."""
    alias = F.when(
        reference.startswith("inputs/"), F.substr(reference, F.lit(len("inputs/") + 1))
    ).otherwise(reference)
    return F.coalesce(
        F.try_element_at(aliases, alias),
        F.when(F.map_contains_key(aliases, reference), F.array().cast("array<string>")),
        F.array(reference),
    )


def _payload_entries(payload: Column) -> Column:
    """``(collection, years, ranges)`` of one workflow document."""
    aliases = F.transform_values(
        F.try_variant_get(payload, "$.inputs", "map<string,variant>"),
        lambda _, value: variants.string_values(value),
    )
    steps = F.filter(
        F.map_values(F.try_variant_get(payload, "$.steps", "map<string,variant>")),
        lambda step: F.try_variant_get(step, "$.in", "map<string,variant>").isNotNull(),
    )
    bound = F.struct(aliases.alias("aliases"), steps.alias("steps"))
    return F.coalesce(
        let(bound, lambda b: _entries_of(b["aliases"], b["steps"])),
        F.array().cast(f"array<{ENTRY}>"),
    )


def _entries(collections: Column, years: Column, ranges: Column) -> Column:
    return F.transform(
        collections,
        lambda collection: F.struct(
            collection.alias("collection"), years.alias("years"), ranges.alias("ranges")
        ),
    )


def _entries_of(aliases: Column, steps: Column) -> Column:
    given = F.filter(F.flatten(F.map_values(aliases)), _is_source)

    def strings(step: Column, name: str) -> Column:
        return variants.string_values(F.try_variant_get(step, f"$.in.{name}", "variant"))

    def of_step(step: Column) -> Column:
        ranges = strings(step, "time")
        referenced = F.filter(
            F.flatten(
                F.transform(strings(step, "collection"), lambda r: _resolve(r, aliases))
            ),
            _is_source,
        )
        bound = F.struct(
            let(
                referenced, lambda r: F.when(F.size(r) > 0, r).otherwise(given)
            ).alias("selected"),
            let(
                ranges,
                lambda r: F.struct(
                    requested_years(r, strings(step, "time_components")).alias("years"),
                    r.alias("ranges"),
                ),
            ).alias("asked"),
        )
        return let(
            bound,
            lambda b: _entries(b["selected"], b["asked"]["years"], b["asked"]["ranges"]),
        )

    named = _entries(
        given, F.array().cast("array<int>"), F.array().cast("array<string>")
    )
    from_steps = F.flatten(F.transform(steps, of_step))
    return F.concat(named, F.coalesce(from_steps, F.array().cast(f"array<{ENTRY}>")))


def _merge(entries: Column) -> Column:
    """Entries of one request with one item per collection."""

    def one(name: Column) -> Column:
        return let(
            F.filter(entries, lambda entry: entry["collection"] == name),
            lambda same: F.struct(
                name.alias("collection"),
                F.sort_array(F.array_distinct(F.flatten(same["years"]))).alias("years"),
                F.flatten(same["ranges"]).alias("ranges"),
            ),
        )

    return F.transform(F.array_distinct(entries["collection"]), one)


def request_lineage(requests: DataFrame) -> DataFrame:
    """Orchestrated requests with ``has_lineage`` and ``requested`` collections.

    All of it happens inside the row: a request is one document, so nothing is
    shuffled until collections are counted.
    """
    parsed = computed(
        requests.where("process = 'orchestrate'"),
        payloads=workflow_payloads(F.col("inputs")),
    )
    entries = F.flatten(F.transform("payloads", _payload_entries))
    return computed(
        parsed,
        has_lineage=F.size("payloads") > 0,
        requested=let(entries, _merge),
    ).drop("payloads")


def exploded_lineage(lineage: DataFrame, *kept: str | Column) -> DataFrame:
    """One row per request and collection.

    The outer generator keeps Catalyst from adding a size filter that would work out
    ``requested`` a second time below the generator.
    """
    return lineage.select(*kept, F.inline_outer("requested")).where(
        "collection is not null"
    )


def lineage_availability(lineage: DataFrame) -> DataFrame:
    return lineage.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("has_lineage").alias("with_lineage"),
        F.count_if(~F.col("has_lineage")).alias("without_lineage"),
    )


def collection_summary(lineage: DataFrame) -> DataFrame:
    """Requests, all outcomes and years of each collection, in one pass.

    Requests are first counted per collection, outcome and set of years; each count is
    then credited to the first year of its set. A year has four digits: the set of a
    collection cannot outgrow 2 000 numbers, and it is built on the map side first.
    ``outcomes`` counts every outcome that occurs, by name.
    """
    asked = (
        exploded_lineage(lineage, named_outcome().alias("outcome"))
        .groupBy("collection", "outcome", "years")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "collection", "outcome", "n", F.posexplode_outer("years").alias("at", "year")
        )
    )
    once = F.when(F.coalesce("at", F.lit(0)) == 0, F.col("n"))
    by_outcome = asked.groupBy("collection", "outcome").agg(
        F.sum(once).alias("n"), F.collect_set("year").alias("years")
    )

    def requests_with(outcome: str) -> Column:
        counted = F.sum(F.when(F.col("outcome") == outcome, F.col("n")))
        return F.coalesce(counted, F.lit(0)).alias(outcome)

    named = F.array_sort(F.collect_list(F.struct("outcome", "n")))
    years = F.array_sort(F.array_distinct(F.flatten(F.collect_list("years"))))
    return (
        by_outcome.groupBy("collection")
        .agg(
            F.sum("n").alias("requests"),
            requests_with("successful"),
            requests_with("failed"),
            F.map_from_entries(named).alias("outcomes"),
            years.alias("years"),
        )
        .withColumn("year_coverage", text.compact_years(F.col("years")))
    )


def collections_sorted(summary: DataFrame, sort_by: str = "name") -> DataFrame:
    """Collections by name, or by a count in falling order with the name as tie."""
    if sort_by == "name":
        return summary.orderBy("collection")
    if sort_by not in ("requests", "successful", "failed"):
        raise ValueError(f"cannot sort collections by {sort_by!r}")
    return summary.orderBy(F.col(sort_by).desc(), "collection")


def collection_ranges(lineage: DataFrame, top: int = 10) -> DataFrame:
    """Most used time ranges of each collection."""
    counts = (
        exploded_lineage(lineage)
        .select("collection", F.explode("ranges").alias("time_range"))
        .groupBy("collection", "time_range")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return top_per_group(
        counts, ["collection"], [F.col("count").desc(), F.col("time_range")], top
    )


FAILURE_KEYS = ["collection", "years", "time_ranges", "category", "message"]


def collection_failure_rows(lineage: DataFrame) -> DataFrame:
    """One row per failed request and collection, with the keys it is grouped by."""
    failed = failed_with_category(lineage)
    unknown = F.array(
        F.struct(
            F.lit("unknown").alias("collection"),
            F.array().cast("array<int>").alias("years"),
            F.array().cast("array<string>").alias("ranges"),
        )
    )
    targets = F.when(F.size("requested") > 0, F.col("requested")).otherwise(unknown)
    rows = failed.select("job_id", "category", "cause", F.inline_outer(targets))
    return rows.select(
        F.coalesce(F.nullif("job_id", F.lit("")), F.lit("unknown")).alias("job_id"),
        "collection",
        text.compact_years(F.col("years")).alias("years"),
        F.concat_ws(",", F.sort_array(F.array_distinct("ranges"))).alias("time_ranges"),
        "category",
        F.col("cause").alias("message"),
    )


def collection_failures(lineage: DataFrame) -> DataFrame:
    return (
        collection_failure_rows(lineage)
        .groupBy(*FAILURE_KEYS)
        .agg(F.count(F.lit(1)).alias("count"))
    )


def failure_group_count(groups: DataFrame) -> DataFrame:
    """How many failure groups there are, whatever part of them is reported."""
    return groups.agg(F.count(F.lit(1)).alias("failure_group_count"))


def failure_order() -> list[Column]:
    """Order of failure groups inside a category of the report."""
    return [
        F.col("count").desc(),
        F.col("collection"),
        F.col("years"),
        F.col("time_ranges"),
        F.col("message"),
    ]

"""Text columns: log fields, failure categories, root causes, display limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsight import fixed
from opsight.functions.derive import let

ANY_CASE = "(?i)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def collapse_spaces(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(ANY_CASE + pattern)


def is_memory_failure(text: Column) -> Column:
    return matches(text, fixed.MEMORY_PATTERN)


def is_timeout_failure(text: Column) -> Column:
    """Timeouts are counted apart from memory failures, which take precedence."""
    return ~is_memory_failure(text) & matches(text, fixed.TIMEOUT_PATTERN)


def failure_category(text: Column | str) -> Column:
    """First matching failure category of a message; blank text is ``unknown``."""
    text = F.coalesce(_col(text), F.lit(""))
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    first, *rest = fixed.FAILURE_CATEGORIES
    category = F.when(matches(text, first[1]), first[0])
    for name, pattern in rest:
        category = category.when(matches(text, pattern), name)
    return (
        category.when(matches(trimmed, fixed.GENERIC_FAILURE_PATTERN), "unknown")
        .when(trimmed == "", "unknown")
        .otherwise("other")
    )


def joined_fields(items: Column, names: tuple[str, ...]) -> Column:
    """All named fields of an array of structs as one text; null fields are empty."""
    return F.concat_ws(
        " ",
        F.flatten(
            F.transform(
                items,
                lambda item: F.array(
                    *[F.coalesce(item[name], F.lit("")) for name in names]
                ),
            )
        ),
    )


def stripped(value: Column) -> Column:
    """The text without blanks of any kind at its ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def failure_text(failures: Column, diagnostics: Column) -> Column:
    """Text a request's failure category is read from."""
    return F.concat_ws(
        " ",
        F.when(
            F.size(failures) > 0,
            joined_fields(failures, ("code", "locator", "message")),
        ),
        F.when(
            F.size(diagnostics) > 0, joined_fields(diagnostics, ("source", "message"))
        ),
    )


def first_message(failures: Column, diagnostics: Column) -> Column:
    """First non-empty diagnostic message, else the first failure message."""

    def pick(items: Column) -> Column:
        texts = F.transform(items, lambda item: item["message"])
        return F.get(F.filter(texts, lambda text: text != ""), F.lit(0))

    return F.coalesce(pick(diagnostics), pick(failures))


def root_cause(message: Column | str) -> Column:
    """The one line of a failure message that names its cause.

    Null input means the request failed without any message.
    """
    message = _col(message)
    text = collapse_spaces(message)

    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, ANY_CASE + pattern, 0), F.lit(""))

    years = F.sort_array(
        F.array_distinct(
            F.regexp_extract_all(
                text, F.lit(ANY_CASE + fixed.MISSING_DATETIME_YEAR), F.lit(1)
            )
        )
    )
    missing_years = F.when(
        F.contains(text, F.lit(fixed.MISSING_DATETIMES_TEXT)) & (F.size(years) > 0),
        F.concat(F.lit(fixed.MISSING_YEARS_PREFIX), F.concat_ws(",", years)),
    )
    after_prefix = F.element_at(
        F.split(text, ANY_CASE + fixed.TIME_COMPONENTS_PREFIX), -1
    )
    before_traceback = F.get(
        F.split(after_prefix, ANY_CASE + fixed.TRACEBACK_BOUNDARY), F.lit(0)
    )
    components = F.when(
        matches(text, fixed.TIME_COMPONENTS_PREFIX),
        F.concat(F.lit(fixed.TIME_COMPONENTS_LABEL), F.trim(before_traceback)),
    )
    exceptions = F.regexp_extract_all(text, F.lit(fixed.EXCEPTION_TEXT), F.lit(1))
    last_exception = F.when(
        F.size(exceptions) > 0, F.trim(F.element_at(exceptions, -1))
    )
    cause = F.coalesce(
        found(fixed.ROOT_TIME_LIMIT),
        found(fixed.ROOT_CANCELLED),
        found(fixed.ROOT_OOM),
        found(fixed.ROOT_NO_DATA),
        missing_years,
        components,
        last_exception,
        text,
    )
    return F.when(message.isNull(), fixed.UNKNOWN_FAILURE).otherwise(cause)


def display_message(text: Column | str, limit: int = fixed.MAX_DETAIL_LENGTH) -> Column:
    """Shorten a message for display; the marker counts towards the limit."""
    text = _col(text)
    kept = limit - len(fixed.TRUNCATION_MARKER)
    short = F.concat(
        F.regexp_replace(F.left(text, F.lit(kept)), r"\s+$", ""),
        F.lit(fixed.TRUNCATION_MARKER),
    )
    return F.when(F.length(text) > limit, short).otherwise(text)


def name_component(text: Column | str, fallback: str = "unknown") -> Column:
    """Text made safe as one part of an archive name."""
    safe = F.regexp_replace(F.trim(_col(text)), r"[^A-Za-z0-9_.-]+", "-")
    safe = F.regexp_replace(safe, r"^[-.]+|[-.]+$", "")
    named = F.when(F.coalesce(safe, F.lit("")) == "", fallback).otherwise(safe)
    return F.left(named, F.lit(fixed.MAX_NAME_COMPONENT))


def log_fields(message: Column | str) -> Column:
    """``key=value`` pairs of a log message as a map; a later duplicate wins."""
    message = _col(message)
    keys = F.regexp_extract_all(message, F.lit(fixed.LOG_FIELD), F.lit(1))
    found = F.struct(
        F.split(F.translate(F.concat_ws(" ", keys), "-", "_"), " ").alias("names"),
        F.transform(
            F.regexp_extract_all(message, F.lit(fixed.LOG_FIELD), F.lit(2)),
            lambda value: F.when(~value.isin(*fixed.NULL_FIELD_VALUES), value),
        ).alias("values"),
    )
    return let(found, _last_of_each)


def _last_of_each(found: Column) -> Column:
    names, values = found["names"], found["values"]
    last = F.filter(
        F.sequence(F.lit(0), F.size(values) - 1),
        lambda at: ~F.array_contains(
            F.slice(names, at + F.lit(2), F.size(names)), F.get(names, at)
        ),
    )
    chosen = F.map_from_arrays(
        F.transform(last, lambda at: F.get(names, at)),
        F.transform(last, lambda at: F.get(values, at)),
    )
    none = F.create_map().cast("map<string,string>")
    return (
        F.when(F.size(values) == 0, none)
        .when(
            F.size(F.array_distinct(names)) == F.size(names),
            F.map_from_arrays(names, values),
        )
        .otherwise(chosen)
    )


def typed_log_fields(fields: Column | str) -> Column:
    """The same map with whole and decimal numbers as numbers (VARIANT values)."""
    return F.transform_values(
        _col(fields),
        lambda _, value: F.when(
            value.rlike(r"^-?[0-9]+$"), value.try_cast("decimal(38,0)").cast("variant")
        )
        .when(value.rlike(r"^-?[0-9]+\.[0-9]+$"), value.try_cast("double").cast("variant"))
        .otherwise(value.cast("variant")),
    )


def log_field(message: Column | str, name: str) -> Column:
    """One field of a log message, without building the map of all fields."""
    key = name.replace("_", "[-_]")
    value = F.regexp_extract(_col(message), rf"(?s)^(?:.*\s)?{key}=(\S+)", 1)
    return F.when(~value.isin("", *fixed.NULL_FIELD_VALUES), value)


def event_name(message: Column | str, level: Column) -> Column:
    """Name of the operation event a log line stands for."""
    finding = log_field(message, "finding")
    return (
        F.when(log_field(message, "action") == "recovered", "job-recovered")
        .when(finding == "long-running", "job-long-running")
        .when(finding.isNotNull(), finding)
        .when(
            (log_field(message, "decision") == "error") | (level == "critical"),
            "operation-error",
        )
        .otherwise("operation-warning")
    )


def compact_years(years: Column) -> Column:
    """Sorted distinct years as ``2015-2016,2018``; an empty set is ``unknown``."""
    starts = F.filter(
        years, lambda year, at: (at == 0) | (F.get(years, at - 1) != year - 1)
    )
    ends = F.filter(
        years,
        lambda year, at: (at == F.size(years) - 1) | (F.get(years, at + 1) != year + 1),
    )
    runs = F.zip_with(
        starts,
        ends,
        lambda start, end: F.when(start == end, start.cast("string")).otherwise(
            F.concat_ws("-", start, end)
        ),
    )
    return F.when(F.coalesce(F.size(years), F.lit(0)) <= 0, "unknown").otherwise(
        F.concat_ws(",", runs)
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)

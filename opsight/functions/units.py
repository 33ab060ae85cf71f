"""Queue and host units: elapsed time, memory sizes, node states, percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsight import fixed


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def elapsed_seconds(text: Column | str) -> Column:
    """``[[D-]H:]M:S`` to seconds; malformed or out-of-range text is null."""
    text = F.trim(_col(text))
    shape = r"^(?:(\d+)-)?(?:(\d+):)?(\d+):(\d+)$"

    def part(index: int) -> Column:
        value = F.regexp_extract(text, shape, index)
        return F.when(value == "", "0").otherwise(value).try_cast("bigint")

    days, hours, minutes, seconds = (part(index) for index in (1, 2, 3, 4))
    return F.when(
        text.rlike(shape) & (minutes < 60) & (seconds < 60),
        days * 86400 + hours * 3600 + minutes * 60 + seconds,
    )


def memory_bytes(text: Column | str) -> Column:
    """Memory text to whole bytes; a bare number is in MiB, no-value words are null."""
    text = F.upper(F.trim(_col(text)))
    shape = r"^([0-9]+(?:\.[0-9]*)?|\.[0-9]+)([BKMGTP]?)[CN]?$"
    amount = F.regexp_extract(text, shape, 1).try_cast("decimal(20,6)")
    unit = F.regexp_extract(text, shape, 2)
    factor = None
    for name, size in fixed.MEMORY_UNIT_BYTES.items():
        value = F.lit(size).cast("decimal(18,0)")
        factor = F.when(unit == name, value) if factor is None else factor.when(
            unit == name, value
        )
    return F.when(text.rlike(shape), F.floor(amount * factor).cast("bigint"))


def is_memory_text(text: Column | str) -> Column:
    """Whether a memory text is a size or one of the words for no value."""
    text = F.upper(F.trim(_col(text)))
    return text.isin("", "N/A", "UNKNOWN", "UNLIMITED") | memory_bytes(text).isNotNull()


def percent_of(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``; null without a positive whole."""
    return F.when(whole != 0, part * F.lit(100.0) / whole)


def node_base_state(state: Column | str) -> Column:
    return F.rtrim(F.lower(_col(state)), F.lit(fixed.NODE_STATE_FLAGS))


def is_usable_node(partition_state: Column | str, node_state: Column | str) -> Column:
    """Up partition, responding node, and a base state that can take work."""
    state = F.lower(_col(node_state))
    base = node_base_state(state)
    flags = F.substr(state, F.length(base) + 1)
    return (
        (F.lower(_col(partition_state)) == "up")
        & ~F.contains(flags, F.lit("*"))
        & base.isin(*fixed.USABLE_NODE_STATES)
    )


def disk_plugin(mount: Column | str) -> Column:
    """Metric plugin instance of a mount point."""
    mount = _col(mount)
    path = F.regexp_replace(mount, r"^/+|/+$", "")
    return F.when(mount == "/", "df-root").otherwise(
        F.concat(F.lit("df-"), F.translate(path, "/", "-"))
    )

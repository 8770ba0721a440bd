"""Text, path, map and time expressions shared by the collectors and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a trailing underscore and exactly four digits mark a cycle-suffixed name.
CYCLE_SUFFIX = r"^_[0-9]{4}$"


def none_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def iso_timestamp(col: Column) -> Column:
    """ISO-8601 text (also with `Z`) to timestamp; unreadable text gives NULL."""
    return F.try_to_timestamp(none_if_empty(F.trim(col)))


def int_or_null(col: Column) -> Column:
    """Text to integer; empty, NULL and non-numeric text give NULL."""
    return none_if_empty(F.trim(col)).try_cast("int")


def _has_cycle(name: Column) -> Column:
    # only the last five characters are matched, and something must stand before them
    return (F.length(name) > 5) & F.substring(name, -5, 5).rlike(CYCLE_SUFFIX)


def name_family(name: Column) -> Column:
    """`pay_2024` -> `pay`; NULL without the suffix. The last suffix counts."""
    return F.when(_has_cycle(name), F.substring(name, F.lit(1), F.length(name) - 5))


def name_cycle(name: Column) -> Column:
    """`pay_2024` -> 2024; NULL without the suffix."""
    return F.when(_has_cycle(name), F.substring(name, -4, 4).cast("int"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def strip_suffix(col: Column, suffix: str) -> Column:
    kept = F.substring(col, F.lit(1), F.length(col) - len(suffix))
    return F.when(col.endswith(F.lit(suffix)), kept).otherwise(col)


def path_key(path: Column, key: str, type_name: str = "string") -> Column:
    """Value of a `key=value` path segment, typed; NULL when absent or not of that type."""
    text = F.regexp_extract(path, rf"(?:^|/){key}=([^/]+)(?:/|$)", 1)
    return none_if_empty(text).try_cast(type_name)


def hours_between(later: Column, earlier: Column) -> Column:
    """Signed hours, two decimals; a clock that is ahead gives a negative age."""
    return F.round((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9), 2)


def map_get(col: Column, key: str) -> Column:
    """Map lookup, NULL when the key is absent."""
    return F.try_element_at(col, F.lit(key))


def map_with_prefix(col: Column, prefix: str) -> Column:
    """Entries whose key starts with `prefix`."""
    return F.map_filter(col, lambda k, _: k.startswith(F.lit(prefix)))


def json_string(col: Column) -> Column:
    """The text as a quoted JSON string literal."""
    wrapped = F.to_json(F.struct(col.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def in_csv(col: Column, csv: Column) -> Column:
    """Membership in a comma-separated list."""
    return F.array_contains(F.split(csv, ","), col)

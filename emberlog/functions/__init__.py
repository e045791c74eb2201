"""Column expressions on keys and entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_is(key: str, column: str | Column = "key") -> Column:
    """Exact match; reaches Parquet as EqualTo."""
    return F.col(column) == F.lit(key) if isinstance(column, str) else column == F.lit(key)


def has_prefix(prefix: str, column: str | Column = "key") -> Column:
    """Keys that start with ``prefix`` (every key, for ''); reaches Parquet as StringStartsWith. ``_`` and ``%`` are ordinary characters."""
    c = F.col(column) if isinstance(column, str) else column
    return c.startswith(prefix) if prefix else F.lit(True)


def range_may_hold_key(smallest: Column, largest: Column, key: str) -> Column:
    return (smallest <= F.lit(key)) & (F.lit(key) <= largest)


def range_may_hold_prefix(smallest: Column, largest: Column, prefix: str) -> Column:
    p = F.lit(prefix)
    return (has_prefix(prefix, smallest) | (p >= smallest)) & (has_prefix(prefix, largest) | (p <= largest))


def value_size(value: Column) -> Column:
    """Bytes of a value; a tombstone has none."""
    return F.coalesce(F.octet_length(value), F.lit(0))


def buffered_size(key: Column, value: Column) -> Column:
    """What an entry counts in a buffer."""
    return (F.octet_length(key) + value_size(value)).cast("bigint")


def entry_size(key: Column, value: Column) -> Column:
    """What an entry counts in a block: two lengths and a presence byte besides key and value."""
    return (9 + F.octet_length(key) + value_size(value)).cast("bigint")

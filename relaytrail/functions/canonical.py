"""Canonical JSON and hashes over it.

Canonical form: keys in code point order, no blanks, UTF-8, moments in UTC with microseconds
and a ``Z``, fractional numbers as text with six decimals, NULL fields kept.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def moment(ts: Column) -> Column:
    """``2026-09-02T04:11:06.000000Z``; needs a session in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def decimal_text(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.6f", value.cast("double")))


def sorted_map(value: Column) -> Column:
    """A map with its entries in key order."""
    return F.map_from_entries(F.array_sort(F.map_entries(value)))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Canonical JSON object of the named columns."""
    members = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*members), {"ignoreNullFields": "false"})


def canonical_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)

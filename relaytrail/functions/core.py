"""Small helpers shared by the column functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import wraps

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bound(function: Callable[..., Column]) -> Callable[..., Column]:
    """Bind the first column argument, so a function that uses it often is given it once."""

    @wraps(function)
    def call(c: Column, *args, **kwargs) -> Column:
        return let(c, lambda x: function(x, *args, **kwargs))

    return call


def constant(value, ddl: str) -> Column:
    """A nested literal; the optimizer folds it, and it is one node to build."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def strings(values: Iterable[str]) -> Column:
    """A literal array<string>, also when empty."""
    return constant(list(values), "array<string>")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_blank(c: Column) -> Column:
    """``strip(c) == ""``, known at the first character that is no white space."""
    return ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def after_first(c: Column, mark: str) -> Column:
    """Text after the first ``mark``; the whole text when it has none."""
    at = F.instr(c, mark)
    return F.when(at > 0, c.substr(at + len(mark), F.length(c))).otherwise(c)


def before_first(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def any_suffix(host: Column, suffixes: Column, dot_boundary: bool = True) -> Column:
    """Whether ``host`` is, or ends in, one of the suffixes (theta match on a short array)."""
    if dot_boundary:
        return F.exists(suffixes, lambda s: (host == s) | host.endswith(F.concat(F.lit("."), s)))
    return F.exists(suffixes, lambda s: host.endswith(s))


def map_lookup(mapping: dict, key: Column) -> Column:
    """Value of a small fixed mapping, NULL for keys it lacks."""
    kind = {str: "string", int: "int", float: "double"}[type(next(iter(mapping.values())))]
    return F.try_element_at(constant(mapping, f"map<string,{kind}>"), key)


def spread_nulls(rows: DataFrame, key: Column) -> Column:
    """A join key whose NULLs become many values that match nothing.

    A left join keeps all rows without a key; under one NULL they would all meet in one task. Only
    rows without a key pay for the hash.
    """
    hashed = [F.col(f"`{name}`") for name, kind in rows.dtypes if "map<" not in kind]
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*hashed), F.lit(4096)).cast("string")))

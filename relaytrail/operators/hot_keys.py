"""Joins on keys of which one may be in a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Fewer than this many keys can each be in more than one ``SHARE``-th of the rows.
SHARE = 1024


def join_popular(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` with the facts of their key; ``weight`` of a fact is the number of its rows.

    Keys in more than one ``SHARE``-th of the rows are fewer than ``SHARE``, so their facts are sent
    to the rows; the others meet in a shuffle in which no key is large. Store ``facts``: it is read
    three times.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    popular = facts.where(F.col(weight) * SHARE > total)
    some = rows.join(F.broadcast(popular), keys)
    rest = rows.join(F.broadcast(popular.select(*keys)), keys, "left_anti")
    return some.unionByName(rest.join(facts.where(F.col(weight) * SHARE <= total), keys, how))

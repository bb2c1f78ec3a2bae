"""Tenancy as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def visible_rows(rows: DataFrame, memberships: DataFrame, user_id) -> DataFrame:
    """Rows of the organisations a user belongs to."""
    orgs = memberships.where(F.col("user_id") == user_id).select("org_id").distinct()
    return rows.join(orgs, "org_id", "left_semi")


def visible_counts(rows: DataFrame, memberships: DataFrame) -> DataFrame:
    """How many rows every user may see; rows are counted per organisation before the join."""
    per_org = rows.groupBy("org_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        memberships.select("user_id", "org_id").distinct().join(per_org, "org_id")
        .groupBy("user_id").agg(F.sum("n").alias("visible_rows"))
    )


def colleagues(memberships: DataFrame, user_id) -> DataFrame:
    """Users who share an organisation with a user (the user included)."""
    orgs = memberships.where(F.col("user_id") == user_id).select("org_id").distinct()
    return memberships.join(orgs, "org_id", "left_semi").select("user_id").distinct()

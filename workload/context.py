"""What queries share within a session: the landed corpus and its analysed table."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ByteType, DecimalType, FloatType, IntegerType, ShortType,
)

from relaytrail.operators.durable import durable_table
from relaytrail.plans.analyse import analyse_messages
from relaytrail.sources.messages import accepted, acquire
from workload.mail_view import raw_messages

_WIDE = {
    ByteType: "long", ShortType: "long", IntegerType: "long", FloatType: "double",
    DecimalType: "double",
}


def plain(df: DataFrame) -> DataFrame:
    """Integers as long and fractions as double, so results compare across engines."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast(_WIDE[type(f.dataType)]).alias(f.name)
            if type(f.dataType) in _WIDE
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


class Context:
    """Tables of one scale factor in one session."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._shared: dict[str, DataFrame] = {}
        self.ingested = None

    def shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table several queries use, written on first use."""
        if name not in self._shared:
            self._shared[name] = durable_table(build(), name)
        return self._shared[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        """Landed messages, written once as a real collector would."""
        return durable_table(raw_messages(self.spark, self.sf_dir), "raw_messages")

    @cached_property
    def analysed(self) -> DataFrame:
        """Scored messages, written once; read queries prune its columns."""
        return self.by_file(self.raw, lambda: analyse_messages(accepted(acquire(self.raw))), "analysed")

    def by_file(self, source: DataFrame, build: Callable[[], DataFrame], name: str) -> DataFrame:
        """A table made with a task for every file of a stored one.

        Files are read in parts of so many bytes, but here the work is on messages.
        """
        setting, conf = "spark.sql.files.minPartitionNum", self.spark.conf
        before = conf.get(setting, None)
        conf.set(setting, str(max(1, len(source.inputFiles()))))
        try:
            return durable_table(build(), name)
        finally:
            conf.unset(setting) if before is None else conf.set(setting, before)

    @cached_property
    def indicators(self) -> DataFrame:
        from relaytrail.operators.indicators import message_indicators

        return self.by_file(self.analysed, lambda: message_indicators(self.analysed, "org_id", "case_id", "k"), "indicators")

    @cached_property
    def dna(self) -> DataFrame:
        from relaytrail.operators.fingerprint import fingerprint

        return self.by_file(self.analysed, lambda: fingerprint(self.analysed, "org_id", "case_id", "k"), "fingerprints")

    @cached_property
    def links(self) -> tuple[DataFrame, DataFrame]:
        """(distinct forms, links between them); those are many and are not stored."""
        from relaytrail.operators.linkage import copy_links, form_links

        return self.forms, form_links(self.forms).unionByName(copy_links(self.forms))

    @cached_property
    def forms(self) -> DataFrame:
        from relaytrail.operators.linkage import distinct_forms

        return durable_table(distinct_forms(self.dna), "forms")

    def deciding_links(self, strongest: int) -> DataFrame:
        """The strongest links of every form and those that join components, copies included."""
        from relaytrail.operators.linkage import copy_links, form_links

        return self.shared(f"deciding_links_{strongest}", lambda: form_links(self.forms, strongest=strongest).unionByName(copy_links(self.forms)))

    @cached_property
    def members(self) -> DataFrame:
        from relaytrail.operators.campaign import campaign_members

        return durable_table(campaign_members(self.dna, self.deciding_links(1), self.forms), "members")

    @cached_property
    def chain(self) -> DataFrame:
        """Evidence chains over ``events``: one chain per user, every row an entry."""
        from relaytrail.operators.evidence import build_chain

        events = self.table("events").select(
            F.lit("org0").alias("org_id"),
            F.col("user_id").cast("string").alias("case_id"),
            F.col("ts").alias("ts_utc"),
            F.concat(F.lit("service:"), F.col("event_type")).alias("actor"),
            F.col("event_type").alias("action"),
            F.sha2("props", 256).alias("payload_hash"),
            F.struct("ts", "event_id").alias("ord"),
        )
        return durable_table(build_chain(events), "chain")


_contexts: dict[tuple[str, str], Context] = {}


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _contexts:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        _contexts[key] = Context(spark, sf_dir.rstrip("/"))
    return _contexts[key]

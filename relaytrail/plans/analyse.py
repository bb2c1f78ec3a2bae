"""From raw messages to scored messages: one narrow job, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relaytrail.config import AnalysisConfig
from relaytrail.functions.core import strings
from relaytrail.operators.auth import evaluate_authentication
from relaytrail.operators.hops import received_hops, reconstruct_origin
from relaytrail.operators.parse import parse_messages
from relaytrail.operators.rules import apply_rules
from relaytrail.operators.score import score_findings

CONFIG_COLUMNS = ("protected_domains", "protected_identities", "trusted_authserv")


def with_org_config(
    messages: DataFrame, config: AnalysisConfig, org_config: DataFrame | None = None
) -> DataFrame:
    """Attach what each organisation protects and trusts; defaults where it says nothing."""
    defaults = {name: strings(getattr(config, name)) for name in CONFIG_COLUMNS}
    if org_config is None:
        return messages.withColumns(defaults)
    joined = messages.join(org_config.select("org_id", *CONFIG_COLUMNS), "org_id", "left")
    return joined.withColumns(
        {name: F.coalesce(F.col(name), value) for name, value in defaults.items()}
    )


def analyse_messages(
    messages: DataFrame,
    config: AnalysisConfig = AnalysisConfig(),
    org_config: DataFrame | None = None,
) -> DataFrame:
    """Parse, trace, authenticate, apply rules and score; works on batches and streams."""
    parsed = parse_messages(with_org_config(messages, config, org_config))
    hopped = parsed.withColumn("hops", received_hops(F.col("headers")))
    authenticated = evaluate_authentication(hopped)
    traced = reconstruct_origin(authenticated, config, F.col("forged_pass_detected"))
    ruled = apply_rules(traced, config)
    return score_findings(ruled, strings(config.evaluated_groups))

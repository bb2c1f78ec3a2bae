"""Settings of an analysis run."""

from __future__ import annotations

from dataclasses import dataclass, field

from relaytrail import fixed_values as fv


@dataclass(frozen=True)
class AnalysisConfig:
    """What an organisation calls its own and whom it trusts.

    Lists are short and end up as literals in the plan. Per-organisation values come from an
    ``org_config`` table instead (``plans.analyse.with_org_config``).
    """

    protected_domains: tuple[str, ...] = ("northbank.test",)
    protected_identities: tuple[str, ...] = (
        "Mara Okafor", "Chief Executive Officer", "CEO", "CFO",
    )
    trusted_authserv: tuple[str, ...] = (
        "northbank.test", "outlook.com", "protection.outlook.com", "google.com",
    )
    forwarders: tuple[str, ...] = ()
    public_suffixes: tuple[str, ...] = (
        "com", "net", "org", "test", "example", "invalid", "uk", "co.uk", "org.uk", "ac.uk",
        "gov.uk", "au", "com.au", "net.au", "org.au", "in", "co.in", "de", "fr", "es", "io",
        "me", "xyz", "co",
    )
    #: False reproduces plain ``endswith`` matching of hosts, where ``evilnorthbank.test``
    #: counts as internal; True requires a label boundary.
    label_boundary: bool = True
    evaluated_groups: tuple[str, ...] = field(default=fv.OFFLINE_GROUPS)

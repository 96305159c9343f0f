"""All inventory checks of a fleet's scans, as findings and as alerts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inventory as iv
from ..operators.alerts import create_security_alerts


@dataclass(frozen=True)
class ScanSettings:
    """What a site trusts and watches."""

    suspicious_ouis: Sequence[str] = ()
    suspicious_ssids: Sequence[str] = ()
    multi_ssid_threshold: int = 3
    allowed_adapters: Sequence[str] = ()
    probe_url: str = ""
    probe_text: str = ""


def scan_findings(associations: DataFrame, networks: DataFrame, adapters: DataFrame, ip_configs: DataFrame,
                  trusted: DataFrame, registry: DataFrame, probes: DataFrame | None = None,
                  settings: ScanSettings = ScanSettings()) -> DataFrame:
    nets = iv.enrich_vendor(networks, registry, settings.suspicious_ouis)
    checks = [
        iv.usb_gadget_findings(adapters, ip_configs, settings.allowed_adapters),
        iv.evil_twin_findings(associations, nets, trusted),
        iv.suspicious_oui(nets),
        iv.multi_ssid_ap(nets, associations, settings.multi_ssid_threshold),
    ]
    if settings.suspicious_ssids:
        checks.append(iv.suspicious_ssid(nets, settings.suspicious_ssids))
    if probes is not None:
        checks.append(iv.captive_portal_findings(probes, trusted, settings.probe_url, settings.probe_text))
    return iv.pivot_findings(checks)


def scan_alerts(findings: DataFrame, gap: int = 300) -> DataFrame:
    """Deduplicated security alerts per host."""
    events = iv.finding_to_alert(findings).withColumn("t", F.col("scan_ts"))
    return create_security_alerts(events, gap, ["host_id"], ["title"])

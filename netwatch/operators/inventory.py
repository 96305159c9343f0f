"""Checks over host inventory: nearby networks, associations, adapters and connectivity probes.

Every table is keyed by (host_id, scan_ts); all joins carry both keys, so a fleet's scans spread
over tasks. Findings share one set of columns (see ``FINDING``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import contains_any, lookup

SCAN = ["host_id", "scan_ts"]
FINDING = [*SCAN, "category", "severity", "title", "advice", "confidence", "enforceable", "detector",
           "ssid", "bssid", "adapter_name", "evidence"]


def normalize_bssid(value: Column) -> Column:
    """Lower-case, colon-separated, two digits per part; other shapes stay as they are."""
    text = F.replace(F.lower(F.trim(value)), F.lit("-"), F.lit(":"))
    parts = F.transform(F.filter(F.split(text, ":"), lambda p: p != ""),
                        lambda p: F.when(F.length(p) < 2, F.lpad(p, 2, "0")).otherwise(p))
    return F.when(F.size(parts) == 6, F.array_join(parts, ":")).otherwise(text)


def oui_of(mac: Column) -> Column:
    return F.substring(F.upper(F.regexp_replace(mac, "[^0-9A-Fa-f]", "")), 1, 6)


def parse_vendor_registry(lines: DataFrame) -> DataFrame:
    """(oui, vendor) from registry text: ``001337 Name`` or ``00-13-37   (hex)   Name`` lines."""
    text = F.rtrim(F.col("value"))
    plain, dashed = r"^([0-9A-Fa-f]{6})\s+(.+)$", r"^([0-9A-Fa-f]{2}-[0-9A-Fa-f]{2}-[0-9A-Fa-f]{2})\s+\(hex\)\s+(.+)$"
    is_plain = text.rlike(plain) & ~text.contains("(hex)") & ~text.contains("(base 16)")
    parsed = lines.select(
        F.monotonically_increasing_id().alias("_line"),
        F.when(is_plain, F.upper(F.regexp_extract(text, plain, 1))).when(
            text.rlike(dashed), F.upper(F.replace(F.regexp_extract(text, dashed, 1), F.lit("-"), F.lit("")))
        ).alias("oui"),
        F.trim(F.when(is_plain, F.regexp_extract(text, plain, 2)).otherwise(
            F.regexp_extract(text, dashed, 2))).alias("vendor"))
    return parsed.where("oui IS NOT NULL").groupBy("oui").agg(
        F.max_by("vendor", "_line").alias("vendor"))


def enrich_vendor(networks: DataFrame, registry: DataFrame, suspicious_ouis: Sequence[str] = ()) -> DataFrame:
    """Vendor of each access point, and whether its prefix is on the watch list.

    The registry is left to AQE, which broadcasts it when its measured size allows.
    """
    watch = sorted({o for o in ("".join(c for c in x if c in "0123456789abcdefABCDEF").upper()[:6]
                                for x in suspicious_ouis) if o})
    rows = networks.withColumn("oui", oui_of(F.col("bssid")))
    return rows.join(registry, "oui", "left").withColumns({
        "vendor": F.when(F.length("oui") == 6, F.col("vendor")).otherwise(F.lit(None)),
        "wireless_suspicious_oui": F.col("oui").isin(watch) if watch else F.lit(False),
    }).fillna("Unknown", ["vendor"])


def _finding(df: DataFrame, category, severity, title, advice, confidence, enforceable=False,
             detector=None, ssid=None, bssid=None, adapter_name=None, evidence=None) -> DataFrame:
    values = {
        "category": category, "severity": severity, "title": title, "advice": advice,
        "confidence": confidence, "enforceable": enforceable, "detector": detector, "ssid": ssid,
        "bssid": bssid, "adapter_name": adapter_name, "evidence": evidence,
    }
    kinds = {"confidence": "double", "enforceable": "boolean"}
    return df.select(*SCAN, *[
        (v if isinstance(v, Column) else F.lit(v)).cast(kinds.get(n, "string")).alias(n)
        for n, v in values.items()])


def suspicious_oui(networks: DataFrame) -> DataFrame:
    """Watched vendor prefixes among enriched networks, one finding per access point and scan."""
    hits = networks.where("wireless_suspicious_oui").groupBy(*SCAN, "bssid").agg(
        F.min(F.struct("ssid", "oui", "vendor")).alias("n"))
    return _finding(
        hits, "wireless_suspicious_access_point", "warning",
        "Access point matches monitored device OUI", "Compare with the expected router inventory.",
        0.62, detector="enterprise_wireless", ssid=F.col("n.ssid"), bssid=F.col("bssid"),
        evidence=F.concat_ws(" ", F.concat(F.lit("oui="), F.col("n.oui")),
                             F.concat(F.lit("vendor="), F.col("n.vendor"))))


def suspicious_ssid(networks: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Network names containing a watched pattern (the first that matches), case-insensitive."""
    cleaned = [p.strip().lower() for p in patterns if p.strip()]
    match = F.coalesce(*[F.when(F.lower("ssid").contains(p), F.lit(p)) for p in cleaned], F.lit(None))
    hits = networks.withColumn("matched", match).where("matched IS NOT NULL").dropDuplicates(
        [*SCAN, "ssid", "bssid"])
    return _finding(
        hits, "wireless_suspicious_ssid", "warning", "Suspicious wireless network name observed",
        "Do not connect unless its ownership is verified.", 0.58, detector="enterprise_wireless",
        ssid=F.col("ssid"), bssid=F.col("bssid"),
        evidence=F.concat(F.lit("pattern="), F.col("matched")))


def multi_ssid_ap(networks: DataFrame, associations: DataFrame, threshold: int = 3) -> DataFrame:
    """Access points that advertise several names; worse when the host is connected to one."""
    seen = networks.where((F.col("bssid") != "") & (F.trim("ssid") != ""))
    counted = seen.groupBy(*SCAN, "bssid").agg(
        F.sort_array(F.collect_set(F.trim("ssid"))).alias("ssids"))
    current = associations.select(*SCAN, F.lower("bssid").alias("_current")).where("_current <> ''")
    hits = counted.where(F.size("ssids") >= max(2, threshold)).join(current, SCAN, "left")
    connected = F.coalesce(F.lower("bssid") == F.col("_current"), F.lit(False))
    return _finding(
        hits, "wireless_multi_ssid_access_point", F.when(connected, "high").otherwise("warning"),
        "One access point advertises multiple SSIDs", "Verify the access point before trusting its networks.",
        F.when(connected, 0.76).otherwise(0.6), detector="enterprise_wireless", bssid=F.col("bssid"),
        evidence=F.array_join("ssids", ","))


def usb_gadget_findings(adapters: DataFrame, ip_configs: DataFrame,
                        allowed_keywords: Sequence[str] = ()) -> DataFrame:
    """USB network adapters that look like attack gadgets."""
    allowed = [k.strip().lower() for k in allowed_keywords if k.strip()]
    text = F.lower(F.concat_ws(" ", "Name", "NetConnectionID", "Description", "PNPDeviceID", "ServiceName"))
    alias = F.coalesce(F.nullif("NetConnectionID", F.lit("")), F.nullif("Name", F.lit("")), F.lit(""))
    usb = (
        adapters.withColumns({"_text": text, "_alias": alias, "_key": F.lower(alias)})
        .where(F.col("_text").contains("usb") & ~contains_any(F.col("_text"), allowed)))
    configs = ip_configs.groupBy(*SCAN, F.lower("InterfaceAlias").alias("_key")).agg(
        F.max(F.lower("ip_text")).alias("_ip"))
    rows = usb.join(configs, [*SCAN, "_key"], "left")
    gadget_net = F.coalesce(contains_any(F.col("_ip"), K.GADGET_NETWORKS), F.lit(False))
    network = contains_any(F.col("_text"), K.USB_NETWORK_KEYWORDS)
    wireless = contains_any(F.col("_text"), K.WIRELESS_KEYWORDS)
    rows = rows.withColumn("_rule", F.when(gadget_net, "gadget").when(network & ~wireless, "ethernet")
                           .when(network, "review")).where("_rule IS NOT NULL")

    def by_rule(gadget, ethernet, review) -> Column:
        return (F.when(F.col("_rule") == "gadget", F.lit(gadget))
                .when(F.col("_rule") == "ethernet", F.lit(ethernet)).otherwise(F.lit(review)))

    return _finding(
        rows, by_rule("rogue_usb_network_gadget", "rogue_usb_network_gadget", "usb_network_adapter_review"),
        by_rule("critical", "high", "medium"),
        by_rule("Suspicious USB network gadget with Pineapple-like network",
                "Suspicious USB Ethernet/RNDIS adapter detected", "USB network adapter needs review"),
        by_rule("Unplug the device and inspect USB hardware.",
                "Unplug and disable the adapter if it was not expected.",
                "Confirm the adapter or add it to the trusted list."),
        by_rule(0.92, 0.82, 0.62), by_rule(True, True, False), adapter_name=F.col("_alias"),
        evidence=F.col("_ip"))


def _trusted(trusted: DataFrame) -> DataFrame:
    """Trusted networks (ssid, bssid or null) as one row per name with its known access points."""
    return trusted.groupBy(F.col("ssid").alias("ssid")).agg(
        F.collect_set(normalize_bssid(F.nullif("bssid", F.lit("")))).alias("_known"),
        F.lit(True).alias("_trusted"))


def evil_twin_findings(associations: DataFrame, networks: DataFrame, trusted: DataFrame) -> DataFrame:
    """Signs that a connected network imitates a trusted one."""
    joined = (
        associations.select(*SCAN, F.trim("ssid").alias("ssid"), normalize_bssid(F.col("bssid")).alias("bssid"),
                            F.lower(F.coalesce("authentication", F.lit(""))).alias("auth"))
        .where("ssid <> ''").join(_trusted(trusted), "ssid", "left")
        .withColumn("_trusted", F.coalesce("_trusted", F.lit(False))))
    open_auth = _finding(
        joined.where(F.col("_trusted") & F.col("auth").isin("open", "none", "")),
        "evil_twin_wifi", "critical", "Trusted SSID is using open authentication",
        "Disconnect and forget the network profile.", 0.93, True, ssid=F.col("ssid"),
        bssid=F.col("bssid"), evidence=F.concat(F.lit("authentication="), F.col("auth")))
    unknown_ap = _finding(
        joined.where((F.size("_known") > 0) & (F.col("bssid") != "")
                     & ~F.array_contains("_known", F.col("bssid"))),
        "evil_twin_wifi", "high", "Connected BSSID is not in trusted list",
        "Disconnect and verify the access point's address.", 0.87, True, ssid=F.col("ssid"),
        bssid=F.col("bssid"), evidence=F.array_join(F.sort_array("_known"), ","))
    profile = F.concat_ws("/", F.lower(F.coalesce("authentication", F.lit(""))),
                          F.lower(F.coalesce("encryption", F.lit(""))))
    profiles = networks.groupBy(*SCAN, "ssid").agg(
        F.sort_array(F.collect_set(profile)).alias("_profiles")).where(F.size("_profiles") > 1)
    conflicts = joined.join(profiles, [*SCAN, "ssid"])
    conflicting = _finding(
        conflicts, "evil_twin_wifi", F.when(F.col("_trusted"), "high").otherwise("warning"),
        "Same SSID advertised with conflicting security",
        "Enter no credentials; reconnect only after checking the access point.", 0.78, F.col("_trusted"),
        ssid=F.col("ssid"), evidence=F.array_join("_profiles", ","))
    return pivot_findings([open_auth, unknown_ap, conflicting])


def captive_portal_findings(probes: DataFrame, trusted: DataFrame, expected_url: str,
                            expected_text: str) -> DataFrame:
    """Connectivity probes that were redirected or rewritten."""
    moved = F.rtrim(F.col("final_url"), F.lit("/")) != expected_url.rstrip("/")
    changed = ~F.coalesce(F.col("body").contains(expected_text), F.lit(False))
    hits = probes.where(F.col("status").isin(K.REDIRECT_STATUSES) | moved | changed).join(
        _trusted(trusted).select("ssid", "_trusted"), "ssid", "left")
    known = F.coalesce("_trusted", F.lit(False))
    return _finding(
        hits, "captive_portal_interception", F.when(known, "high").otherwise("warning"),
        "Captive portal or HTTP interception detected", "Enter no credentials until the network is verified.",
        F.when(known, 0.82).otherwise(0.66), known, ssid=F.col("ssid"),
        bssid=normalize_bssid(F.col("bssid")),
        evidence=F.concat_ws(" ", F.col("status").cast("string"), "final_url"))


def pivot_findings(checks: Sequence[DataFrame]) -> DataFrame:
    """The findings of all checks in one table."""
    return reduce(lambda a, b: a.unionByName(b), checks)


def inventory_rank(severity: Column, default: int) -> Column:
    return lookup(K.INVENTORY_SEVERITY_RANK, severity, F.lit(default))


def finding_to_alert(findings: DataFrame) -> DataFrame:
    """Security events ready for alert creation."""
    parts = [F.nullif(c, F.lit("")) for c in ("ssid", "bssid", "adapter_name")]
    wireless = F.coalesce(F.col("detector") == "enterprise_wireless", F.lit(False))
    return findings.withColumns({
        "is_anomaly": F.lit(True),
        "attack_type": F.col("category"),
        "anomaly_score": F.least(F.lit(1.0), F.lit(0.45) + inventory_rank(F.col("severity"), 3) * 0.08),
        "dedup_key": F.lower(F.concat_ws(":", "category", "title", *parts)),
        "detection_sources": F.when(wireless, F.array(
            F.lit("local_threat_guard"), F.lit("enterprise_wireless_analyzer")))
        .otherwise(F.array(F.lit("local_threat_guard"))),
    })


def highest_severity(findings: DataFrame) -> DataFrame:
    """Worst severity per scan."""
    return findings.groupBy(*SCAN).agg(
        F.max_by("severity", inventory_rank(F.col("severity"), 0)).alias("highest_severity"),
        F.count(F.lit(1)).alias("findings"))

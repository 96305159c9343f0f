"""From detections to alerts: deduplication, limits, lifecycle, correlation, escalation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.columns import normalise_severity, round_binary
from ..session import written
from .ordered import with_overlap
from .rules import expert_lookup, fixed
from .sequential import emissions, fold_sessions

# Seconds without a repeat, cooldown, alerts per minute.
DEDUP_SECONDS = 300
COOLDOWN_SECONDS = 300
MAX_PER_MINUTE = 100


def alert_title(attack_type: Column) -> Column:
    """Words in title case, known protocol acronyms in capitals."""
    words = F.filter(F.split(F.replace(attack_type, F.lit("_"), F.lit(" ")), r"\s+"), lambda w: w != "")
    acronyms = F.array(*[F.lit(a) for a in K.TITLE_ACRONYMS])
    return F.array_join(F.transform(words, lambda w: F.when(
        F.array_contains(acronyms, F.lower(w)), F.upper(w)).otherwise(F.initcap(w))), " ")


def alert_text(detections: DataFrame) -> DataFrame:
    """Title and description of a detection."""
    return detections.withColumns({
        "title": F.concat(F.lit("DDoS Attack Detected: "), alert_title(F.col("attack_type"))),
        "description": F.expr(
            "concat('A ', replace(attack_type, '_', ' '), ' attack has been detected with an anomaly "
            f"score of ', {fixed('anomaly_score', 2)}, '. Current packet rate: ', "
            f"{fixed('packet_rate', 0)}, ' pps.')"),
    })


def alert_id(keys: Sequence[str]) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *keys, F.col("t").cast("string")), 256), 1, 8)


def _emit(rows: DataFrame, keys: Sequence[str], ties: Sequence[str], gap: int,
          block_seconds: int) -> DataFrame:
    """The first row of each emitted second of each key.

    Those first rows are read three times, and what detects anomalies may be costly, so they are
    written to the shared folder once (this runs a job).
    """
    keys = list(keys)
    others = [c for c in rows.columns if c not in (*keys, "t")]
    firsts = written(rows.groupBy(*keys, "t").agg(
        F.min_by(F.struct(*others), F.struct(*ties)).alias("_row")), "alert-candidates")
    emitted = emissions(firsts.select(*keys, "t"), keys, "t", gap, block_seconds)
    alerts = firsts.join(emitted, [*keys, "t"], "left_semi").select(*keys, "t", "_row.*")
    return alerts.withColumn("alert_id", alert_id(keys))


def create_alerts(
    detections: DataFrame, gap: int = DEDUP_SECONDS, keys: Sequence[str] = ("sensor_id",),
    ties: Sequence[str] = (), block_seconds: int = 86400,
) -> DataFrame:
    """Alerts of anomalous detections, one per (type, severity) and quiet period.

    A repeat within ``gap`` seconds of the last alert with the same key is dropped; the period runs
    from that alert, not from the last repeat. ``t`` is the event second.
    """
    kind = F.coalesce("attack_type", F.lit(""))
    keyed = detections.where("is_anomaly").withColumn(
        "dedup_key", F.md5(F.concat(kind, F.lit(":"), F.coalesce("severity", F.lit("")))))
    return alert_fields(_emit(keyed, [*keys, "dedup_key"], list(ties) or ["t"], gap, block_seconds), keys)


def alert_fields(alerts: DataFrame, keys: Sequence[str] = ("sensor_id",)) -> DataFrame:
    """What an alert says besides its detection: text, technique, advice, status and interval."""
    if "alert_id" not in alerts.columns:
        alerts = alerts.withColumn("alert_id", alert_id(keys))
    # A detection's own interval and sources stay; the event second and the default source stand in where it has none.
    given = lambda name, default: (
        F.coalesce(F.col(name).cast("long"), default) if name in alerts.columns else default)
    return expert_lookup(alert_text(alerts)).withColumns({
        "severity": normalise_severity(F.col("severity")),
        "status": F.lit("active"),
        "recommended_response": F.col("mitigation"),
        "first_seen": given("first_seen", F.col("t")), "last_seen": given("last_seen", F.col("t")),
    }).drop("mitigation")


def create_security_alerts(
    events: DataFrame, gap: int = DEDUP_SECONDS, keys: Sequence[str] = ("sensor_id",),
    ties: Sequence[str] = (), block_seconds: int = 86400,
) -> DataFrame:
    """Alerts of inventory findings, deduplicated by (dedup key, type, severity, title). Events marked as no anomaly
    make none; a missing mark counts as anomaly."""
    parts = [F.coalesce(c, F.lit("")) for c in ("dedup_key", "attack_type", "severity", "title")]
    if "is_anomaly" in events.columns:
        events = events.where(F.coalesce("is_anomaly", F.lit(True)))
    keyed = events.withColumn(
        "security_key", F.md5(F.concat(F.lit("security:"), F.concat_ws(":", *parts))))
    alerts = _emit(keyed, [*keys, "security_key"], list(ties) or ["t"], gap, block_seconds)
    return alerts.withColumns({"severity": normalise_severity(F.col("severity")),
                               "status": F.lit("active")})


def rate_limit_alerts(
    alerts: DataFrame, max_per_minute: int = MAX_PER_MINUTE, cooldown: int = COOLDOWN_SECONDS,
    keys: Sequence[str] = ("sensor_id",), ties: Sequence[str] = ("alert_id",),
) -> DataFrame:
    """Add ``allowed``: per-type cooldown, then a token bucket per sensor.

    After a quiet period of ``cooldown`` (at least a minute) every cooldown has passed and the bucket
    is full, so such periods separate independent sessions.
    """
    per_second = max_per_minute / 60.0

    def start():
        return {"tokens": float(max_per_minute), "at": None, "last": {}}

    def step(state, row):
        now, kind = row["t"], row["attack_type"]
        last = state["last"].get(kind)
        if last is not None and now - last < cooldown:
            return (False,)
        if state["at"] is not None:
            state["tokens"] = min(max_per_minute, state["tokens"] + (now - state["at"]) * per_second)
        state["at"] = now
        if state["tokens"] < 1:
            return (False,)
        state["tokens"] -= 1
        state["last"][kind] = now
        return (True,)

    return fold_sessions(alerts, keys, "t", ties, max(cooldown, 60),
                         [T.StructField("allowed", T.BooleanType())], start, step, ["t", "attack_type"])


def alert_lifecycle(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Status of each alert after all acknowledge/resolve events.

    An alert can be acknowledged only while active and resolved only once, so the first resolve and
    the first acknowledge not after it decide.
    """
    acted = F.col("action") == "acknowledge"
    folded = events.groupBy("alert_id").agg(
        F.min(F.when(F.col("action") == "resolve", F.col("t"))).alias("resolved_at"),
        F.min(F.when(acted, F.struct("t", "user"))).alias("_ack"))
    counts = F.col("resolved_at").isNull() | (F.col("_ack.t") <= F.col("resolved_at"))
    return alerts.join(folded, "alert_id", "left").withColumns({
        "acknowledged_at": F.when(counts, F.col("_ack.t")),
        "acknowledged_by": F.when(counts, F.col("_ack.user")),
        "status": F.when(F.col("resolved_at").isNotNull(), "resolved")
        .when(F.col("_ack").isNotNull(), "acknowledged").otherwise("active"),
    }).drop("_ack")


def query_alerts(
    alerts: DataFrame, severity: str | None = None, status: str | None = None,
    source: str | None = None, active_only: bool = False, limit: int = 100,
    order: Sequence[str] = ("t",),
) -> DataFrame:
    """The newest alerts that match every given filter."""
    if active_only:
        alerts = alerts.where(F.col("status").isin("active", "acknowledged"))
    if severity:
        alerts = alerts.where(F.col("severity") == normalise_severity(F.lit(severity)))
    if status:
        alerts = alerts.where(F.col("status") == status)
    if source:
        alerts = alerts.where(F.exists("detection_sources", lambda s: F.lower(s) == source.lower()))
    return alerts.orderBy(*[F.desc(c) for c in order]).limit(limit)


def correlate_alerts(
    alerts: DataFrame, within: int = 60, max_age: int = 300, keys: Sequence[str] = ("sensor_id",),
    tie: str = "alert_id", sep: str | None = None,
) -> DataFrame:
    """Ids of earlier alerts of the same type less than ``within`` seconds before each alert, oldest first: an array, or
    with ``sep`` one text.

    Time is cut into blocks as long as the look-back, which overlap by it; no pairs are shuffled. The ids of a block are
    listed once in order, and each alert takes its own stretch of that list; as text that is one copy of bytes, whatever
    the number of ids. The result has an id a pair: it is meant for deduplicated alerts, of which a type has a handful per
    minute. Alerts without an id are in no list.
    """
    reach = min(within, max_age) - 1
    block = W.partitionBy(*keys, "attack_type", "_block")
    inside = block.orderBy("t", tie)
    whole = inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # Places in the list, in ids or in bytes. Of rows that share time and id (peers), none is earlier than another.
    if sep is None:
        size, ids = F.lit(1), F.collect_list(tie)
    else:
        size, ids = F.octet_length(tie) + len(sep.encode()), F.listagg(F.col(tie).cast("binary"), F.lit(sep.encode()))
    size = F.when(F.col(tie).isNotNull(), size)
    peers = F.count(tie).over(inside) - F.rank().over(inside) + 1 + F.count_if(F.col(tie).isNull()).over(inside)
    upto = F.coalesce(F.sum(size).over(inside), F.lit(0))
    past = F.coalesce(F.sum(size).over(block.orderBy("t").rangeBetween(W.unboundedPreceding, -reach - 1)), F.lit(0))
    placed = (
        with_overlap(alerts, "t", reach, max(reach, 1))
        .withColumn("_upto", (upto - F.coalesce(size * peers, F.lit(0))).cast("int"))
        .withColumn("_past", past.cast("int"))
        .withColumn("_ids", ids.over(whole)).where("_own"))
    if sep is None:
        found = F.slice("_ids", F.col("_past") + 1, F.col("_upto") - F.col("_past"))
    else:
        found = F.coalesce(F.substring("_ids", F.col("_past") + 1, F.greatest(
            F.col("_upto") - F.col("_past") - len(sep.encode()), F.lit(0))).cast("string"), F.lit(""))
    return placed.withColumn("correlated_alerts", found).drop("_upto", "_past", "_ids", "_block", "_own")


def escalation_state(alerts: DataFrame, as_of: Column | int) -> DataFrame:
    """Escalation level of each unresolved alert by its age."""
    age = as_of - F.col("t")
    level, notify = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.array(F.lit("")))
    for name, begins, notifiers in reversed(K.ESCALATION_LEVELS):
        level = level.when(age >= begins, F.lit(name))
        notify = notify.when(age >= begins, F.array(*[F.lit(n) for n in notifiers]))
    return alerts.where((F.col("status") != "resolved") & (age >= 0)).withColumns(
        {"age_seconds": age, "level": level, "notifiers": notify})


def display_alert(alerts: DataFrame) -> DataFrame:
    """The form shown to users: shortened lists, rounded numbers."""
    have = set(alerts.columns)
    cuts = {"source_ips": 10, "source_ports": 20, "target_ports": 20}
    digits = {"anomaly_score": 4, "confidence": 4, "packet_rate": 0, "byte_rate": 0}
    return alerts.withColumns(
        {c: F.slice(c, 1, n) for c, n in cuts.items() if c in have}
        | {c: F.expr(round_binary(c, n)) for c, n in digits.items() if c in have})


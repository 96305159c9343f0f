"""Reports over alerts, detections, predictions and errors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..ml.quantiles import exact_quantiles
from .ordered import BLOCK_SECONDS, running


def severity_breakdown(alerts: DataFrame) -> DataFrame:
    """Alerts per severity; the four standard severities always appear."""
    levels = alerts.sparkSession.createDataFrame(
        [(s,) for s in K.REPORT_SEVERITIES], "severity string").withColumn("n", F.lit(0).cast("long"))
    counts = alerts.groupBy(F.coalesce("severity", F.lit("info")).alias("severity")).agg(
        F.count(F.lit(1)).alias("n"))
    totals = counts.unionByName(levels).groupBy("severity").agg(F.sum("n").alias("incidents"))
    return totals.withColumn("total_incidents", F.sum("incidents").over(W.partitionBy(F.lit(1))))


def response_times(alerts: DataFrame, target_seconds: int = 300) -> DataFrame:
    """Mean time to acknowledge and to resolve, and the share acknowledged within the target."""
    ack = F.col("acknowledged_at") - F.col("t")
    return alerts.agg(
        F.count(F.lit(1)).alias("incidents"), F.avg(ack).alias("avg_ack_seconds"),
        F.avg(F.col("resolved_at") - F.col("t")).alias("avg_resolve_seconds"),
        (F.count_if(ack <= target_seconds) * 100.0 / F.nullif(F.count(ack), F.lit(0)))
        .alias("sla_met_pct"))


def alert_stats(lifecycle: DataFrame, detections: DataFrame) -> DataFrame:
    """Created, deduplicated and active alerts."""
    created = lifecycle.agg(F.count(F.lit(1)).alias("alerts_created"),
                            F.count_if(F.col("status") == "active").alias("active_alerts"))
    seen = detections.where("is_anomaly").agg(F.count(F.lit(1)).alias("_seen"))
    both = created.unionByName(seen, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("alerts_created", "active_alerts", "_seen")]).select(
        "alerts_created", "active_alerts", F.col("alerts_created").alias("total_alerts"),
        (F.col("_seen") - F.col("alerts_created")).alias("alerts_deduplicated"))


def detection_stats(detections: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("sec",),
                    recent: int = 50) -> DataFrame:
    """Anomaly count and rate, and the mean of the most recent scores."""
    keys = list(keys)
    totals = detections.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("detection_count"), F.count_if("is_anomaly").alias("anomaly_count"))
    newest = [F.desc(c) for c in order]
    if keys:
        last = (detections.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*newest)))
                .where(F.col("_rn") <= recent))
    else:
        last = detections.orderBy(*newest).limit(recent)
    means = last.groupBy(*keys).agg(F.round(F.avg("anomaly_score"), 4).alias("avg_recent_score"))
    both = totals.unionByName(means, allowMissingColumns=True).groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("detection_count", "anomaly_count", "avg_recent_score")])
    return both.withColumn("anomaly_rate_pct", F.round(
        F.col("anomaly_count") / F.greatest("detection_count", F.lit(1)) * 100, 2))


def pipeline_counters(windows: DataFrame, counters: dict[str, Column], keys: Sequence[str] = ("sensor_id",),
                      seconds: str = "sec", ties: Sequence[str] = (),
                      block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Counters accumulated over time per sensor, one row per window."""
    return running(windows, keys, seconds, ties, sums=counters, block_seconds=block_seconds).select(
        *keys, seconds, *ties, *counters)


def confusion(predictions: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Row counts per (label, prediction): classes squared rows, whatever the input size."""
    return predictions.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def binary_metrics(predictions: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of 0/1 predictions."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    counts = predictions.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                             F.count_if(y & ~p).alias("fn"))
    with_pr = counts.withColumns({
        "precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)),
        "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))})
    return with_pr.withColumn("f1", F.lit(2.0) * F.col("precision") * F.col("recall")
                              / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-6)))


def classification_metrics(predictions: DataFrame, label: str = "label",
                           pred: str = "prediction") -> DataFrame:
    """Accuracy, balanced accuracy and support-weighted precision, recall and F1."""
    cells = confusion(predictions, label, pred)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    by_label = cells.groupBy("label").agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    by_pred = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    per = by_label.join(by_pred, "label", "full").select(
        "label", F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"))
    per = per.withColumns({
        "p": F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0),
        "r": F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)})
    f1 = F.when(F.col("p") + F.col("r") > 0,
                F.lit(2.0) * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    total = F.sum("support")

    def weighted(c: Column) -> Column:
        return F.sum(c * F.col("support")) / total

    return per.agg(
        total.alias("rows"), (F.sum("hits") / total).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("r"))).alias("balanced_accuracy"),
        weighted(F.col("p")).alias("precision"), weighted(F.col("r")).alias("recall"),
        weighted(f1).alias("f1_score"))


def exact_percentiles(rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                      margin: float = 1e-4) -> DataFrame:
    """Exact percentiles (linear interpolation) without gathering a group in one task.

    A sketch proposes cut points just below and just above each percentile. Rows are counted between
    cut points; only the intervals that hold a wanted rank are kept (about ``2 * margin`` of the
    rows) and equal values inside them are merged before ranking. The sketch only steers the work:
    if it is off, a wider interval is ranked and the result is the same.
    """
    keys = list(keys)
    data = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    near = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)})
    # One small row per group; AQE broadcasts it once its size is known.
    cuts = data.groupBy(*keys).agg(
        F.percentile_approx("v", near, int(10 / margin)).alias("_cuts"),
        F.count(F.lit(1)).alias("_n"))
    below = reduce(lambda a, b: a + b, [
        (F.col("_cuts")[i] < F.col("v")).cast("int") for i in range(len(near))])
    data = data.join(cuts, keys).withColumn("_cell", below).drop("_cuts")
    at = [*keys, "_cell"]
    cells = data.groupBy(*at).agg(F.count(F.lit(1)).alias("_m"), F.first("_n").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    wanted = F.array(*[
        F.struct(F.lit(p).alias("p"), (F.lit(p) * (F.col("_n") - 1)).alias("pos")) for p in probs])
    picked = (
        cells.withColumn("_first", F.coalesce(F.sum("_m").over(earlier), F.lit(0)))
        .withColumn("_w", F.filter(wanted, lambda w: (F.ceil(w["pos"]) >= F.col("_first"))
                                   & (F.floor(w["pos"]) < F.col("_first") + F.col("_m"))))
        .where(F.size("_w") > 0).select(*at, "_first", "_w"))
    inside = (
        data.join(picked, at).groupBy(*at, "v")
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_first").alias("_first"), F.first("_w").alias("_w")))
    upto = W.partitionBy(*at).orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = inside.withColumn("_end", F.col("_first") + F.sum("_c").over(upto)).withColumn(
        "_begin", F.col("_end") - F.col("_c"))
    hits = inside.withColumn("w", F.explode("_w"))
    ends = hits.groupBy(*keys, "w").agg(*[
        F.max(F.when((rank >= F.col("_begin")) & (rank < F.col("_end")), F.col("v"))).alias(name)
        for name, rank in [("_lo", F.floor("w.pos")), ("_hi", F.ceil("w.pos"))]])
    return ends.select(*keys, F.col("w.p").alias("p"), (
        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("w.pos") - F.floor("w.pos"))).alias("value"))


def error_distribution(errors: DataFrame, group: str = "is_attack", error: str = "error") -> DataFrame:
    """Mean, deviation and percentiles of the reconstruction error per class, and how well the
    classes separate: (attack median - normal p95) / normal deviation. Rows without a class take no part, nor does a
    class without errors; the percentiles ignore NaN. No row is shuffled."""
    attack = F.col(group).cast("boolean")
    parts = errors.select(F.when(attack, F.col(error)).alias("attack"), F.when(~attack, F.col(error)).alias("normal"))
    marks = exact_quantiles(parts, ["attack", "normal"], [0.5, 0.95, 0.97])
    spread = errors.where(attack.isNotNull()).groupBy(group).agg(
        F.avg(error).alias("mean"), F.stddev_pop(error).alias("std"), F.count(F.lit(1)).alias("n"))
    rows = spread.withColumns({
        name: F.when(attack, F.lit(high)).otherwise(F.lit(low)).cast("double")
        for name, high, low in zip(("p50", "p95", "p97"), marks["attack"], marks["normal"])}).where("p50 IS NOT NULL")
    whole = W.partitionBy(F.lit(1))  # two rows

    def of(flag: bool, name: str) -> Column:
        return F.max(F.when(F.col(group) == F.lit(flag), F.col(name))).over(whole)

    return rows.withColumn("separation", (of(True, "p50") - of(False, "p95"))
                           / F.greatest(of(False, "std"), F.lit(1e-6)))


def class_profile(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label, and how many are normal or attack traffic (attack is null without normal)."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    normal = F.sum(F.when(F.upper("label").isin(K.NORMAL_LABELS), F.col("n")).otherwise(0)).over(
        W.partitionBy(F.lit(1)))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    return counts.withColumns({
        "normal_rows": normal, "attack_rows": F.when(normal > 0, total - normal)})


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

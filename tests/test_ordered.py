import random
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netwatch.operators import alerts as al
from netwatch.operators import reports as rp
from netwatch.operators import response as rs
from netwatch.operators import timeseries as ts
from netwatch.operators.ordered import first_per_key, lagged, running
from netwatch.operators.sequential import emissions


def samples(n, seed=1, keys=3, span=4000):
    rng = random.Random(seed)
    return pd.DataFrame({"metric": [f"m{0 if rng.random() < 0.6 else rng.randrange(keys)}" for _ in range(n)],
                         "sec": [rng.randrange(span) for _ in range(n)], "sample_id": range(n),
                         "value": [float(rng.randrange(100)) for _ in range(n)]})


@pytest.mark.parametrize("block", [50, 3600])
def test_lag_and_running_across_blocks(spark, block):
    pdf = samples(500)
    df = spark.createDataFrame(pdf)
    got = lagged(df, ["metric"], "sec", ["sample_id"], {"p": F.col("value")}, block)
    got = running(got, ["metric"], "sec", ["sample_id"], {"s": F.col("value")}, {"m": F.col("value")}, block).toPandas()
    pdf = pdf.sort_values(["metric", "sec", "sample_id"])
    g = pdf.groupby("metric").value
    pdf = pdf.assign(p=g.shift(), s=g.cumsum(), m=g.cummax())
    got = got.sort_values(["metric", "sec", "sample_id"])
    for c in ("p", "s", "m"):
        np.testing.assert_allclose(got[c].to_numpy(float), pdf[c].to_numpy(float))


@pytest.mark.parametrize("block", [20, 60, 3600])
def test_emissions_equal_sequential_rule(spark, block):
    rng = random.Random(block)
    times = [("hot", t) for t in range(0, 3000) if rng.random() < 0.3]
    times += [(f"k{rng.randrange(20)}", rng.randrange(3000)) for _ in range(300)]
    got = {tuple(r) for r in emissions(spark.createDataFrame(times * 2, "k string, t long"), ["k"], "t", 20, block).collect()}
    want, last = set(), {}
    for k, t in sorted(set(times)):
        if k not in last or t - last[k] >= 20:
            last[k] = t
            want.add((k, t))
    assert got == want


def test_emissions_keep_groups_whole_over_many_partitions(spark):
    """As in large tables: blocks that several map tasks hold, and joins that turn into broadcast ones while they run."""
    rows = spark.range(0, 6000, numPartitions=4).selectExpr("concat('k', id % 5) AS k", "id * 37 % 500000 AS t")
    large = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "20KB"}
    for key, value in large.items():
        spark.conf.set(key, value)
    try:
        got = {tuple(r) for r in emissions(rows, ["k"], "t", 7200, 86400).collect()}
    finally:
        for key in large:
            spark.conf.unset(key)
    want, free = set(), {}
    for k, t in sorted({tuple(r) for r in rows.collect()}):
        if t >= free.get(k, 0):
            free[k] = t + 7200
            want.add((k, t))
    assert got == want


def test_alerts_are_deduplicated(spark):
    rows = [("s", t, True, "syn_flood", "critical", 0.9, 50000.0) for t in (0, 10, 299, 300, 301)]
    rows += [("s", 5, False, "syn_flood", "critical", 0.1, 1.0), ("s", 5, True, "udp_flood", "odd", 0.5, 1.0)]
    df = spark.createDataFrame(rows, "sensor_id string, t long, is_anomaly boolean, attack_type string, "
                               "severity string, anomaly_score double, packet_rate double")
    got = al.create_alerts(df).orderBy("t").collect()
    assert [(r.t, r.attack_type, r.severity) for r in got] == [
        (0, "syn_flood", "critical"), (5, "udp_flood", "warning"), (300, "syn_flood", "critical")]
    assert got[0].title == "DDoS Attack Detected: SYN Flood" and len(got[0].alert_id) == 8


def test_rate_limiter_equals_sequential_rule(spark):
    rng = random.Random(4)
    rows = [("s" + str(rng.randrange(2)), rng.randrange(6000), f"t{rng.randrange(30)}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "sensor_id string, t long, attack_type string, alert_id long")
    got = {r.alert_id: r.allowed for r in al.rate_limit_alerts(df, 5, 200).collect()}
    want, state = {}, {}
    for sensor, t, kind, i in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        s = state.setdefault(sensor, {"tokens": 5.0, "at": 0, "last": {}})
        if t - s["last"].get(kind, -10 ** 9) < 200:
            want[i] = False
            continue
        s["tokens"], s["at"] = min(5, s["tokens"] + (t - s["at"]) * 5 / 60), t
        want[i] = s["tokens"] >= 1
        if want[i]:
            s["tokens"] -= 1
            s["last"][kind] = t
    assert got == want and True in got.values() and False in got.values()


def test_block_budget_equals_sequential_rule(spark):
    rng = random.Random(5)
    rows = [("s", rng.randrange(3000), f"10.0.0.{rng.randrange(12)}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "sensor_id string, t long, target_ip string, action_id long")
    policy = rs.Policy(block_ttl_seconds=100, max_active_blocks=4, max_blocks_per_minute=2)
    got = {r.action_id: r.budget_rejection for r in rs.block_budget(df, policy).collect()}
    active, recent, want = {}, deque(), {}
    for _, t, ip, i in sorted(rows, key=lambda r: (r[1], r[3])):
        active = {a: e for a, e in active.items() if e > t}
        while recent and t - recent[0] >= 60:
            recent.popleft()
        want[i] = ("target IP is already blocked" if ip in active else
                   "maximum active block limit reached" if len(active) >= 4 else
                   "block rate limit exceeded" if len(recent) >= 2 else None)
        if want[i] is None:
            active[ip] = t + 100
            recent.append(t)
    assert got == want and len(set(got.values())) >= 3


def test_baseline_flags_only_the_outlier(spark):
    rows = [("rate", i, i, 5000.0) for i in range(100)] + [("rate", 100, 100, 5000.0), ("rate", 101, 101, 50000.0)]
    df = spark.createDataFrame(rows, "metric string, sec long, sample_id long, value double")
    got = {r.sample_id: r.is_anomalous for r in ts.baseline_anomaly(df).collect()}
    assert [i for i, bad in got.items() if bad] == [101]
    assert ts.baseline_snapshot(df.where("sec < 100")).head()["std"] == 0


def test_correlation(spark):
    rows = [("s", 100, "a1", "syn_flood"), ("s", 105, "a2", "syn_flood"), ("s", 106, "b1", "udp_flood"),
            ("s", 165, "a3", "syn_flood")]
    df = spark.createDataFrame(rows, "sensor_id string, t long, alert_id string, attack_type string")
    got = {r.alert_id: r.correlated_alerts for r in al.correlate_alerts(df).collect()}
    assert got == {"a1": [], "a2": ["a1"], "b1": [], "a3": []}


def test_correlation_lists_are_cut_from_the_list_of_their_block(spark):
    """Shared times, shared and missing ids, block edges; no window function runs over the rows of a look-back anew."""
    rng = np.random.default_rng(5)
    rows = [("s", int(t), None if i % 17 == 0 else f"é{i // 2 if i % 5 == 0 else i}", "x") for i, t in enumerate(
        rng.integers(0, 300, 400))]
    df = spark.createDataFrame(rows, "sensor_id string, t long, alert_id string, attack_type string")
    want = sorted((t, a or "", [y for x, y in sorted(
        (u, b) for _, u, b, _ in rows if b is not None and t - u < 40 and (u < t or (u == t and a is not None and b < a)))])
        for _, t, a, _ in rows)
    listed, text = al.correlate_alerts(df, 40), al.correlate_alerts(df, 40, sep=", ")
    assert sorted((r.t, r.alert_id or "", r.correlated_alerts) for r in listed.collect()) == want
    assert sorted((r.t, r.alert_id or "", r.correlated_alerts) for r in text.collect()) == [
        (t, a, ", ".join(found)) for t, a, found in want]
    assert "listagg" in text._jdf.queryExecution().toString() and "lambda" not in text._jdf.queryExecution().toString()


@pytest.mark.parametrize("margin", [1e-4, 0.2])
def test_exact_percentiles(spark, margin):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=999), np.repeat(0.5, 300)])
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "v": values}))
    got = {r.p: r.value for r in rp.exact_percentiles(df, ["g"], "v", [0.0, 0.5, 0.95, 0.97, 1.0], margin).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.percentile(values, p * 100))
    assert len(got) == 5


def test_response_cases(spark):
    rows = [("a", "critical", "syn_flood", ["10.0.0.1", "127.0.0.1", "bad"], 0.95, 0.5, [], 0),
            ("b", "medium", "syn_flood", ["10.0.0.1"], 0.95, 0.5, [], 0),
            ("c", "emergency", "x", [], 0.95, 0.5, [], 0), ("d", "critical", "x", ["10.0.0.1"], 0.5, 0.5, [], 0)]
    df = spark.createDataFrame(rows, "alert_id string, severity string, attack_type string, source_ips array<string>, "
                               "anomaly_score double, confidence double, gate_evidence array<string>, t long")
    got = rs.response_decisions(df, rs.Policy(max_ips_per_alert=3)).orderBy("alert_id", "target_ip").collect()
    assert [(r.target_ip, r.action_status) for r in got if r.alert_id == "a"] == [
        ("10.0.0.1", "monitor_only"), ("127.0.0.1", "rejected"), ("bad", "rejected")]
    assert {r.alert_id: r.decision_reason for r in got if r.alert_id != "a"} == {
        "b": "severity_below_auto_block_threshold", "c": "no_source_ips_available", "d": "insufficient_multi_evidence"}


def test_escalation_levels(spark):
    df = spark.createDataFrame([(0, "active"), (701, "active"), (999, "active"), (5, "resolved")], "t long, status string")
    got = [r.level for r in al.escalation_state(df, 1000).orderBy("t").collect()]
    assert got == ["L3 - CISO", "L1 - SOC Analyst", "L1 - SOC Analyst"]


@pytest.mark.parametrize("n", [1, 37, 200, 5000])
def test_first_per_key(spark, n):
    pdf = samples(400)
    got = first_per_key(spark.createDataFrame(pdf), ["metric"], F.floor(F.col("sec") / 500),
                        [F.col("sec"), F.col("sample_id")], n).toPandas()
    want = pdf.sort_values(["sec", "sample_id"]).groupby("metric").head(n)
    assert sorted(got.sample_id) == sorted(want.sample_id) and list(got.columns) == list(pdf.columns)


def test_lagged_shuffles_only_first_rows_again(spark):
    from netwatch.operators.ordered import lagged
    rows = spark.range(40_000).selectExpr("id", "concat('k', id % 3) AS k", "id * 7 % 40000 AS sec", "id * 11 AS v")
    out = lagged(rows, ["k"], "sec", ["id"], {"before": F.col("v")}, 500)
    plain = rows.withColumn("before", F.lag("v").over(W.partitionBy("k").orderBy("sec", "id")))
    assert out.exceptAll(plain).count() == 0 and out.count() == 40_000
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("Exchange hashpartitioning(k#") - plan.count("ReusedExchange") == 2

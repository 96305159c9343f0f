import random

from netwatch.ml.tabular import TrainingSize
from netwatch.operators.inventory import parse_vendor_registry
from netwatch.plans.inventory_scan import ScanSettings, scan_alerts, scan_findings
from netwatch.plans.training import classify, train_from_files
from netwatch.sources import testtables as tt


def test_training_from_files_and_reuse(spark, tmp_path):
    rng = random.Random(1)
    lines = ["Unnamed: 0,Flow Duration,Service,Label"]
    for i in range(60):
        bad = i % 2
        lines.append(f"{i},{rng.gauss(900 if bad else 100, 5):.3f},{'dns' if bad else 'web'},{'Syn' if bad else 'BENIGN'}")
    (tmp_path / "flows.csv").write_text("\n".join(lines) + "\n")
    size = TrainingSize(gbt_iterations=3, gbt_depth=3)
    result = train_from_files(spark, str(tmp_path / "flows.csv"), model_type="gb", max_rows_per_class=25,
                              save_to=str(tmp_path / "model"), size=size)
    assert result.best_type == "hist_gradient_boosting"
    assert result.metrics.head().balanced_accuracy == 1.0
    table = spark.createDataFrame([(110.0, "web"), (890.0, "dns"), (905.0, "new")], ["Flow Duration", "Service"])
    got = [r.predicted for r in classify(str(tmp_path / "model"), table).orderBy("Flow Duration").collect()]
    assert got == ["BENIGN", "Syn", "Syn"]


def test_inventory_scan_to_alerts(spark, sf):
    registry = parse_vendor_registry(tt.vendor_registry_lines(spark, sf))
    found = scan_findings(
        tt.associations(spark, sf), tt.networks(spark, sf), tt.adapters(spark, sf), tt.ip_configs(spark, sf),
        tt.trusted_networks(spark, sf), registry, tt.probes(spark, sf),
        ScanSettings(["001333"], ["free wifi"], 2, ["trusted"], "http://probe.example/test.txt", "<p>"))
    assert found.select("category").distinct().count() >= 6
    alerts = scan_alerts(found, 300).collect()
    assert alerts and len({(r.host_id, r.security_key) for r in alerts}) == len(alerts)
    assert {r.severity for r in alerts} <= {"critical", "high", "medium", "warning"}


def test_seconds_are_scored_and_gated_before_what_follows_is_planned(spark, sf):
    from netwatch.plans.detection import second_detections
    plan = second_detections(tt.packets(spark, sf))._jdf.queryExecution().analyzed().toString()
    assert "format_string" not in plan and "EXP(" not in plan.upper()

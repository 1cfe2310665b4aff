"""Runs from settings, files and the command line; state, scenarios and tuning."""

import json

import pytest
from pyspark.sql import functions as F

from telemetrica import cli, scenario, service, tuning
from telemetrica.functions import storage
from telemetrica.operators import comms, evaluation, incidents, rca, signals
from telemetrica.operators.signals import SignalConfig
from telemetrica.settings import Run, group_policy, incident_policy, load_settings, plausibility_of, required_causes, signal_config
from telemetrica.sources import documents, scans

SAMPLES = "signal_id string, scan_ord long, ts double, value double, quality string"
NODES = [{"id": "cd", "type": "comms_domain"}, {"id": "pg", "type": "poll_group"}, *[{"id": f"r{k}", "type": "rtu"} for k in (1, 2)], *[{"id": f"s{k}", "type": "signal"} for k in range(4)]]
EDGES = [{"parent": "cd", "child": "pg"}, *[{"parent": "pg", "child": f"r{k}"} for k in (1, 2)], *[{"parent": f"r{1 + k // 2}", "child": f"s{k}"} for k in range(4)]]


def dropout(spark, scans_=12):
    """Two signals of a station that are lost from the fourth scan to the ninth, and one elsewhere that isn't."""
    rows = [(s, n, float(n), None if s != "B_1_x" and 3 <= n < 9 else 10.0 + n % 2, "good") for s in ("A_1_x", "A_1_y", "B_1_x") for n in range(scans_)]
    return spark.createDataFrame(rows, SAMPLES)


def quick(**groups):
    changes = {"incidents": {"start_persistence_scans": 1, "end_persistence_scans": 1}, "group_incidents": {"start_persistence_scans": 1, "end_persistence_scans": 1, **groups}}
    return load_settings(None, changes)


def test_settings_are_merged_and_checked(tmp_path):
    (tmp_path / "c.yaml").write_text("incidents:\n  start_sqi: 40\nplausibility:\n  by_prefix:\n    a: {max: 5}\n    ab: {min: 1}\n  by_signal:\n    z: {max: 9}\n")
    made = load_settings(str(tmp_path / "c.yaml"))
    assert incident_policy(made).start_sqi == 40 and required_causes(incident_policy(made)) == {"missing"}
    assert plausibility_of(made, "abc") | {} == {"min": 1, "max": 5, "max_rate": None, "persistence_scans": 1, "recovery_scans": 1}
    assert signal_config(made, "z").value_max == 9 and signal_config(made, "q").value_max is None
    for bad in ({"incidents": {"end_sqi": 10}}, {"incidents": {"start_persistence_scans": 0}}, {"incidents": {"hard_fault_causes": ["x"]}}):
        with pytest.raises(ValueError):
            incident_policy(load_settings(None, bad))
    with pytest.raises(ValueError):
        group_policy(load_settings(None, {"group_incidents": {"min_fraction_for_start": 2}}))
    with pytest.raises(KeyError):
        load_settings(None, {"nothing": 1})


def test_run_holds_causes_and_emits_suppressed_events_again(spark):
    run = Run.of(quick(), grouped=True, run_id="t")
    run = Run(**{**run.__dict__, "signal": SignalConfig(missing_window=1)})
    done = service.process(dropout(spark), run)
    groups = {(r["scan_ord"], r["event"]): r for r in done.group_events.collect()}
    assert groups[3, "started"]["cause"] == "comms" and groups[3, "started"]["group_incident_id"] == "t:group:A_1:3"
    assert groups[9, "resolved"]["degraded_signals"] == "A_1_x,A_1_y" and groups[9, "resolved"]["cause"] == "comms"
    events = {(r["signal_id"], r["scan_ord"], r["event"]): r for r in done.events.collect()}
    assert events["A_1_x", 3, "started"]["suppressed"] and events["A_1_x", 3, "started"]["reemit_scan"] == 9
    ended = events["A_1_y", 9, "resolved"]
    assert ended["cause"] == "missing" and not ended["suppressed"] and (ended["start_timestamp"], ended["end_timestamp"]) == (3.0, 9.0)
    assert events["A_1_x", 3, "started"]["message"] == "Incident started for A_1_x due to missing." and not any(k[0] == "B_1_x" for k in events)
    assert {(r["signal_id"], r["published_scan"]) for r in service.published(done.events).where("event = 'started'").collect()} == {("A_1_x", 9), ("A_1_y", 9)}
    row = incidents.impact(done.group_events.withColumn("timestamp", F.col("ts")), "group_incident_id").first()
    assert (row["started"], row["resolved"], row["active_end"], row["p50"]) == (1, 1, 0, 6.0)


def test_start_counts_scans_not_rows(spark):
    rows = [("a", n, True, False, "noise", "warning") for n in (2, 7)]
    df = spark.createDataFrame(rows, "signal_id string, scan_ord long, degraded boolean, recovered boolean, cause string, severity string")
    assert [r["start_scan_index"] for r in incidents.lifecycle(df, "signal_id", F.col("recovered"), 2, 2, ["cause", "severity"]).where("event = 'started'").collect()] == [6]


def test_every_weighted_component_is_planned(spark):
    c = SignalConfig(weights=(0.5, 0, 0, 0, 0.2, 0, 0.3, 0))
    df = spark.createDataFrame([("a", n, float(n), 10.0 if n < 12 else 40.0) for n in range(20)], "signal_id string, scan_ord long, ts double, value double")
    assert 0.0 in {r["score_step"] for r in signals.process(df, c).collect()}
    out = signals.process(df, SignalConfig(innovation_enabled=True, noise_threshold=1.0), filters=True)
    assert {"filtered_ewma", "innovation_z"} <= set(out.columns) and out.where("is_spike").count() >= 1


def test_reasons_and_budgets(spark):
    row = spark.createDataFrame([("RTU", "x", 0.05, 0.0, 0.0, None, 6000.0, 70, 20, 700.0)], "node_type string, node_id string, timeout_rate double, retry_rate double, crc_error_rate double, avg_poll_jitter_ms double, avg_poll_cycle_ms double, bytes_tx long, bytes_rx long, other double")
    found = comms.health(row).first()
    assert found["reasons"] == "timeout_rate_degraded,poll_cycle_ms_critical" and found["comms_class"] == "CRITICAL"
    used = comms.budget(row, comms.BudgetConfig(per_node_capacity_bps={"x": 800})).first()
    assert (used["observed_bps"], used["utilization"], used["budget_level"], used["budget_reasons"]) == (720.0, 0.9, "CRITICAL", "UTILIZATION_CRITICAL,LOW_HEADROOM")
    with pytest.raises(ValueError):
        comms.BudgetConfig(poll_interval_ms=0)
    node = spark.createDataFrame([("RTU", "x", 3), ("RTU", "y", 0)], "node_type string, node_id string, signals long")
    all_ = {r["node_id"]: r for r in comms.budget_of_all(node, row.withColumn("scan_index", F.lit(4))).collect()}
    assert all_["x"]["expected_bytes"] == 254 and all_["y"]["observed_bytes"] == 0 and all_["y"]["scan_index"] == 4


def test_evicting_registry(spark):
    rows = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (2, "a")], "scan_ord long, signal_id string")
    assert {tuple(r) for r in scans.evicting_registry(rows, 2).collect()} == {("a", 0, 1), ("b", 0, 2), ("c", 1, None), ("a", 2, None)}
    assert scans.unregister(scans.registry(rows), ["b"]).count() == 2 and scans.evicting_registry(rows.limit(0), 2).count() == 0


def test_invalid_records_are_named(spark, tmp_path):
    good = {"scan_index": 0, "timestamp": 1.0, "signals": {"a": {"value": 1}}}
    bad = [good | {"more": 1}, good | {"signals": {"a": {"value": 1, "x": 2}}}, good | {"signals": {"a": {"value": 1, "quality": "odd"}}}, good | {"comms_metrics": [{"scan_index": 1}]}, {"timestamp": 1.0, "signals": {}}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, [good, *bad])))
    found = scans.invalid_scans(scans.read_scans(spark, str(tmp_path / "s.jsonl"))).collect()
    assert sorted(r["reason"] for r in found) == ["comms key", "quality", "scan_index", "unknown key", "unknown sample key"]


def test_rows_without_time_are_scans_of_their_own(spark):
    rows = spark.createDataFrame([(0, 2.0, "a", 1.0), (1, None, "b", 2.0), (2, 1.0, "a", 3.0)], "n long, timestamp double, signal_id string, value double")
    found = {(r["scan_ord"], r["signal_id"], r["value"]) for r in scans.scans_of(rows, "n").collect()}
    assert found == {(1, "a", 3.0), (1, "b", None), (2, "a", 1.0), (2, "b", None), (3, "b", 2.0)}
    times = spark.createDataFrame([(float(t),) for t in (1, 2, 4, 4, 8)], "timestamp double")
    assert scans.scan_interval(times, 0.5).first()[0] == 2.0 and scans.scan_interval(times.limit(0), 0.5).first()[0] == 0.5


def test_labels_wait_for_the_end_of_a_prediction(spark):
    predicted = spark.createDataFrame([("a", 1, 10, "x", None), ("a", 2, 3, "y", None), ("b", 5, 6, None, None)], "signal_id string, start long, end long, cause string, severity string")
    labels = documents.labels_of(spark, [{"signal_id": "a", "start_scan_index": 3, "end_scan_index": 4, "cause": " X "}, {"signal_id": "a", "start_scan_index": 9, "end_scan_index": 12}, {"signal_id": "b", "start_scan_index": 1, "end_scan_index": 4}])
    found = {(r["signal_id"], r["pred_start"]): r["label_start"] for r in evaluation.match(predicted, labels).collect()}
    assert found == {("a", 1): 3, ("a", 2): None, ("b", 5): None}
    row = evaluation.metrics(evaluation.match(predicted, labels), labels, 2).first()
    assert row["cause_accuracy"] == 1.0 and row["severity_accuracy"] == 0.0 and row["starts_ratio"] == 1.5


def test_scenarios(spark, tmp_path):
    made = scenario.outage(NODES, EDGES, ["s0", "s1"], "r1", "rtu")
    scenario.save_scenario(made, str(tmp_path / "one.yaml"))
    found = scenario.validate(spark, scenario.load_scenario(str(tmp_path / "one.yaml")))
    assert [f["passed"] for f in found] == [True, True], found
    made["expectations"].append({"scan_index": 1, "primary_node_id": "r2", "overall_state": "OK"})
    assert len(scenario.validate(spark, made)[-1]["failures"]) == 2
    with pytest.raises(ValueError):
        documents.topology_of(spark, {"nodes": [{"id": "a", "type": "rtu", "attrs": {"x": [1]}}]})


def test_state_goes_on_in_a_later_run(spark):
    rows = [("s0", n, None, 0.0, "missing" if n > 1 else None, None) for n in range(6)]
    kinds = "signal_id string, scan_ord long, quality_class string, missing_ratio double, event_cause string, low_cause string"
    whole = rca.observations(spark.createDataFrame(rows, kinds))
    early, late = (rca.observations(spark.createDataFrame(part, kinds)) for part in (rows[:4], rows[4:]))
    state = rca.onset_state(early)
    assert [r["onset_scan"] for r in rca.resumed(late, state).orderBy("scan_ord").collect()] == [r["onset_scan"] for r in whole.where("scan_ord >= 4").orderBy("scan_ord").collect()] == [2, 2]
    assert rca.pruned(state, 100, 5).count() == 1 and rca.pruned(state.withColumn("is_affected", F.lit(False)), 100, 5).count() == 0


def test_loop_keeps_errors_and_overruns():
    now, slept, seen = [0.0], [], []

    def scan(number):
        now[0] += 0.2 if number == 2 else 0.05
        if number == 3:
            raise ValueError("lost")

    loop = service.ScanLoop(scan, 0.1, lambda n: seen.append(n), clock=lambda: now[0], pause=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    said = loop.run(3)
    assert seen == [1, 2, 3] and (said["errors"], said["overruns"]) == (1, 1) and loop.results[2]["error"] == "ValueError: lost" and slept[1] == 0


def test_halving_keeps_the_best(spark, tmp_path):
    changes = tuning.overrides({"incidents.start_sqi": [10.0, 20.0, 30.0, 40.0]})
    asked = []

    def evaluate(samples, labels, settings, grouped, upto):
        asked.append((settings["incidents"]["start_sqi"], upto))
        return {"f1": settings["incidents"]["start_sqi"] / 40, "false_alarms": 0.0, "mttd_scans": 1.0, "starts_ratio": 1.0}

    records = tuning.search(dropout(spark), documents.labels_of(spark, [{"signal_id": "A_1_x", "start_scan_index": 3, "end_scan_index": 8}]), load_settings(), changes, tuning.Search((0.5, 1.0)), evaluate=evaluate)
    assert len(asked) == 6 and {a[0] for a in asked if a[1] == 11} == {30.0, 40.0} and tuning.best_of(records)["changes"]["incidents"]["start_sqi"] == 40.0
    tuning.write(records, load_settings(), str(tmp_path))
    assert "incidents.start_sqi = 40.0" in (tmp_path / "delta.md").read_text() and len(json.loads((tmp_path / "results.json").read_text())) == 4


def test_command_line(spark, tmp_path, capsys):
    lines = [{"scan_index": n, "timestamp": float(n), "signals": {s: None if 3 <= n < 9 else 10.0 for s in ("A_1_x", "A_1_y")}} for n in range(12)]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "c.yaml").write_text("incidents: {start_persistence_scans: 1, end_persistence_scans: 1, component_floor: 80, start_sqi: 20, end_sqi: 30}\n")
    (tmp_path / "g.yaml").write_text("group_incidents: {start_persistence_scans: 1, end_persistence_scans: 1}\n")
    (tmp_path / "l.yaml").write_text("- {signal_id: A_1_x, start_scan_index: 3, end_scan_index: 8, cause: missing}\n")
    out, config = str(tmp_path / "out"), ["--config", str(tmp_path / "c.yaml")]
    assert cli.main(["version"]) == 0
    assert cli.main(["replay", "--in", str(tmp_path / "in.jsonl"), "--out", out, *config]) == 0
    assert cli.main(["eval", "--replay-out", out, "--labels", str(tmp_path / "l.yaml"), "--out-json", str(tmp_path / "m.json")]) == 0
    assert json.loads((tmp_path / "m.json").read_text())["recall"] == 1.0
    (tmp_path / "s.csv").write_text("timestamp,signal_id,value\n" + "".join(f"{n},a,{n % 3}\n" for n in range(20)))
    assert cli.main(["analyze", "--signal-file", str(tmp_path / "s.csv"), *config]) == 0
    assert cli.main(["incidents", "--signal-file", str(tmp_path / "s.csv"), "--out", out, "--groups-config", str(tmp_path / "g.yaml"), *config]) == 0
    assert cli.main(["simulate", "--duration", "30"]) == 0
    assert "mean_sqi" in capsys.readouterr().out


def test_stored_tables_are_dropped(spark):
    kept = storage.stored(spark.range(3))
    assert kept.count() == 3
    storage.drop_stored(spark)
    with pytest.raises(Exception, match="(?i)not exist|not found|FILE"):
        storage.stored(spark.range(1))
        kept.collect()

"""Scenarios: a topology, scans of signal states and what a root-cause report should say of them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetrica.functions.storage import stored
from telemetrica.operators import rca
from telemetrica.sources.documents import parsed, read_topology, topology_of

OBSERVED = "signal_id string, scan_ord long, quality_class string, sqi double, missing_ratio double, event_cause string, low_cause string"


def load_scenario(path: str) -> dict:
    """A scenario file with name, topology and signal_feed."""
    data = parsed(path)
    if missing := sorted({"name", "topology", "signal_feed"} - set(data or {})):
        raise ValueError(f"a scenario lacks {missing}")
    return data


def save_scenario(scenario: dict, path: str) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump(scenario, sort_keys=True, allow_unicode=True))


def feed_rows(feed: list[dict]) -> list[tuple]:
    """Rows of ``OBSERVED`` for the entries of a feed; an event counts if it has an event type other than resolved."""
    rows = []
    for entry in feed:
        causes = {e["signal_id"]: e.get("cause", "unknown") for e in entry.get("incidents") or [] if e.get("event_type") in ("started", "updated")}
        for signal, state in sorted(entry["signals"].items()):
            parts = state.get("sqi_components") or {}
            low = min(parts, key=parts.get) if parts and min(parts.values()) < 100 else "unknown"
            ratio = state.get("missing_ratio", 1 - parts["missing"] / 100 if "missing" in parts else 0.0)
            sqi = state.get("sqi")
            rows.append((signal, entry["scan_index"], state.get("quality_class"), None if sqi is None else float(sqi), float(ratio), causes.get(signal), low))
    return rows


def run(spark: SparkSession, scenario: dict, base: str = ".") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports, ranked candidates and affected nodes of every scan of a scenario."""
    top = scenario["topology"]
    nodes, edges, _ = read_topology(spark, f"{base}/{top}") if isinstance(top, str) else topology_of(spark, top)
    obs = stored(rca.observations(spark.createDataFrame(feed_rows(scenario["signal_feed"]), OBSERVED)))
    found = stored(rca.evidence(obs, nodes.select("id", "type"), edges))
    ranked = stored(rca.confidences(rca.candidates(found)))
    least = (scenario.get("rca_config") or {}).get("min_confidence_for_primary", 0.0)
    return rca.report(obs, ranked, least), ranked, rca.impacted(found)


def validate(spark: SparkSession, scenario: dict, base: str = ".") -> list[dict]:
    """What each expectation of a scenario finds: scan_index, passed and failures."""
    reports, _, hit = run(spark, scenario, base)
    wanted = [e["scan_index"] for e in scenario.get("expectations") or []]
    said = {r["scan_ord"]: r for r in reports.where(F.col("scan_ord").isin(wanted)).collect()}  # a row an expectation
    impacted: dict = {}
    for r in hit.where(F.col("scan_ord").isin(wanted)).collect():
        impacted.setdefault((r["scan_ord"], r["type"]), set()).add(r["node_id"])
    out = []
    for e in scenario.get("expectations") or []:
        row, failures = said.get(e["scan_index"]), []
        if row is None:
            failures.append(f"no report for scan {e['scan_index']}")
        else:
            names = {"overall_state": "overall_state", "primary_node_id": "primary_node_id", "primary_node_type": "primary_type"}
            failures += [f"{k}: expected {e[k]}, got {row[c]}" for k, c in names.items() if e.get(k) and e[k] != row[c]]
            if e.get("min_confidence") is not None and (row["primary_confidence"] is None or row["primary_confidence"] < e["min_confidence"]):
                failures.append(f"confidence: expected {e['min_confidence']} at least, got {row['primary_confidence']}")
            for kind, ids in (e.get("impacted_nodes") or {}).items():
                if lost := sorted(set(ids) - impacted.get((e["scan_index"], kind), set())):
                    failures.append(f"impacted {kind}: missing {lost}")
        out.append({"scan_index": e["scan_index"], "passed": not failures, "failures": failures})
    return out


def outage(nodes: list[dict], edges: list[dict], lost: list[str], node: str, kind: str, scans: int = 3, name: str = "outage") -> dict:
    """A scenario in which the signals ``lost`` go missing from the second scan on, with ``node`` as their cause."""
    signals = [n["id"] for n in nodes if n["type"] == "signal"]
    well = {"quality_class": "GOOD", "sqi": 95.0, "sqi_components": {"missing": 100.0}}
    ill = {"quality_class": "BAD", "sqi": 10.0, "sqi_components": {"missing": 0.0}}
    feed = [{"scan_index": k, "timestamp": float(k), "signals": {s: ill if k and s in lost else well for s in signals}} for k in range(scans)]
    expected = [{"scan_index": 0, "overall_state": "OK"}, {"scan_index": scans - 1, "primary_node_id": node, "primary_node_type": kind, "impacted_nodes": {"signal": sorted(lost)}}]
    return {"name": name, "topology": {"nodes": nodes, "edges": edges}, "signal_feed": feed, "expectations": expected}

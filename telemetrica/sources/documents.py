"""Files that describe a run: topologies, labels, published incidents and scenarios."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetrica.config import load_yaml
from telemetrica.operators import topology

NODES, EDGES = "id string, type string, attrs map<string,string>", "parent string, child string"
LABELS = "signal_id string, start long, end long, cause string, severity string"


def parsed(path: str):
    """A JSON or YAML file; repeated keys of YAML mappings are errors."""
    text = Path(path).read_text()
    return json.loads(text) if Path(path).suffix == ".json" else load_yaml(text)


def topology_of(spark: SparkSession, data: dict | None, allow_orphans: bool = False) -> tuple[DataFrame, DataFrame, str]:
    """Checked nodes and edges of a mapping with ``nodes`` and ``edges``, and the version of the whole."""
    if not isinstance(data, dict) or not isinstance(data.get("nodes"), list) or not isinstance(data.get("edges", []), list):
        raise ValueError("a topology has lists of nodes and edges")
    nodes, edges = data["nodes"], data.get("edges", [])
    for n in nodes:
        if not n.get("id") or not isinstance(n["id"], str):
            raise ValueError("a node needs an id")
        if bad := sorted(k for k, v in (n.get("attrs") or {}).items() if not isinstance(v, str | int | float | bool)):
            raise ValueError(f"attributes of {n['id']} aren't scalars: {bad}")
    topology.validate(nodes, edges, allow_orphans)
    rows = [(n["id"], n["type"], {k: str(v) for k, v in (n.get("attrs") or {}).items()}) for n in nodes]
    return spark.createDataFrame(rows, NODES), spark.createDataFrame([(e["parent"], e["child"]) for e in edges], EDGES), topology.version(nodes, edges)


def read_topology(spark: SparkSession, path: str, allow_orphans: bool = False) -> tuple[DataFrame, DataFrame, str]:
    return topology_of(spark, parsed(path), allow_orphans)


def labels_of(spark: SparkSession, entries: list) -> DataFrame:
    """Labelled intervals; each needs a signal and both scans, cause and severity may lack."""
    if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
        raise ValueError("labels are a list of mappings")
    said = lambda e, k: (str(e[k]).strip() or None) if e.get(k) is not None else None
    rows = []
    for e in entries:
        if not said(e, "signal_id") or "start_scan_index" not in e or "end_scan_index" not in e:
            raise ValueError("a label needs signal_id, start_scan_index and end_scan_index")
        rows.append((said(e, "signal_id"), int(e["start_scan_index"]), int(e["end_scan_index"]), said(e, "cause"), said(e, "severity")))
    return spark.createDataFrame(sorted(rows, key=lambda r: r[:2]), LABELS)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return labels_of(spark, parsed(path))


def started_predictions(events: DataFrame) -> DataFrame:
    """Predicted intervals from event rows: from an incident's start to the event's scan."""
    return events.where("event = 'started'").select(F.col("signal_id").cast("string").alias("signal_id"), F.col("start_scan_index").alias("start"), F.col("scan_ord").alias("end"), "cause", "severity")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from published incident lines; blank lines are passed over."""
    kinds = "event string, signal_id string, start_scan_index long, scan_ord long, cause string, severity string"
    lines = spark.read.text(path).where(F.trim("value") != "")
    return started_predictions(lines.select(F.from_json("value", kinds).alias("r")).select("r.*"))


def count_started(spark: SparkSession, path: str) -> int:
    """Started events among published lines."""
    return spark.read.text(path).where(F.get_json_object("value", "$.event") == "started").count()

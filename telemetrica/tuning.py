"""Offline tuning: candidates of settings are replayed, gated, scored and halved, and the best one is written."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetrica import service
from telemetrica.config import flattened, merged
from telemetrica.functions.storage import stored
from telemetrica.operators import evaluation
from telemetrica.settings import Run, signal_config
from telemetrica.sources.documents import started_predictions

QUALITY_GATES = {"f1": (">=", 0.75), "false_alarms": ("<=", 0.4), "mttd_scans": ("<=", 5.0), "starts_ratio": ("<=", 3.0)}
COST_GATES = {"scan_p95_estimate": ("<=", 200.0), "memory_estimate_bytes": ("<=", 50_000_000.0)}


@dataclass(frozen=True)
class Search:
    """How candidates are searched: shares of the scans of each round, the share kept, and the order's seed."""

    fractions: tuple[float, ...] = (1.0,)
    retain: float = 0.5
    seed: int = 42
    weights: dict[str, float] = field(default_factory=lambda: {"f1": 1.0})


def overrides(params: dict[str, list]) -> list[dict]:
    """All combinations of values of dotted keys, as nested changes of settings."""
    out = []
    for values in itertools.product(*params.values()):
        change: dict = {}
        for key, value in zip(params, values, strict=True):
            at = change
            *path, last = key.split(".")
            for p in path:
                at = at.setdefault(p, {})
            at[last] = value
        out.append(change)
    return out


def failures(metrics: dict, gates: dict[str, tuple[str, float]]) -> list[str]:
    """The gates that don't hold; a measure that lacks fails."""
    return [g for g, (op, limit) in gates.items() if metrics.get(g) is None or (metrics[g] < limit if op == ">=" else metrics[g] > limit)]


def replayed(samples: DataFrame, labels: DataFrame, settings: dict, grouped: bool = False, upto: int | None = None) -> dict:
    """The measures of one candidate over the scans up to ``upto``; labels that begin later are left out."""
    if upto is not None:
        samples, labels = samples.where(F.col("scan_ord") <= upto), labels.where(F.col("start") <= upto)
    done = service.process(samples, Run.of(settings, grouped))
    events = service.published(done.events)
    groups = done.group_events.where("event = 'started'").count() if grouped else 0
    row = evaluation.metrics(evaluation.match(started_predictions(events), labels), labels, groups).first().asDict()
    row["false_alarms"] = 1 - row["precision"] if row["predicted"] else 0.0
    return row


def search(samples: DataFrame, labels: DataFrame, settings: dict, changes: list[dict], how: Search = Search(), grouped: bool = False, evaluate: Callable | None = None) -> list[dict]:
    """A record per candidate: its changes, the last round's measures, failed gates, score and whether it was dropped.

    Candidates that fail a cost gate are never replayed. Each round replays a share of the scans and keeps the best
    ``retain`` of the candidates; the driver holds a record a candidate.
    """
    samples, labels = stored(samples), stored(labels)
    cells = samples.select("scan_ord", "signal_id").distinct()
    limits = samples.select("scan_ord").distinct().agg(*[F.expr(f"percentile_disc({f}) within group (order by scan_ord)").alias(f"f{k}") for k, f in enumerate(how.fractions)]).first()
    order = list(range(len(changes)))
    random.Random(how.seed).shuffle(order)
    records = []
    for k in order:
        made = merged(settings, changes[k])
        cost = evaluation.scan_cost(cells, signal_config(made)).first().asDict()
        lost = failures(cost, COST_GATES)
        records.append({"run_id": f"run_{k:03d}", "changes": changes[k], "metrics": cost, "failed_gates": lost, "dropped": bool(lost), "score": 0.0})
    left = [r for r in records if not r["dropped"]]
    total = sum(how.weights.values())
    for number in range(len(how.fractions)):
        for r in left:
            found = (evaluate or replayed)(samples, labels, merged(settings, r["changes"]), grouped, limits[number])
            r["metrics"] = {**r["metrics"], **found}
            r["failed_gates"] = failures(r["metrics"], {**QUALITY_GATES, **COST_GATES})
            r["score"], r["round"] = sum(w / total * r["metrics"][m] for m, w in how.weights.items()), number + 1
        left.sort(key=lambda r: (-r["score"], r["run_id"]))
        if number + 1 < len(how.fractions):
            keep = max(1, int(len(left) * how.retain))
            for r in left[keep:]:
                r["dropped"] = True
            left = left[:keep]
    return sorted(records, key=lambda r: (r["dropped"], -r["score"], r["run_id"]))


def best_of(records: list[dict]) -> dict | None:
    """The best record that passes all gates, else the best that wasn't dropped."""
    return next((r for r in records if not r["failed_gates"] and not r["dropped"]), next((r for r in records if not r["dropped"]), None))


def write(records: list[dict], settings: dict, folder: str) -> None:
    """Results, failures, the best settings and what they change, as files."""
    import yaml

    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    plain = json.dumps(records, indent=1, sort_keys=True, default=float)
    (out / "results.json").write_text(plain + "\n")
    (out / "failures.json").write_text(json.dumps([r for r in records if r["failed_gates"]], indent=1, sort_keys=True, default=float) + "\n")
    best = best_of(records)
    if best:
        made = merged(settings, best["changes"])
        (out / "best.yaml").write_text(yaml.safe_dump(made, sort_keys=True))
        before, after = flattened(settings), set(flattened(made))
        moved = [f"- {line}" for line in sorted(after - set(before))] or ["- nothing"]
        (out / "delta.md").write_text("\n".join([f"# {best['run_id']}", "", f"score {best['score']:.6f}", "", *moved, ""]))

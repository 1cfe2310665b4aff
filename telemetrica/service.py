"""A whole run over samples: registration, pipeline, incidents, groups, suppression and communications, as tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetrica.functions.storage import stored
from telemetrica.operators import comms, incidents, signals
from telemetrica.settings import Run, required_causes
from telemetrica.sources import scans

KEYS = ["signal_id", "scan_ord"]


@dataclass
class Outcome:
    """Tables of a run; group and comms tables are None where there is nothing to make them of."""

    processed: DataFrame
    events: DataFrame
    states: DataFrame
    groups: DataFrame | None = None
    group_events: DataFrame | None = None
    health: DataFrame | None = None
    budget: DataFrame | None = None


def grouped(rows: DataFrame, run: Run) -> DataFrame:
    """``rows`` with group_id, by the explicit map if there is one, else by prefix."""
    if not run.explicit_groups:
        return rows.withColumn("group_id", incidents.group_of(F.col("signal_id"), run.groups))
    pairs = rows.sparkSession.createDataFrame([*run.explicit_groups.items()], "signal_id string, group_id string")
    return rows.join(F.broadcast(pairs), "signal_id", "left")  # the map comes from a settings file


def statuses(rows: DataFrame, run: Run) -> tuple[DataFrame, DataFrame]:
    """Processed rows, and the status of every registered signal in every scan, of samples (scan_ord, ts, signal_id, value, quality)."""
    known = scans.registry(rows, run.max_signals, run.max_signals_policy)
    full = scans.densify(rows.join(known.select("signal_id"), "signal_id", "left_semi"), known)
    full = stored(signals.missing(signals.quality_mask(full).fillna({"penalty": 1.0}), run.signal))
    done = stored(signals.process(full, run.signal, required_causes(run.incidents)))
    wanted = ["sqi", *[f"score_{c}" for c in signals.COMPONENTS], "alert_level", "drift_alert", "spike_alert", "quality_class"]
    return done, stored(incidents.status(full.join(done.select(*KEYS, *wanted), KEYS, "left"), run.incidents, run.signal))


def process(rows: DataFrame, run: Run, metrics: DataFrame | None = None) -> Outcome:
    """All tables of a run; ``metrics`` are comms metrics, if there are any."""
    done, state = statuses(rows, run)
    lives = incidents.with_times(incidents.signal_incidents(state, run.incidents, run.run_id), "signal_id", "ts")
    lives = lives.withColumn("details", incidents.signal_details())
    events, groups, told = lives.where("event is not null"), None, None
    if run.groups:
        by_group = grouped(state, run)
        times = state.groupBy("scan_ord").agg(F.max("ts").alias("ts"))
        groups = stored(incidents.group_incidents(incidents.group_status(by_group, run.groups), run.groups, run.run_id).join(times, "scan_ord"))
        told = groups.where("event is not null").join(incidents.group_details(by_group), ["group_id", "scan_ord"], "left").withColumn("recommended_action", F.lit(None).cast("string"))
        events = grouped(events, run)
        if run.suppress:
            events = incidents.suppress(events, groups, run.causes, run.kinds, run.passed)
    health = budget = None
    if metrics is not None:
        rolled = stored(comms.rollup(metrics))
        health, budget = comms.health(rolled), comms.budget(rolled, run.budget)
    return Outcome(done, events, lives, groups, told, health, budget)


def published(events: DataFrame) -> DataFrame:
    """Events in the scan that publishes them: their own, or for suppressed ones the one that emits them again, if any does."""
    if "suppressed" not in events.columns:
        return events.withColumn("published_scan", F.col("scan_ord"))
    return events.withColumn("published_scan", F.when(F.col("suppressed"), F.col("reemit_scan")).otherwise(F.col("scan_ord"))).where("published_scan is not null")


def signal_statistics(done: DataFrame, states: DataFrame) -> DataFrame:
    """Per signal: samples, missing ones, latest ratios and the statistics of its index."""
    last = states.groupBy("signal_id").agg(
        F.count("*").alias("samples"),
        F.sum(F.col("value").isNull().cast("int")).alias("missing_count"),
        F.max_by("raw_missing_ratio", "scan_ord").alias("missing_ratio"),
        F.max_by("missing_ratio", "scan_ord").alias("effective_missing_ratio"),
    )
    return last.join(signals.index_statistics(done), "signal_id", "left")


@dataclass
class ScanLoop:
    """Paces calls of ``scan`` and keeps errors, utilization and overruns; the clock and the pause can be replaced.

    For live use the streaming trigger does the pacing; this serves callers that hand over one batch of samples at a time.
    """

    scan: Callable[[int], object]
    interval: float = 0.1
    before: Callable[[int], None] | None = None
    after: Callable[[int, dict], None] | None = None
    clock: Callable[[], float] = time.perf_counter
    pause: Callable[[float], None] = time.sleep
    history: int = 1000
    results: list[dict] = field(default_factory=list)
    errors: int = 0
    overruns: int = 0

    def once(self, number: int) -> dict:
        if self.before:
            self.before(number)
        began, result, error = self.clock(), None, None
        try:
            result = self.scan(number)
        except Exception as e:  # a failed scan is a result of the loop, not its end
            error = f"{type(e).__name__}: {e}"
            self.errors += 1
        spent = self.clock() - began
        over = max(0.0, spent - self.interval)
        self.overruns += over > 0
        last = self.results[-1]["began"] if self.results else None
        actual = self.interval if last is None else began - last
        said = {
            "scan_number": number, "began": began, "scan_duration": spent, "actual_interval": actual, "timing_error": actual - self.interval,
            "utilization": spent / self.interval if self.interval > 0 else 0.0, "overrun": over, "overruns": self.overruns, "status": "error" if error else "ok", "error": error, "result": result,
        }
        self.results = [*self.results, said][-self.history :]
        if self.after:
            self.after(number, said)
        return said

    def run(self, scans: int) -> dict:
        for number in range(1, scans + 1):
            self.pause(max(0.0, self.interval - self.once(number)["scan_duration"]))
        return self.performance()

    def performance(self) -> dict:
        spent = sorted(r["scan_duration"] for r in self.results)
        if not spent:
            return {"scans": 0, "errors": self.errors, "overruns": self.overruns}
        return {"scans": len(spent), "errors": self.errors, "overruns": self.overruns, "mean": sum(spent) / len(spent), "max": spent[-1], "p95": spent[int(0.95 * (len(spent) - 1))]}

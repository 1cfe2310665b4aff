"""Sinks: JSON lines of processed rows and events, and derived points of a control system."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numeric codes of derived points.
QUALITY_CODES = {"excellent": 4, "good": 3, "fair": 2, "poor": 1, "critical": 0}


def json_line(df: DataFrame) -> Column:
    """A row as JSON with sorted keys; nulls are kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """Text files of JSON lines, written by all tasks."""
    df.select(json_line(df).alias("value")).write.mode(mode).text(path)


def event_order(events: DataFrame) -> DataFrame:
    """Events in publishing order: scan, signal, then event type by name."""
    return events.orderBy("scan_ord", "signal_id", "event")


def comms_alerts(healths: DataFrame) -> DataFrame:
    """Comms health rows that aren't OK."""
    return healths.where("comms_class <> 'OK'")


def budget_alerts(budgets: DataFrame) -> DataFrame:
    return budgets.where(F.col("budget_level").isin("DEGRADED", "CRITICAL"))


def derived_points(rows: DataFrame) -> DataFrame:
    """Points per signal and scan: index, coded class and alert flags, in long form."""
    code = F.coalesce(*[F.when(F.col("quality_class") == k, F.lit(float(v))) for k, v in QUALITY_CODES.items()])
    values = {"SQI": F.col("sqi"), "QUALITY": code, "DRIFT_ALERT": F.col("drift_alert").cast("double"), "SPIKE_ALERT": F.col("spike_alert").cast("double")}
    pairs = F.array(*[F.struct(F.lit(k).alias("point"), v.alias("value")) for k, v in values.items()])
    return rows.select("signal_id", "scan_ord", F.explode(pairs).alias("p")).select("signal_id", "scan_ord", "p.point", "p.value")


def batch_sink(send: Callable[[list[dict]], None], most: int = 10_000) -> Callable[[DataFrame, int], None]:
    """A sink that calls ``send`` on the executors with at most ``most`` rows at a time."""

    def sink(batch: DataFrame, number: int) -> None:
        def run(rows) -> None:
            part: list[dict] = []
            for row in rows:
                part.append(row.asDict(recursive=True))
                if len(part) >= most:
                    send(part)
                    part = []
            if part:
                send(part)

        batch.foreachPartition(run)

    return sink

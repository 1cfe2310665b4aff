"""Command line: analyze, simulate, incidents, replay, eval, offline-tuning and version."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import telemetrica
from telemetrica import service, tuning
from telemetrica.functions.storage import drop_stored, stored
from telemetrica.operators import evaluation, incidents, publish, signals
from telemetrica.settings import Run, load_settings, signal_config
from telemetrica.sources import documents, scans


def csv_samples(spark: SparkSession, path: str) -> DataFrame:
    rows = stored(scans.read_csv(spark, path).withColumn("_ord", F.monotonically_increasing_id()))
    return scans.scans_of(rows, "_ord").withColumn("quality", F.lit("good"))


def settings_of(args: argparse.Namespace) -> dict:
    changes = documents.parsed(args.groups_config) if getattr(args, "groups_config", None) else None
    return load_settings(args.config, changes)


def analyze(spark: SparkSession, args: argparse.Namespace) -> None:
    """Statistics of the signals of a CSV file."""
    run = Run.of(settings_of(args))
    done, states = service.statuses(csv_samples(spark, args.signal_file), run)
    service.signal_statistics(done, states).orderBy("signal_id").show(args.rows, truncate=False)


def simulate(spark: SparkSession, args: argparse.Namespace) -> None:
    """Statistics of a simulated sine with noise."""
    c = signal_config(settings_of(args))
    rows = scans.simulated(spark, 1, args.duration, c.sample_interval, args.seed, args.noise)
    signals.index_statistics(signals.process(rows, c)).show(truncate=False)


def write_events(outcome: service.Outcome, folder: str) -> None:
    shown = service.published(outcome.events).drop("details")
    publish.write_json_lines(publish.event_order(shown), f"{folder}/incidents", "overwrite")
    if outcome.group_events is not None:
        publish.write_json_lines(outcome.group_events.orderBy("scan_ord", "group_id"), f"{folder}/group_incidents", "overwrite")
    if outcome.health is not None:
        publish.write_json_lines(publish.comms_alerts(outcome.health), f"{folder}/comms_health", "overwrite")
        publish.write_json_lines(publish.budget_alerts(outcome.budget), f"{folder}/comms_budget", "overwrite")


def incident_events(spark: SparkSession, args: argparse.Namespace) -> None:
    """Incident events of a CSV file as JSON lines, and their numbers."""
    done = service.process(csv_samples(spark, args.signal_file), Run.of(settings_of(args), bool(args.groups_config), args.run_id))
    write_events(done, args.out)
    done.events.groupBy("event").count().orderBy("event").show()
    incidents.started_by(done.events, "cause").orderBy(F.desc("n"), "cause").limit(3).show()


def replay(spark: SparkSession, args: argparse.Namespace) -> None:
    """Processed rows and incident events of a scan file as JSON lines."""
    raw = scans.read_scans(spark, args.input)
    if bad := scans.invalid_scans(raw).first():
        raise ValueError(f"invalid record ({bad['reason']}): {bad['line'][:200]}")
    run = Run.of(settings_of(args), bool(args.groups_config), args.run_id)
    done = service.process(scans.samples(raw), run, scans.comms_metrics(raw))
    publish.write_json_lines(done.processed.drop("components"), f"{args.out}/processed", "overwrite")
    write_events(done, args.out)


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    """Measures of published incidents against labels."""
    labels = documents.read_labels(spark, args.labels)
    groups = Path(args.replay_out) / "group_incidents"
    started = documents.count_started(spark, str(groups)) if groups.exists() else 0
    found = evaluation.match(documents.read_predictions(spark, f"{args.replay_out}/incidents"), labels)
    row = evaluation.metrics(found, labels, started).first().asDict()
    for name in sorted(row):
        print(f"{name}: {row[name]}")
    if args.out_json:
        Path(args.out_json).write_text(json.dumps(row, indent=2, sort_keys=True) + "\n")


def tune(spark: SparkSession, args: argparse.Namespace) -> None:
    """Search over settings: a YAML mapping of dotted keys to lists of values."""
    settings = settings_of(args)
    samples = scans.samples(scans.read_scans(spark, args.input))
    how = tuning.Search(tuple(args.fractions), args.retain, args.seed)
    records = tuning.search(samples, documents.read_labels(spark, args.labels), settings, tuning.overrides(documents.parsed(args.params)), how, bool(args.groups_config))
    tuning.write(records, settings, args.out)
    print(json.dumps(tuning.best_of(records), sort_keys=True, default=float))


COMMANDS = {"analyze": analyze, "simulate": simulate, "incidents": incident_events, "replay": replay, "eval": evaluate, "offline-tuning": tune}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="telemetrica", description=__doc__)
    out.add_argument("--version", action="version", version=telemetrica.__version__)
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    made = {name: commands.add_parser(name, help=f.__doc__) for name, f in COMMANDS.items()}
    for name in ("analyze", "simulate", "incidents", "replay", "offline-tuning"):
        made[name].add_argument("--config")
    for name in ("analyze", "incidents"):
        made[name].add_argument("--signal-file", required=True)
    made["analyze"].add_argument("--rows", type=int, default=50)
    made["simulate"].add_argument("--duration", type=int, default=100)
    made["simulate"].add_argument("--noise", type=float, default=1.0)
    made["simulate"].add_argument("--seed", type=int, default=42)
    for name in ("incidents", "replay", "offline-tuning"):
        made[name].add_argument("--groups-config")
        made[name].add_argument("--out", required=True)
    for name in ("incidents", "replay"):
        made[name].add_argument("--run-id", default="run")
    for name in ("replay", "offline-tuning"):
        made[name].add_argument("--in", dest="input", required=True)
    for name in ("eval", "offline-tuning"):
        made[name].add_argument("--labels", required=True)
    made["eval"].add_argument("--replay-out", required=True)
    made["eval"].add_argument("--out-json")
    made["offline-tuning"].add_argument("--params", required=True)
    made["offline-tuning"].add_argument("--fractions", type=float, nargs="+", default=[1.0])
    made["offline-tuning"].add_argument("--retain", type=float, default=0.5)
    made["offline-tuning"].add_argument("--seed", type=int, default=42)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(telemetrica.__version__)
        return 0
    spark = SparkSession.builder.appName("telemetrica").getOrCreate()
    COMMANDS[args.command](spark, args)
    drop_stored(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

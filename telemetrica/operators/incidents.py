"""Incident lifecycles of signals and groups, as latches over windows, and event suppression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetrica.functions.windows import by_signal, latch, run_length_of, so_far
from telemetrica.operators.signals import COMPONENTS, SignalConfig

#: Causes in the default order of priority.
PRIORITY = ("missing", "stale", "step", "plausibility", "drift", "spikes", "noise", "oscillation", "unknown")
#: The action recommended for each cause.
ACTIONS = {
    "missing": "Check comms path, poll group, RTU health, and network stability.",
    "stale": "Check sensor update path, frozen polls, and timestamp wiring.",
    "step": "Check sensor replacement, scaling changes, or swapped channels.",
    "plausibility": "Verify engineering limits, scaling, and sensor plausibility.",
    "drift": "Check instrument calibration, impulse line, and sensor health.",
    "spikes": "Check scaling, comm retries, and transient glitches.",
    "noise": "Check wiring, grounding, and consider filtering or sensor replacement.",
    "oscillation": "Check control loop stability, regulator hunting, and tuning.",
    "unknown": "Inspect trend and raw quality flags for root cause.",
}


@dataclass(frozen=True)
class IncidentPolicy:
    start_sqi: float = 50.0
    end_sqi: float = 60.0
    start_persistence: int = 5
    end_persistence: int = 10
    critical_sqi: float = 25.0
    component_floor: float = 70.0
    hard_faults: tuple[str, ...] = ("missing",)
    priority: tuple[str, ...] = PRIORITY


@dataclass(frozen=True)
class GroupPolicy:
    delimiter: str = "_"
    depth: int = 2
    min_members: int = 2
    min_fraction: float = 0.5
    start_persistence: int = 2
    end_persistence: int = 2
    critical_fraction: float = 0.8


def status(df: DataFrame, p: IncidentPolicy = IncidentPolicy(), c: SignalConfig = SignalConfig()) -> DataFrame:
    """degraded, recovered, cause, severity and status_sqi of rows with scores (sqi null: signal absent)."""
    weights = c.normalised_weights()
    lack = 100 * (1 - F.col("missing_ratio"))
    absent = F.col("sqi").isNull()
    low = [
        F.when(F.col(f"score_{name}") <= p.component_floor, F.struct(F.col(f"score_{name}").alias("score"), F.lit(p.priority.index(name) if name in p.priority else len(p.priority)).alias("rank"), F.lit(name).alias("cause")))
        for name in COMPONENTS
        if weights[name] > 0 or name in p.hard_faults
    ]
    eligible = "missing" in p.hard_faults or weights["missing"] > 0
    fallback = F.when(lack <= p.component_floor, "missing" if eligible else "unknown").otherwise("unknown")
    cause = F.coalesce(F.array_min(F.array_compact(F.array(*low)))["cause"], fallback)
    gone = lack <= p.component_floor
    return df.withColumns(
        {
            "degraded": F.when(absent, gone).otherwise((F.col("sqi") <= p.start_sqi) | gone),
            "recovered": F.when(absent, lack >= p.component_floor).otherwise(F.col("sqi") >= p.end_sqi),
            "cause": F.when(absent, F.when(gone, "missing").otherwise("unknown")).otherwise(cause),
            "severity": F.when(~absent & (F.col("sqi") <= p.critical_sqi), "critical").otherwise("warning"),
            "status_sqi": F.coalesce("sqi", lack),
        }
    )


def lifecycle(df: DataFrame, key: str, recovered: Column, start: int, end: int, watched: list[str]) -> DataFrame:
    """event (started, updated, resolved or null), changed, active and start_scan_index per row of ``key``.

    Needs ``degraded`` and a ``scan_ord`` that counts scans. An update is a degraded row whose ``watched``
    columns, those in ``changed``, differ from the incident's. While an incident lasts, and on the row that
    resolves it, the watched columns hold what its last degraded row said.
    """
    w = by_signal(key)
    df = df.withColumns({"_n": F.row_number().over(w), "_well": ~F.col("degraded") & recovered})
    df = df.withColumns({"_up": run_length_of("degraded", "_n", w) >= start, "_down": run_length_of("_well", "_n", w) >= end})
    df = df.withColumn("active", latch(F.col("_up"), F.col("_down"), w))
    seen = F.when(F.col("degraded"), F.struct(*watched))
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"_was": F.coalesce(F.lag("active").over(w), F.lit(False)), "_seen": F.last(seen, ignorenulls=True).over(earlier)})
    begun = F.col("active") & ~F.col("_was")
    moved = F.array_compact(F.array(*[F.when(~F.col(f"_seen.{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in watched]))
    event = F.when(begun, "started").when(~F.col("active") & F.col("_was"), "resolved")
    event = event.when(F.col("active") & F.col("degraded") & (F.size(moved) > 0), "updated")
    df = df.withColumns({"event": event, "changed": F.when(event == "updated", moved), "_start": F.when(begun, F.col("scan_ord") - (start - 1))})
    during = F.col("active") | F.col("_was")
    df = df.withColumn("start_scan_index", F.when(during, F.last("_start", ignorenulls=True).over(so_far(w))))
    held = {c: F.when(during & ~F.col("degraded"), F.col(f"_seen.{c}")).otherwise(F.col(c)) for c in watched}
    return df.withColumns(held).drop("_n", "_well", "_up", "_down", "_was", "_seen", "_start")


def action_of(cause: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[cause]


def signal_message() -> Column:
    """What an event of a signal says."""
    name = F.col("signal_id").cast("string")
    parts = F.array_join(F.transform("changed", lambda c: F.concat(c, F.lit(" "), F.when(c == "cause", F.col("cause")).otherwise(F.col("severity")))), ", ")
    started = F.concat(F.lit("Incident started for "), name, F.lit(" due to "), F.col("cause"), F.lit("."))
    updated = F.concat(F.lit("Incident updated for "), name, F.lit(" with "), parts, F.lit("."))
    return F.when(F.col("event") == "started", started).when(F.col("event") == "resolved", F.concat(F.lit("Incident resolved for "), name, F.lit("."))).when(F.col("event") == "updated", updated)


def group_message() -> Column:
    """What an event of a group says."""
    value = lambda c: F.when(c == "cause", F.concat(F.lit("cause "), F.col("cause"))).when(c == "severity", F.concat(F.lit("severity "), F.col("severity"))).otherwise("members")
    parts = F.array_join(F.transform("changed", value), ", ")
    plain = F.concat(F.lit("Group incident "), F.col("event"), F.lit(" for "), F.col("group_id"))
    return F.when(F.col("event") == "updated", F.concat(plain, F.lit(" with "), parts, F.lit("."))).otherwise(F.concat(plain, F.lit(".")))


def signal_details(components: tuple[str, ...] = COMPONENTS) -> Column:
    """The details of a signal's row: component scores (the missing score alone for absent signals), ratios and alerts."""
    lack = F.greatest(F.least(100 * (1 - F.col("missing_ratio")), F.lit(100.0)), F.lit(0.0))
    scores = F.create_map(*[x for c in components for x in (F.lit(c), F.col(f"score_{c}"))])
    there = F.col("sqi").isNotNull()
    return F.struct(
        F.when(there, scores).otherwise(F.create_map(F.lit("missing"), lack)).alias("components"),
        F.col("raw_missing_ratio").alias("missing_ratio"),
        F.col("missing_ratio").alias("effective_missing_ratio"),
        *[F.when(there, F.col(c)).alias(c) for c in ("alert_level", "drift_alert", "spike_alert", "quality_class")],
    )


def with_times(df: DataFrame, key: str, time: str) -> DataFrame:
    """start_timestamp (of the row that confirmed the incident) and end_timestamp of incident rows."""
    w = by_signal(key)
    start = F.last(F.when(F.col("event") == "started", F.col(time)), ignorenulls=True).over(so_far(w))
    return df.withColumns({"start_timestamp": F.when(F.col("start_scan_index").isNotNull(), start), "end_timestamp": F.when(F.col("event") == "resolved", F.col(time))})


def signal_incidents(df: DataFrame, p: IncidentPolicy = IncidentPolicy(), run_id: str = "run") -> DataFrame:
    """Every row with its incident state; events are the rows whose ``event`` isn't null."""
    df = lifecycle(df, "signal_id", F.col("recovered"), p.start_persistence, p.end_persistence, ["cause", "severity"])
    held = by_signal(["signal_id", "start_scan_index"])
    worst = F.min(F.when(F.col("degraded") & F.col("active"), F.col("status_sqi"))).over(so_far(held))
    return df.withColumns(
        {
            "incident_id": F.when(F.col("start_scan_index").isNotNull(), F.concat_ws(":", F.lit(run_id), F.col("signal_id").cast("string"), F.col("start_scan_index").cast("string"))),
            "min_sqi": F.when(F.col("start_scan_index").isNotNull(), worst),
            "recommended_action": action_of(F.col("cause")),
            "message": signal_message(),
        }
    )


def group_of(signal: Column, p: GroupPolicy = GroupPolicy()) -> Column:
    """The first ``depth`` tokens of a signal id, null if it has fewer."""
    tokens = F.split(signal, r"\Q" + p.delimiter + r"\E")
    return F.when(F.size(tokens) >= p.depth, F.array_join(F.slice(tokens, 1, p.depth), p.delimiter))


def group_status(df: DataFrame, p: GroupPolicy = GroupPolicy()) -> DataFrame:
    """Per scan and group: members, degraded members, fraction, cause, severity, degraded.

    Where members carry ``comms_degraded``, its majority decides the cause; else missing against the rest.
    """
    hit = F.col("degraded")
    link = F.col("comms_degraded") if "comms_degraded" in df.columns else F.lit(None).cast("boolean")
    comms = F.sum(F.when(hit & (F.col("cause") == "missing"), 1).otherwise(0))
    g = df.where(F.col("group_id").isNotNull()).groupBy("group_id", "scan_ord")
    g = g.agg(
        F.count("*").alias("members"),
        F.sum(hit.cast("int")).alias("degraded_members"),
        F.array_join(F.sort_array(F.collect_list(F.when(hit, F.col("signal_id")))), ",").alias("degraded_signals"),
        comms.alias("_missing"),
        F.coalesce(F.sum(F.when(hit & link, 1).when(hit & ~link, -1)), F.lit(0)).alias("_vote"),
    )
    share = F.col("degraded_members") / F.col("members")
    rest = F.col("degraded_members") - F.col("_missing")
    cause = F.when(F.col("_vote") > 0, "comms").when(F.col("_vote") < 0, "data_quality").when(F.col("_missing") > rest, "comms").when(rest > F.col("_missing"), "data_quality").otherwise("mixed")
    return g.withColumns(
        {
            "fraction": share,
            "degraded": (F.col("degraded_members") >= p.min_members) & (share >= p.min_fraction),
            "cause": cause,
            "severity": F.when(share >= p.critical_fraction, "critical").otherwise("warning"),
        }
    ).drop("_missing", "_vote")


def group_incidents(df: DataFrame, p: GroupPolicy = GroupPolicy(), run_id: str = "run") -> DataFrame:
    """Group rows with their incident state; recovery is any scan in which the group isn't degraded."""
    df = lifecycle(df, "group_id", F.lit(True), p.start_persistence, p.end_persistence, ["cause", "severity", "degraded_signals"])
    name = F.concat_ws(":", F.lit(run_id), F.lit("group"), F.col("group_id"), F.col("start_scan_index").cast("string"))
    return df.withColumns({"group_incident_id": F.when(F.col("start_scan_index").isNotNull(), name), "message": group_message()})


def group_details(df: DataFrame) -> DataFrame:
    """Per scan and group: cause_counts and top_causes of its degraded members, as ``cause=n`` lists by name and by count."""
    per = df.where(F.col("group_id").isNotNull() & F.col("degraded")).groupBy("group_id", "scan_ord", "cause").agg(F.count("*").alias("n"))
    pairs = F.collect_list(F.struct((-F.col("n")).alias("less"), "cause", "n"))  # one entry a cause
    said = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat(x["cause"], F.lit("="), x["n"].cast("string"))), ",")
    got = per.groupBy("group_id", "scan_ord").agg(F.array_sort(pairs).alias("_p"))
    by_name = F.array_sort(F.transform("_p", lambda x: F.struct(x["cause"].alias("cause"), x["n"].alias("n"))))
    return got.select("group_id", "scan_ord", said(by_name).alias("cause_counts"), said(F.col("_p")).alias("top_causes"))


def active_groups(groups: DataFrame) -> DataFrame:
    """The incident that each group has after its last scan, if one is active."""
    last = groups.groupBy("group_id").agg(F.max_by(F.struct("active", "group_incident_id", "cause", "severity", "degraded_signals"), "scan_ord").alias("_l"))
    return last.select("group_id", "_l.*").where("active").drop("active")


def suppress(events: DataFrame, groups: DataFrame, causes: tuple[str, ...] = ("comms",), kinds: tuple[str, ...] = ("started", "updated"), passed: bool = True) -> DataFrame:
    """Signal events with ``suppressed`` (their group has an active incident of such a cause) and ``reemit_scan``.

    A suppressed event comes back at the scan in which its group's incident resolves. Resolved events pass
    if ``passed``, whatever ``kinds`` says. Groups are joined once, by group and scan.
    """
    after = Window.partitionBy("group_id").orderBy("scan_ord").rowsBetween(0, Window.unboundedFollowing)
    state = groups.select(
        "group_id",
        "scan_ord",
        (F.col("active") & F.lower("cause").isin(*causes)).alias("_hot"),
        F.first(F.when(F.col("event") == "resolved", F.col("scan_ord")), ignorenulls=True).over(after).alias("reemit_scan"),
    )
    joined = events.join(state, ["group_id", "scan_ord"], "left")
    off = F.coalesce(F.col("_hot"), F.lit(False)) & F.col("event").isin(*kinds)
    if passed:
        off = off & (F.col("event") != "resolved")
    return joined.withColumns({"suppressed": off, "reemit_scan": F.when(off, F.col("reemit_scan"))}).drop("_hot")


def suppression_counts(events: DataFrame) -> DataFrame:
    """Per scan: member events, those suppressed by kind, deferred, and emitted again."""
    n = lambda p: F.sum(F.when(p, 1).otherwise(0))
    off = F.col("suppressed")
    here = events.groupBy("scan_ord").agg(
        F.count("*").alias("total_events"),
        n(off).alias("suppressed_events"),
        *[n(off & (F.col("event") == e)).alias(f"suppressed_{e}") for e in ("started", "updated", "resolved")],
        n(off).alias("deferred_events"),
    )
    again = events.where("reemit_scan is not null").groupBy(F.col("reemit_scan").alias("scan_ord")).agg(F.count("*").alias("reemitted_events"))
    return here.join(again, "scan_ord", "full").fillna(0)


def impact(events: DataFrame, incident: str = "incident_id", time: str = "timestamp") -> DataFrame:
    """One row: events by type, incidents still active, and durations from confirmation to resolution (mean, and 50 and 95 % by nearest rank).

    ``events``: (event, ``incident``, ``time``); durations are 0 without resolved incidents.
    """
    ends = events.groupBy(incident).agg(
        F.count(F.when(F.col("event") == "started", 1)).alias("s"),
        F.count(F.when(F.col("event") == "updated", 1)).alias("u"),
        F.count(F.when(F.col("event") == "resolved", 1)).alias("r"),
        F.greatest(F.max(F.when(F.col("event") == "resolved", F.col(time))) - F.min(F.when(F.col("event") == "started", F.col(time))), F.lit(0.0)).alias("spent"),
    ).withColumn("spent", F.when(F.col("r") > 0, F.coalesce("spent", F.lit(0.0))))
    rank = lambda p: F.coalesce(F.expr(f"percentile_disc({p}) within group (order by spent)"), F.lit(0.0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return ends.agg(
        total("s").alias("started"), total("u").alias("updated"), total("r").alias("resolved"), total(F.when((F.col("s") > 0) & (F.col("r") == 0), 1).otherwise(0)).alias("active_end"),
        F.coalesce(F.avg("spent"), F.lit(0.0)).alias("mean_duration"), rank(0.5).alias("p50"), rank(0.95).alias("p95"),
    )


def started_by(events: DataFrame, *columns: str) -> DataFrame:
    """Started events counted by ``columns``: the histogram of causes, or the leaderboard of groups."""
    return events.where("event = 'started'").groupBy(*columns).agg(F.count("*").alias("n"))


def spam_ratio(events: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: started signal and group incidents and their ratio, 0 without group incidents."""
    a = events.agg(F.count(F.when(F.col("event") == "started", 1)).alias("signal_started"))
    b = groups.agg(F.count(F.when(F.col("event") == "started", 1)).alias("group_started"))
    ratio = F.when(F.col("group_started") > 0, F.col("signal_started") / F.col("group_started")).otherwise(0.0)
    return a.join(F.broadcast(b)).withColumn("ratio", ratio)

"""Communications: rollups over the topology, health classes, budgets, poll statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (("RTU", "rtu_id"), ("POLL_GROUP", "poll_group_id"), ("COMMS_DOMAIN", "comms_domain_id"))
#: Columns, the names their reasons have, and warning and critical limits, in the order of the reasons.
LIMITS = (
    ("timeout_rate", "timeout_rate", 0.02, 0.10),
    ("retry_rate", "retry_rate", 0.05, 0.20),
    ("crc_error_rate", "crc_error_rate", 0.001, 0.01),
    ("avg_poll_jitter_ms", "jitter_ms", 250.0, 750.0),
    ("avg_poll_cycle_ms", "poll_cycle_ms", 2000.0, 5000.0),
)
#: Fixed value: the order of node types in budgets and reports.
BUDGET_ORDER = ("COMMS_DOMAIN", "POLL_GROUP", "RTU")


@dataclass(frozen=True)
class BudgetConfig:
    """Polling interval, sizes, capacities by type and by node, and limits."""

    poll_interval_ms: float = 1000.0
    bytes_per_signal: int = 18
    overhead_bytes: int = 200
    capacity_bps: dict[str, int] = field(default_factory=lambda: {"RTU": 9600, "POLL_GROUP": 9600, "COMMS_DOMAIN": 9600})
    per_node_capacity_bps: dict[str, int] = field(default_factory=dict)
    degraded: float = 0.70
    critical: float = 0.90
    headroom: float = 0.10

    def __post_init__(self) -> None:
        if self.poll_interval_ms <= 0:
            raise ValueError("poll_interval_ms must be positive")
        if min([*self.capacity_bps.values(), *self.per_node_capacity_bps.values()]) <= 0:
            raise ValueError("capacities must be positive")


def rollup(metrics: DataFrame) -> DataFrame:
    """Per scan and node of each level: samples, rates (counts over samples), averages, byte sums."""
    nodes = F.array(*[F.struct(F.lit(t).alias("node_type"), F.col(c).cast("string").alias("node_id")) for t, c in LEVELS])
    rows = metrics.withColumn("_node", F.explode(nodes)).where(F.coalesce(F.col("_node.node_id"), F.lit("")) != "")
    n = F.count("*")
    return rows.groupBy("scan_index", F.col("_node.node_type").alias("node_type"), F.col("_node.node_id").alias("node_id")).agg(
        n.alias("sample_count"),
        (F.sum("timeout_count") / n).alias("timeout_rate"),
        (F.sum("retry_count") / n).alias("retry_rate"),
        (F.sum("crc_error_count") / n).alias("crc_error_rate"),
        F.avg("poll_cycle_ms").alias("avg_poll_cycle_ms"),
        F.avg("poll_jitter_ms").alias("avg_poll_jitter_ms"),
        F.sum("bytes_tx").alias("bytes_tx"),
        F.sum("bytes_rx").alias("bytes_rx"),
    )


def health(rollups: DataFrame, limits=LIMITS) -> DataFrame:
    """comms_class (OK, DEGRADED, CRITICAL) and reasons of rollups; unknown averages say nothing."""
    rank = [F.when(F.col(c) >= critical, 2).when(F.col(c) >= warn, 1).otherwise(0) for c, _, warn, critical in limits]
    worst = F.greatest(*rank)
    said = [F.when(r == 2, f"{name}_critical").when(r == 1, f"{name}_degraded") for r, (_, name, _, _) in zip(rank, limits, strict=True)]
    kind = F.when(worst == 2, "CRITICAL").when(worst == 1, "DEGRADED").otherwise("OK")
    return rollups.withColumns({"comms_class": kind, "reasons": F.array_join(F.array_compact(F.array(*said)), ",")})


def worst_nodes(healths: DataFrame, n: int = 10) -> DataFrame:
    """Per scan the ``n`` worst nodes of each class that isn't OK."""
    order = Window.partitionBy("scan_index", "comms_class").orderBy(F.desc("timeout_rate"), "node_type", "node_id")
    return healths.where("comms_class <> 'OK'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def budget(rollups: DataFrame, c: BudgetConfig = BudgetConfig(), signals: str | None = None) -> DataFrame:
    """Observed bits a second over the configured interval against capacity: utilization, headroom, level and reasons.

    ``signals`` names a column with the signals below a node; expected bytes inform only. Without bytes nothing was observed.
    """
    of_type = F.coalesce(*[F.when(F.col("node_type") == t, F.lit(v)) for t, v in c.capacity_bps.items()])
    named = F.create_map(*[F.lit(x) for pair in c.per_node_capacity_bps.items() for x in pair])[F.col("node_id")] if c.per_node_capacity_bps else F.lit(None).cast("int")
    observed = F.greatest(F.coalesce(F.col("bytes_tx") + F.col("bytes_rx"), F.lit(0)), F.lit(0))
    below = F.lit(0) if signals is None else F.greatest(F.coalesce(F.col(signals), F.lit(0)), F.lit(0))
    df = rollups.withColumns({"capacity_bps": F.coalesce(named, of_type), "observed_bytes": observed, "expected_bytes": (c.overhead_bytes + c.bytes_per_signal * below).cast("long")})
    df = df.withColumn("observed_bps", F.col("observed_bytes") * 8.0 / (c.poll_interval_ms / 1000))
    df = df.withColumn("utilization", F.col("observed_bps") / F.col("capacity_bps"))
    df = df.withColumn("headroom", 1 - F.col("utilization"))
    level = F.when(F.col("utilization") >= c.critical, "CRITICAL").when(F.col("utilization") >= c.degraded, "DEGRADED").otherwise("OK")
    df = df.withColumn("budget_level", level)
    used = F.when(F.col("budget_level") != "OK", F.concat(F.lit("UTILIZATION_"), F.col("budget_level")))
    return df.withColumn("budget_reasons", F.array_join(F.array_compact(F.array(used, F.when(F.col("headroom") <= c.headroom, "LOW_HEADROOM"))), ","))


def budget_of_all(nodes: DataFrame, rollups: DataFrame, c: BudgetConfig = BudgetConfig()) -> DataFrame:
    """The budget of every node (node_type, node_id, signals) in every scan with rollups, those without traffic too."""
    scans = rollups.select("scan_index").distinct()
    # a row a scan and node is the result asked for
    every = nodes.select("node_type", "node_id", "signals").join(scans)
    return budget(every.join(rollups, ["scan_index", "node_type", "node_id"], "left"), c, "signals")


def budget_summary(budgets: DataFrame, n: int = 10) -> DataFrame:
    """Per scan the bottleneck (place 1 of all nodes that aren't OK) and the ``n`` fullest nodes of each level."""
    kind = F.coalesce(*[F.when(F.col("node_type") == t, k) for k, t in enumerate(BUDGET_ORDER)])
    order = [F.when(F.col("budget_level") == "CRITICAL", 0).otherwise(1), F.desc("utilization"), kind, F.col("node_id")]
    rows = budgets.where("budget_level <> 'OK'")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("scan_index", "budget_level").orderBy(*order))).where(F.col("place") <= n)
    first = F.row_number().over(Window.partitionBy("scan_index").orderBy(*order))
    return rows.withColumn("is_bottleneck", first == 1)


def poll_health(polls: DataFrame) -> DataFrame:
    """degraded: a failed poll, a slow or jittery one, or a long dropout streak."""
    bad = ~F.col("poll_success") | (F.col("rtt_ms") >= 500) | (F.col("jitter_ms") >= 200) | (F.col("dropout_streak") >= 3)
    return polls.withColumn("degraded", F.coalesce(bad, F.lit(False)))


def poll_statistics(polls: DataFrame, key: str, order: str) -> DataFrame:
    """Running totals, failures, averages and longest streak per ``key``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total, failed = F.count("*").over(w), F.sum((~F.col("poll_success")).cast("int")).over(w)
    return polls.withColumns(
        {
            "total_polls": total,
            "failed_polls": failed,
            "successful_polls": total - failed,
            "failure_rate": failed / total,
            "current_dropout_streak": F.col("dropout_streak"),
            "avg_rtt_ms": F.avg("rtt_ms").over(w),
            "avg_jitter_ms": F.avg("jitter_ms").over(w),
            "max_dropout_streak": F.max("dropout_streak").over(w),
        }
    )


def quality_monitor(stats: DataFrame, key: str, order: str) -> DataFrame:
    """Trends of failure rate and latency over ten updates, a weighted score and its class.

    Input: the columns of ``poll_statistics`` per update. Scores are rounded to twelve digits, so that one that is
    exactly at a limit of a class meets it, whatever the order in which its averages were added up.
    """
    w = Window.partitionBy(key).orderBy(order)

    def trend(column: str) -> Column:
        lift = F.avg(column).over(w.rowsBetween(-4, 0)) - F.avg(column).over(w.rowsBetween(-9, -5))
        full = F.count(column).over(w.rowsBetween(-9, 0)) == 10
        return F.when(full & (lift > 0.05), "degrading").when(full & (lift < -0.05), "improving").otherwise("stable")

    part = lambda points, value, limit: F.greatest(points * (1 - value / limit), F.lit(0.0))
    score = (
        part(40, F.col("failure_rate"), 0.1)
        + part(30, F.col("avg_rtt_ms"), 500)
        + part(20, F.col("avg_jitter_ms"), 200)
        + (10 - F.least(F.col("max_dropout_streak") * 2, F.lit(10)))
    )
    df = stats.withColumns({"dropout_trend": trend("failure_rate"), "latency_trend": trend("avg_rtt_ms"), "quality_score": F.round(score, 12)})
    return df.withColumn("quality_class", F.when(F.col("quality_score") >= 90, "excellent").when(F.col("quality_score") >= 75, "good").when(F.col("quality_score") >= 50, "fair").when(F.col("quality_score") >= 25, "poor").otherwise("critical"))

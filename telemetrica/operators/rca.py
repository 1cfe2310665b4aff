"""Root-cause ranking over a topology: evidence, scores, confidence, reports, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetrica.functions.folds import TrackerConfig, confidence_step, ordered_fold, tracker_step
from telemetrica.functions.windows import by_signal, run_length_of
from telemetrica.operators.topology import TYPES, closure

#: Weights, least affected share and score ceiling.
WEIGHTS = {"coverage": 0.45, "concentration": 0.25, "coherence": 0.20, "signature": 0.10}
MIN_FRACTION = {"comms_domain": 0.25, "poll_group": 0.25, "rtu": 0.50, "signal": 1.00}
CEILING = 1.2
COHERENCE_SCANS = 5
COMMS_WEIGHTS = {"boost": 0.35, "counter": 0.25}
MULTIPLIER = {"comms_domain": 1.0, "poll_group": 1.0, "rtu": 0.5, "signal": 0.0}
LIKENESS = {"missing": 0.6, "coherence": 0.5, "other": 0.9}
LIKENESS_GATE, LIKENESS_SCANS = 0.35, 4
NORMS = {"utilization": (0.70, 0.90), "timeout_rate": (0.02, 0.10), "avg_poll_jitter_ms": (250.0, 750.0)}
CAUSES = ("noise", "drift", "spikes", "oscillation", "missing", "stale", "step", "plausibility")


def clamp(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def by_type(values: dict) -> Column:
    return F.coalesce(*[F.when(F.col("type") == t, F.lit(v)) for t, v in values.items()])


def observations(rows: DataFrame, classes: tuple[str, ...] = ("POOR", "BAD"), missing_limit: float = 0.2) -> DataFrame:
    """is_affected, cause and onset_scan per row (signal_id, scan_ord, quality_class, missing_ratio, event_cause, low_cause)."""
    known = F.upper(F.col("quality_class"))
    known = F.when(known.isin("EXCELLENT", "GOOD", "FAIR", "POOR", "BAD"), known).otherwise("GOOD")
    gone = F.coalesce(F.col("missing_ratio") >= missing_limit, F.lit(False))
    poor = known.isin(*classes)
    hit = F.col("event_cause").isNotNull() | poor | gone
    # the lowest component speaks for signals of an affected class only
    cause = F.coalesce("event_cause", F.when(poor, F.coalesce("low_cause", F.lit("unknown"))), F.when(gone, "missing"))
    cause = F.when(F.lower(F.trim(cause)).isin(*CAUSES), F.lower(F.trim(cause))).otherwise("unknown")
    w = by_signal()
    df = rows.withColumns({"quality_class": known, "is_affected": hit, "cause": F.when(hit, cause), "_n": F.row_number().over(w)})
    df = df.withColumn("_run", run_length_of("is_affected", "_n", w))
    # the run's first scan: the row that many rows back
    first = F.when(F.col("_run") == 1, F.col("scan_ord"))
    onset = F.last(first, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("onset_scan", F.when(F.col("is_affected"), onset)).drop("_n", "_run")


def descendants(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, signal_id): every node with the signals below it, signals with themselves."""
    signals = nodes.where("type = 'signal'").select("id")
    under = closure(edges).join(signals, F.col("descendant") == F.col("id"), "left_semi").select(F.col("ancestor").alias("node_id"), F.col("descendant").alias("signal_id"))
    return under.unionByName(signals.select(F.col("id").alias("node_id"), F.col("id").alias("signal_id")))


def evidence(obs: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = COHERENCE_SCANS) -> DataFrame:
    """Per scan and node: totals over all descendants, causes, onsets, coherence, signature, concentration."""
    under = descendants(nodes, edges)
    totals = under.groupBy("node_id").agg(F.count("*").alias("total"))
    hit = F.col("is_affected")
    count = lambda *names: F.sum(F.when(hit & F.col("cause").isin(*names), 1).otherwise(0))
    got = obs.join(under, "signal_id").groupBy("scan_ord", "node_id").agg(
        F.sum(hit.cast("int")).alias("affected"),
        F.min(F.when(hit, F.col("onset_scan"))).alias("onset_min"),
        F.max(F.when(hit, F.col("onset_scan"))).alias("onset_max"),
        count("missing", "stale").alias("comms_causes"),
        count("noise", "drift", "spikes", "oscillation").alias("quality_causes"),
        F.count(F.when(hit, F.col("cause"))).alias("causes"),
    )
    got = got.join(totals, "node_id").join(nodes.withColumnRenamed("id", "node_id"), "node_id")
    span = F.coalesce(F.col("onset_max") - F.col("onset_min"), F.lit(0))
    got = got.withColumns(
        {
            "fraction": F.col("affected") / F.col("total"),
            "onset_span": span,
            "coherence": F.exp(-span / k),
            "signature": F.when(F.col("affected") > 0, F.col("comms_causes") / F.col("affected")).otherwise(0.0),
        }
    )
    # the best of a node's siblings is the best under its parent, or the second best where the node is that itself
    under_what = edges.select(F.col("child").alias("node_id"), F.col("parent").alias("_over"))
    got = got.join(under_what, "node_id", "left").withColumn("_over", F.coalesce("_over", F.concat(F.lit("\x00"), "type")))
    mine = F.struct(F.col("fraction"), F.col("node_id"))
    top = got.groupBy("scan_ord", "_over").agg(F.max(mine).alias("_one"))
    got = got.join(top, ["scan_ord", "_over"])
    second = got.where(F.col("node_id") != F.col("_one.node_id")).groupBy("scan_ord", "_over").agg(F.max("fraction").alias("_two"))
    got = got.join(second, ["scan_ord", "_over"], "left")
    best = F.when(F.col("node_id") == F.col("_one.node_id"), F.col("_two")).otherwise(F.col("_one.fraction"))
    return got.withColumn("concentration", F.coalesce(F.col("fraction") - best, F.lit(0.0))).drop("_over", "_one", "_two")


def representatives(obs: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """Per scan and node its affected signals, worst index first, then by onset and id: (scan_ord, node_id, place, signal_id)."""
    under = descendants(nodes, edges)
    rows = obs.where("is_affected").join(under, "signal_id")
    order = Window.partitionBy("scan_ord", "node_id").orderBy(F.coalesce("sqi", F.lit(100.0)), F.coalesce("onset_scan", F.lit(999_999_999)), "signal_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("scan_ord", "node_id", "place", "signal_id")


def likeness(obs: DataFrame) -> DataFrame:
    """Per scan how much the affected signals look like lost communications, 0 below the gate."""
    hit, gone = F.col("is_affected"), F.col("is_affected") & F.col("cause").isin("missing", "stale")
    n, m = F.sum(hit.cast("int")), F.sum(gone.cast("int"))
    span = F.max(F.when(gone, F.col("onset_scan"))) - F.min(F.when(gone, F.col("onset_scan")))
    raw = LIKENESS["missing"] * m / n + LIKENESS["coherence"] * F.coalesce(F.exp(-span / LIKENESS_SCANS), F.lit(0.0)) - LIKENESS["other"] * (n - m) / n
    value = clamp(F.coalesce(F.when(n > 0, raw), F.lit(0.0)))
    return obs.groupBy("scan_ord").agg(F.when(value >= LIKENESS_GATE, value).otherwise(0.0).alias("likeness"))


def strength(comms: DataFrame) -> DataFrame:
    """Per scan and node the mean of its three normalised comms measures, 0 if one is unknown."""
    parts = [clamp((F.col(c) - a) / (b - a)) for c, (a, b) in NORMS.items()]
    return comms.select("scan_ord", "node_id", F.coalesce(clamp(sum(parts[1:], parts[0]) / len(parts)), F.lit(0.0)).alias("strength"))


def candidates(ev: DataFrame, like: DataFrame | None = None, strong: DataFrame | None = None) -> DataFrame:
    """Scored and ranked candidates per scan."""
    ev = ev.withColumn("score_concentration", clamp((F.col("concentration") + 1) / 2))
    total = WEIGHTS["coverage"] * F.col("fraction") + WEIGHTS["concentration"] * F.col("score_concentration") + WEIGHTS["coherence"] * F.col("coherence") + WEIGHTS["signature"] * F.col("signature")
    if like is not None and strong is not None:
        ev = ev.join(like, "scan_ord", "left").join(strong, ["scan_ord", "node_id"], "left").fillna(0.0, ["likeness", "strength"])
        multiplied = by_type(MULTIPLIER) * F.col("likeness")
        aligned = clamp(F.col("fraction")) * clamp(F.col("concentration"))
        ev = ev.withColumns(
            {
                "comms_boost": COMMS_WEIGHTS["boost"] * multiplied * F.col("strength") * aligned,
                "comms_counter": COMMS_WEIGHTS["counter"] * multiplied * (1 - F.col("strength")) * clamp(F.col("fraction")),
            }
        )
        total = total + F.col("comms_boost") - F.col("comms_counter")
    ev = ev.where(F.col("fraction") >= by_type(MIN_FRACTION)).withColumn("score", clamp(total / CEILING))
    comms = F.col("comms_causes") / F.col("causes") > 0.7
    path = by_type({"comms_domain": "CHECK_NETWORK_INFRASTRUCTURE", "poll_group": "CHECK_POLL_GROUP_CONFIG", "rtu": "CHECK_RTU_CONNECTIVITY", "signal": "CHECK_SIGNAL_PATH"})
    action = F.when(F.col("causes") == 0, "INVESTIGATE").when(comms, path).when(F.col("quality_causes") / F.col("causes") > 0.5, "CHECK_SENSOR_CALIBRATION").otherwise("INVESTIGATE")
    rank = Window.partitionBy("scan_ord").orderBy(F.desc("score"), by_type({t: k for k, t in enumerate(TYPES)}), "node_id")
    return ev.withColumns({"action": action, "rank": F.row_number().over(rank), "next_score": F.lead("score").over(rank)})


def confidences(cands: DataFrame, required: int = 2, scale: float = 0.2, threshold: float = 0.0) -> DataFrame:
    """confidence and label: score, lead over the next ranked, and scans in a row as a candidate."""
    margin = F.coalesce(F.col("score") - F.col("next_score"), F.lit(scale))
    if threshold > 0:
        rows = cands.withColumn("_margin", margin)
        folded = ordered_fold(rows, "node_id", "scan_ord", ["scan_ord", "score", "_margin"], "confidence double, stable_scans long", lambda: None, confidence_step(required, scale, threshold))
        out = cands.join(folded, ["node_id", "scan_ord"])
    else:
        w = by_signal("node_id")
        start = F.when(F.lag("scan_ord").over(w) == F.col("scan_ord") - 1, None).otherwise(F.col("scan_ord"))
        first = F.last("_first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        out = cands.withColumn("_first", start).withColumn("stable_scans", F.col("scan_ord") - first).drop("_first")
        out = out.withColumn("confidence", clamp(0.4 * F.col("score") + 0.3 * clamp(margin / scale) + 0.3 * F.least(F.col("stable_scans") / required, F.lit(1.0))))
    label = F.when(F.col("confidence") >= 0.9, "VERY_HIGH").when(F.col("confidence") >= 0.75, "HIGH").when(F.col("confidence") >= 0.5, "MODERATE").when(F.col("confidence") >= 0.25, "LOW").otherwise("VERY_LOW")
    return out.withColumn("confidence_label", label)


def report(obs: DataFrame, ranked: DataFrame, min_confidence: float = 0.0, secondaries: int = 5) -> DataFrame:
    """Per scan: overall_state, observed and affected signals, the primary candidate if confident enough, and the next ones.

    ``secondary`` joins the ids ranked behind the primary by commas; ``impacted_*`` those of affected nodes by type.
    """
    state = obs.groupBy("scan_ord").agg(F.count("*").alias("observed"), F.sum(F.col("is_affected").cast("int")).alias("affected_signals"))
    word = F.when(F.col("affected_signals") == 0, "OK").when(F.col("affected_signals") > 0.5 * F.col("observed"), "OUTAGE").otherwise("DEGRADED")
    later = F.when((F.col("rank") > 1) & (F.col("rank") <= 1 + secondaries), F.struct("rank", "node_id"))
    top = ranked.groupBy("scan_ord").agg(
        F.min_by(F.struct("node_id", "type", "score", "confidence"), "rank").alias("_p"),
        F.array_join(F.transform(F.array_sort(F.collect_list(later)), lambda x: x["node_id"]), ",").alias("secondary"),  # at most ``secondaries``
    )
    joined = state.withColumn("overall_state", word).join(top, "scan_ord", "left").withColumn("secondary", F.coalesce("secondary", F.lit("")))
    sure = F.when(F.col("_p.confidence") >= min_confidence, F.col("_p"))
    names = {"primary_node_id": "node_id", "primary_type": "type", "primary_score": "score", "primary_confidence": "confidence"}
    return joined.select("scan_ord", "observed", "affected_signals", "overall_state", *[sure[c].alias(k) for k, c in names.items()], "secondary")


def impacted(ev: DataFrame) -> DataFrame:
    """(scan_ord, type, node_id) of the nodes with affected signals below them."""
    return ev.where("affected > 0").select("scan_ord", "type", "node_id")


def supporting(events: DataFrame, most: int = 30) -> DataFrame:
    """Per scan the incident events (signal_id, sqi) that support a report: lowest index first, then by id."""
    order = Window.partitionBy("scan_ord").orderBy(F.coalesce("sqi", F.lit(100.0)), "signal_id")
    return events.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def track(ranked: DataFrame, last_scan: DataFrame, c: TrackerConfig = TrackerConfig()) -> DataFrame:
    """Node incidents by fold. A node that isn't a candidate any more gets one row without score in the scan after
    its last one in a row, which closes its incident; later ones would change nothing. ``last_scan``: one row, scan_ord.
    """
    w = by_signal("node_id")
    rows = ranked.select("node_id", "scan_ord", "score", "confidence")
    ends = rows.withColumn("_next", F.lead("scan_ord").over(w)).where(F.coalesce(F.col("_next") != F.col("scan_ord") + 1, F.lit(True)))
    gaps = ends.join(F.broadcast(last_scan.select(F.col("scan_ord").alias("_last")))).where(F.col("scan_ord") < F.col("_last"))
    gaps = gaps.select("node_id", (F.col("scan_ord") + 1).alias("scan_ord"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("confidence"))
    outputs = "action string, peak_confidence double, peak_score double, start_scan long"
    return ordered_fold(rows.unionByName(gaps), "node_id", "scan_ord", ["scan_ord", "score", "confidence"], outputs, lambda: None, tracker_step(c)).where("action <> 'none'")


def suppressors(active: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("comms_domain", "poll_group", "rtu"), least: float = 0.5) -> DataFrame:
    """Per descendant of an active, confident incident's node the one that suppresses it: most confident, then by id."""
    strong = active.where(F.col("type").isin(*kinds) & (F.col("peak_confidence") >= least))
    rows = strong.join(closure(edges), strong["node_id"] == F.col("ancestor"))
    first = Window.partitionBy("scan_ord", "descendant").orderBy(F.desc("peak_confidence"), "node_id")
    return rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("scan_ord", F.col("descendant").alias("node_id"), F.col("ancestor").alias("suppressed_by"))


def unsuppressed(rows: DataFrame, by: DataFrame) -> DataFrame:
    """Rows (scan_ord, node_id) that nothing suppresses."""
    return rows.join(by, ["scan_ord", "node_id"], "left_anti")


def onset_state(obs: DataFrame) -> DataFrame:
    """What a later run has to know of signals: (signal_id, last_scan, is_affected, cause, quality_class, onset_scan) after the last scan."""
    last = obs.groupBy("signal_id").agg(F.max_by(F.struct(F.col("scan_ord").alias("last_scan"), "is_affected", "cause", "quality_class", "onset_scan"), "scan_ord").alias("_l"))
    return last.select("signal_id", "_l.*")


def stability_state(ranked: DataFrame) -> DataFrame:
    """Of the candidates of the last scan their scans in a row: (node_id, last_scan, stable_scans); others have lost theirs."""
    last = ranked.agg(F.max("scan_ord").alias("_last"))  # one row
    now = ranked.join(F.broadcast(last), F.col("scan_ord") == F.col("_last"))
    return now.select("node_id", F.col("scan_ord").alias("last_scan"), (F.col("stable_scans") + 1).alias("stable_scans"))


def pruned(state: DataFrame, scan: int, kept: int) -> DataFrame:
    """State of what was seen within ``kept`` scans before ``scan``, or is affected still."""
    stays = F.col("last_scan") >= scan - kept
    return state.where(stays | F.col("is_affected") if "is_affected" in state.columns else stays)


def resumed(obs: DataFrame, state: DataFrame) -> DataFrame:
    """Observations of a later run with the onsets of runs that began before it: a run that starts in its first scan goes on."""
    first = obs.groupBy("signal_id").agg(F.min("scan_ord").alias("_first"))
    before = state.where("is_affected").select("signal_id", F.col("onset_scan").alias("_onset"), F.col("last_scan").alias("_until"))
    rows = obs.join(first, "signal_id").join(before, "signal_id", "left")
    goes_on = (F.col("onset_scan") == F.col("_first")) & (F.col("_first") == F.col("_until") + 1)
    return rows.withColumn("onset_scan", F.when(goes_on, F.col("_onset")).otherwise(F.col("onset_scan"))).drop("_first", "_onset", "_until")


def top_only(state: DataFrame, ranked: DataFrame, top: int = 3) -> DataFrame:
    """Stability of all but the ``top`` ranked candidates set back to 0."""
    good = ranked.where(F.col("rank") <= top).select("node_id", F.col("scan_ord").alias("last_scan"), F.lit(True).alias("_top"))
    return state.join(good, ["node_id", "last_scan"], "left").withColumn("stable_scans", F.when(F.col("_top"), F.col("stable_scans")).otherwise(0)).drop("_top")

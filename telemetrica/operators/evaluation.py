"""Evaluation of predictions against labelled intervals, parameter grids, gates and cost models."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetrica.operators.signals import SignalConfig


def match(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """Greedy matches (signal_id, pred_start, pred_end, label_start, label_end, causes and severities): in order of start,
    each prediction takes the first unused label that overlaps it. Predictions and labels are merged by start, and a
    label that ended before a prediction's start is let go, so only those that may still match are held.

    Predictions may hold cause and severity, labels too; without them they are null. A prediction that ends after a
    label begins that is still to come waits for it, so it is decided once a row begins behind its end.
    """
    extra = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    part = lambda df, kind: df.select(
        "signal_id", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.lit(kind).alias("kind"), extra(df, "cause"), extra(df, "severity")
    )
    rows = part(labels, 0).unionByName(part(predicted, 1))
    kind = predicted.schema["signal_id"].dataType.simpleString()
    names = ["signal_id", "pred_start", "pred_end", "label_start", "label_end", "cause", "severity", "label_cause", "label_severity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, free, waiting = None, [], []
        schema = None

        def decide(before: int | None) -> list[tuple]:
            """Rows of waiting predictions that end before ``before`` (all without it), in order of start."""
            out = []
            while waiting and (before is None or waiting[0][1] < before):
                s, e, *said = waiting.pop(0)
                free[:] = [x for x in free if x[1] >= s]  # later predictions begin no earlier
                hit = next((k for k, x in enumerate(free) if x[0] <= e), None)
                label = free.pop(hit) if hit is not None else (None,) * 4
                out.append((current, s, e, label[0], label[1], *said, label[2], label[3]))
            return out

        def packed(out: list[tuple]) -> pa.RecordBatch:
            types = [schema.field("signal_id").type] + [pa.int64()] * 4 + [pa.string()] * 4
            columns = list(zip(*out, strict=True)) or [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            schema = batch.schema
            out: list[tuple] = []
            for signal, s, e, is_prediction, cause, severity in zip(*[batch.column(c).to_pylist() for c in ("signal_id", "s", "e", "kind", "cause", "severity")], strict=True):
                if signal != current:
                    out += decide(None)
                    current, free = signal, []
                out += decide(s)
                (waiting if is_prediction else free).append((s, e, cause, severity))
            yield packed(out)
        if waiting:
            yield packed(decide(None))

    dealt = rows.repartition("signal_id").sortWithinPartitions("signal_id", "s", "kind", "e")
    return dealt.mapInArrow(run, f"signal_id {kind}, pred_start long, pred_end long, label_start long, label_end long, cause string, severity string, label_cause string, label_severity string")


def metrics(matches: DataFrame, labels: DataFrame, group_started: int = 0) -> DataFrame:
    """One row: precision, recall, f1, mean scans to detection, accuracy of causes and severities where labels name them,
    and starts of signals for one of a group; all 0 where undefined.
    """
    hit = F.col("label_start").isNotNull()
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    named = lambda c: F.count(F.when(hit & F.col(f"label_{c}").isNotNull(), 1))
    right = lambda c: F.count(F.when(hit & F.col(f"label_{c}").isNotNull() & (plain(c) == plain(f"label_{c}")), 1))
    found = matches.agg(
        F.count("*").alias("predicted"),
        F.count("label_start").alias("matched"),
        F.avg(F.when(hit, F.greatest(F.col("pred_start") - F.col("label_start"), F.lit(0)))).alias("mttd"),
        *[f(c).alias(f"_{k}_{c}") for c in ("cause", "severity") for k, f in (("named", named), ("right", right))],
    )
    both = found.join(F.broadcast(labels.agg(F.count("*").alias("labels"))))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = both.withColumns(
        {
            "precision": share("matched", "predicted"),
            "recall": share("matched", "labels"),
            "mttd_scans": F.coalesce("mttd", F.lit(0.0)),
            "cause_accuracy": share("_right_cause", "_named_cause"),
            "severity_accuracy": share("_right_severity", "_named_severity"),
            "starts_ratio": F.col("predicted") / max(1, group_started),
        }
    )
    total = F.col("precision") + F.col("recall")
    out = out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))
    return out.drop("mttd", *[f"_{k}_{c}" for c in ("cause", "severity") for k in ("named", "right")])


def grid(spark, params: dict[str, list]) -> DataFrame:
    """All combinations of parameter values."""
    out = spark.range(1).drop("id")
    for name, values in params.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def passes(gates: dict[str, tuple[str, float]]) -> Column:
    """True where every gate (column: (">=" or "<=", limit)) holds."""
    tests = [F.col(c) >= v if op == ">=" else F.col(c) <= v for c, (op, v) in gates.items()]
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def rank_percentile(rows: DataFrame, column: str, p: float) -> DataFrame:
    """One row: the value at rank ``int(p * (n - 1))`` of the sorted values, from counts per value.

    Only distinct values meet in the last window, so it is for columns of few values, such as counts.
    """
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    order = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return upto.where(F.col("upto") > F.floor(p * (F.col("all") - 1))).agg(F.min("value").alias("value"))


#: Cost of a sample per hundred samples of each window.
COSTS = {"ma_window": 0.02, "variance_window": 0.03, "frequency_window": 0.04, "missing_window": 0.01, "stale_window": 0.02}
STEP_COST, FFT_FACTOR, SIGNAL_BYTES = 0.02, 1.15, 256


def cost_per_signal(c: SignalConfig, fft: bool = False) -> float:
    """The model's cost of one signal in one scan."""
    windows = sum(w * max(1, getattr(c, name)) for name, w in COSTS.items()) + STEP_COST * max(1, c.step.baseline)
    return (1 + windows / 100) * (FFT_FACTOR if fft else 1)


def scan_cost(rows: DataFrame, c: SignalConfig, fft: bool = False) -> DataFrame:
    """One row: the 95 % rank of scan costs and the model's bytes of state; rows: (scan_ord, signal_id)."""
    sizes = rows.groupBy("scan_ord").agg(F.count("*").alias("signals"))
    kept = (c.ma_window, c.variance_window, c.frequency_window * (2 if fft else 1), c.missing_window, c.stale_window, c.stale_recovery, c.step.baseline, c.step.persistence, c.step.recovery)
    each = sum(kept) * 8 + SIGNAL_BYTES
    p95 = rank_percentile(sizes, "signals", 0.95).select((F.coalesce("value", F.lit(0)) * cost_per_signal(c, fft)).alias("scan_p95_estimate"))
    memory = rows.select("signal_id").distinct().agg((F.count("*") * float(each)).alias("memory_estimate_bytes"))
    return p95.join(F.broadcast(memory))


def composite(weights: dict[str, float]) -> Column:
    """A weighted sum of metric columns, by normalised weights."""
    total = sum(weights.values())
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.col(name) * (w / total)
    return out

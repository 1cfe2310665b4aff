"""Ordered folds: one pure step per row, carried along sorted partitions in bounded memory.

``ordered_fold`` deals rows by key, sorts them within partitions and streams Arrow batches through the
step, so a key of any length needs the memory of one batch and one state. The same steps serve
Structured Streaming through ``telemetrica.streaming``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, key: str, order: str, inputs: list[str], outputs: str, start: Callable, step: Callable, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``outputs`` (DDL) of ``step(state, *inputs) -> (state, values)`` per key in order."""
    keep = keep or [key, order]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [x.strip().rsplit(" ", 1)[0] for x in outputs.split(",")]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, begun = None, None, False
        for batch in batches:
            rows = zip(batch.column(key).to_pylist(), *[batch.column(c).to_pylist() for c in inputs], strict=True)
            out: list[list] = [[] for _ in names]
            for k, *values in rows:
                if not begun or k != current:
                    current, state, begun = k, start(), True
                state, result = step(state, *values)
                for column, value in zip(out, result, strict=True):
                    column.append(value)
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_pydict({**dict(zip(keep, columns, strict=True)), **dict(zip(names, out, strict=True))})

    columns = list(dict.fromkeys([*keep, key, order, *inputs]))
    dealt = df.select(*columns).repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInArrow(run, schema)


# --- smoothing -------------------------------------------------------------------------------------


def ewma_step(alpha: float) -> Callable:
    """Exponentially weighted mean; the first value passes, missing values leave it as it is."""

    def step(state: float | None, x: float | None) -> tuple:
        if x is None:
            return state, (None, None)
        y = x if state is None else alpha * x + (1 - alpha) * state
        return y, (y, x - y)

    return step


# --- step changes ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class StepConfig:
    baseline: int = 10
    threshold: float = 5.0
    persistence: int = 3
    recovery: int = 5


def step_change_step(c: StepConfig) -> Callable:
    """State: recent values, candidate, snapshot, confirmations, recoveries, active."""

    def step(state: tuple, x: float | None) -> tuple:
        window, candidate, snapshot, confirm, recover, active = state
        if x is None:
            return state, (active, None if candidate is None else candidate - snapshot)
        window = (*window, x)[-c.baseline :]
        total = 0.0
        for v in window:  # plain addition, as windows in SQL do it: Python's sum compensates and settles ties with the threshold otherwise
            total += v
        mean = total / len(window)
        if active:
            recover = recover + 1 if len(window) == c.baseline and abs(mean - candidate) <= c.threshold else 0
            if recover >= c.recovery:
                candidate = snapshot = None
                confirm, recover, active = 0, 0, False
        elif candidate is None:
            if len(window) == c.baseline and abs(x - mean) >= c.threshold:
                candidate, snapshot, confirm = x, mean, 1
        elif abs(x - candidate) <= c.threshold:
            confirm += 1
            if confirm >= c.persistence:
                active, recover = True, 0
        else:
            candidate = snapshot = None
            confirm = 0
        return (window, candidate, snapshot, confirm, recover, active), (active, None if candidate is None else candidate - snapshot)

    return step


# --- innovation ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class InnovationConfig:
    q: float = 0.01
    r: float = 1.0
    beta: float = 0.05
    s_min: float = 1e-12
    p0: float = 1e6
    v0: float = 1e4
    clip: float | None = None
    z_spike: float = 6.0
    interval: float = 0.1


def innovation_step(c: InnovationConfig) -> Callable:
    """Constant-velocity filter: residual, S, z, v, eta, spike, spike average, drift step, drift average.

    State: position (null before the first value), velocity, the three covariances, eta, the last
    time used, and both averages. A missing value only predicts.
    """
    most = math.inf if c.clip is None else c.clip * c.clip

    def step(state: tuple | None, y: float | None, t: float | None) -> tuple:
        p, v, a, b, d, eta, last, spikes, drifts = state or (None, 0.0, 0.0, 0.0, 0.0, 0.0, None, 0.0, 0.0)
        dt = c.interval if t is None or last is None else max(0.0, t - last)
        last = t if last is None else max(last, t) if t is not None else last
        if p is None:
            if y is None:
                return (p, v, a, b, d, eta, last, spikes, drifts), (None, max(c.r, c.s_min), None, v, eta, False, spikes, None, drifts)
            p, a, b, d, e, z = y, c.p0, 0.0, c.v0, 0.0, 0.0
            s = max(a + c.r, c.s_min)
        else:
            p += v * dt
            a, b, d = a + dt * (2 * b + dt * d) + c.q * dt**3 / 3, b + dt * d + c.q * dt * dt / 2, d + c.q * dt
            s = max(a + c.r, c.s_min)
            if y is None:
                return (p, v, a, b, d, eta, last, spikes, drifts), (None, s, None, v, eta, False, spikes, None, drifts)
            e = y - p
            z = e / math.sqrt(s)
            g, h = a / s, b / s
            p, v = p + g * e, v + h * e
            a, b, d = (1 - g) * a, (1 - g) * b, d - h * b
        eta += c.beta * (min(z * z, most) - eta)
        spike = abs(z) >= c.z_spike
        spikes += c.beta * (spike - spikes)
        moved = None
        if not spike and dt > 0:
            moved = abs(v) * dt
            drifts += c.beta * (moved - drifts)
        return (p, v, a, b, d, eta, last, spikes, drifts), (e, s, z, v, eta, spike, spikes, moved, drifts)

    return step


# --- tracked nodes and labels ----------------------------------------------------------------------


@dataclass(frozen=True)
class TrackerConfig:
    start_confidence: float = 0.7
    start_score: float = 0.5
    continue_confidence: float = 0.3
    continue_score: float = 0.2
    cooldown: int = 3


def tracker_step(c: TrackerConfig) -> Callable:
    """A node's incident: close, then cooldown, then update or open. Outputs action, peaks, start."""

    def step(state: tuple | None, scan: int, score: float | None, confidence: float | None) -> tuple:
        start, peak_c, peak_s, until = state or (None, 0.0, 0.0, None)
        action = "none"
        if start is not None and (score is None or confidence < c.continue_confidence or score < c.continue_score):
            action, began, peaks = "closed", start, (peak_c, peak_s)
            start, peak_c, peak_s, until = None, 0.0, 0.0, scan + c.cooldown
            if score is None or scan < until:
                return (start, peak_c, peak_s, until), (action, *peaks, began)
        if score is None or (start is None and until is not None and scan < until):
            return (start, peak_c, peak_s, until), (action, None, None, None)
        if start is not None:
            peak_c, peak_s = max(peak_c, confidence), max(peak_s, score)
            return (start, peak_c, peak_s, until), ("updated", peak_c, peak_s, start)
        if confidence >= c.start_confidence and score >= c.start_score:
            start, peak_c, peak_s = scan, confidence, score
            return (start, peak_c, peak_s, until), ("opened", peak_c, peak_s, start)
        return (start, peak_c, peak_s, until), (action, None, None, None)

    return step


def confidence_step(required: int = 2, margin_full: float = 0.2, threshold: float = 0.0) -> Callable:
    """Confidence of a candidate: score, lead over the next and scans in a row; a gap starts anew."""

    def step(state: tuple | None, scan: int, score: float, margin: float) -> tuple:
        last, count = state or (None, 0)
        if last is not None and scan != last + 1:
            count = 0
        value = 0.4 * min(max(score, 0.0), 1.0) + 0.3 * min(max(margin / margin_full, 0.0), 1.0) + 0.3 * min(count / required, 1.0)
        return (scan, count + 1 if value >= threshold else 0), (value, count)

    return step

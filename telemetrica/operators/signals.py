"""Per-signal operators as columns over one window: conditioning, detectors, quality index.

Input of every function: rows (signal_id, scan_ord, value, ...) of non-missing samples unless said
otherwise; each adds columns. All share ``by_signal()``, so a chain of them is planned with one
exchange and one sort.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetrica.functions.folds import InnovationConfig, StepConfig, ewma_step, innovation_step, ordered_fold, step_change_step
from telemetrica.functions.windows import by_signal, last_rows, latch, run_length_of, so_far

COMPONENTS = ("noise", "drift", "spikes", "oscillation", "missing", "stale", "step", "plausibility")


@dataclass(frozen=True)
class SignalConfig:
    """Defaults of a signal; every field can be overridden."""

    alpha: float = 0.3
    ma_window: int = 10
    drift_small: float = 0.5
    drift_large: float = 5.0
    sustained_window: int = 10
    sustained_share: float = 0.7
    monotonic_window: int = 5
    variance_window: int = 20
    spike_sigma: float = 3.0
    spike_debounce: int = 1
    missing_window: int = 100
    stale_window: int = 5
    stale_recovery: int = 3
    step: StepConfig = field(default_factory=StepConfig)
    value_min: float | None = None
    value_max: float | None = None
    max_rate: float | None = None
    plausibility_persistence: int = 1
    plausibility_recovery: int = 1
    frequencies: tuple[float, ...] = ()
    frequency_window: int = 50
    frequency_threshold: float = 0.5
    sample_interval: float = 0.1
    cadence: int = 1
    innovation: InnovationConfig = field(default_factory=InnovationConfig)
    innovation_enabled: bool = False
    weights: tuple[float, ...] = (0.25, 0.25, 0.20, 0.15, 0.15, 0.0, 0.0, 0.0)
    noise_threshold: float = 0.1
    drift_threshold: float = 1.0
    spike_threshold: float = 0.05
    oscillation_threshold: float = 0.3
    sqi_critical: float = 25.0
    sqi_warning: float = 50.0
    drift_alert: float = 5.0
    spike_alert: float = 0.1

    def __post_init__(self) -> None:
        if not 0 < self.alpha <= 1:
            raise ValueError("alpha must be in (0, 1]")
        for name in ("ma_window", "variance_window", "missing_window", "stale_window", "stale_recovery", "frequency_window", "cadence"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if min(self.weights) < 0 or sum(self.weights) <= 0:
            raise ValueError("weights must not be negative and must not all be zero")
        if self.value_min is not None and self.value_max is not None and self.value_min > self.value_max:
            raise ValueError("value_min is above value_max")

    def normalised_weights(self) -> dict[str, float]:
        total = sum(self.weights)
        return {c: w / total for c, w in zip(COMPONENTS, self.weights, strict=True)}

    def enabled(self, required: set[str] = frozenset()) -> set[str]:
        """Detectors to plan: those with weight or required; raises if a required one can't run."""
        able = {
            "oscillation": bool(self.frequencies),
            "plausibility": any(x is not None for x in (self.value_min, self.value_max, self.max_rate)),
        }
        wanted = {c for c, w in self.normalised_weights().items() if w > 0} | set(required)
        impossible = {c for c in required if not able.get(c, True)}
        if impossible:
            raise ValueError(f"required but not configured: {sorted(impossible)}")
        return {c for c in wanted if able.get(c, True)}


DEFAULT = SignalConfig()


# --- conditioning ----------------------------------------------------------------------------------


def quality_mask(df: DataFrame) -> DataFrame:
    """value is null where quality is bad; penalty 1 for missing, 0.5 for uncertain, else 0."""
    bad = F.lower(F.trim("quality")) == "bad"
    value = F.when(~F.coalesce(bad, F.lit(False)), F.col("value"))
    penalty = F.when(value.isNull(), 1.0).when(F.lower(F.trim("quality")) == "uncertain", 0.5).otherwise(0.0)
    return df.withColumn("penalty", penalty).withColumn("value", value)


def moving_average(df: DataFrame, c: SignalConfig = DEFAULT) -> DataFrame:
    return df.withColumn("filtered_ma", F.avg("value").over(last_rows(by_signal(), c.ma_window)))


def filter_bank(df: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """Named filters side by side."""
    return df.withColumns(filters)


def smooth(df: DataFrame, c: SignalConfig = DEFAULT) -> DataFrame:
    """filtered_ewma and highpass, by fold."""
    return ordered_fold(df, "signal_id", "scan_ord", ["value"], "filtered_ewma double, highpass double", lambda: None, ewma_step(c.alpha), df.columns)


def buffer_reads(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` values, the latest and the previous one, and whether the buffer is full."""
    frame = last_rows(by_signal(), n)
    return df.withColumns(
        {
            "samples": F.collect_list("value").over(frame),
            "previous": F.lag("value").over(by_signal()),
            "is_full": F.count("value").over(frame) == n,
        }
    )


# --- drift -----------------------------------------------------------------------------------------


def drift(df: DataFrame, c: SignalConfig = DEFAULT) -> DataFrame:
    """drift, monotonic_samples, drift_type and drift_severity."""
    w = by_signal()
    df = df.withColumns({"drift": F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0)), "_n": F.row_number().over(w)})
    sign = F.when((F.abs("drift") >= c.drift_small) & (F.abs("drift") > 0), F.signum("drift")).otherwise(0.0)
    df = df.withColumn("_sign", sign)
    df = df.withColumn("_goes_on", (F.col("_sign") != 0) & (F.col("_sign") == F.lag("_sign").over(w)))
    run = F.when(F.col("_sign") == 0, 0).otherwise(run_length_of("_goes_on", "_n", w) + 1)
    recent = last_rows(w, c.sustained_window)
    moves = F.when(F.col("_n") > 1, F.abs("drift"))
    df = df.withColumns(
        {
            "monotonic_samples": run.cast("int"),
            "_known": F.count(moves).over(recent),
            "_small": F.sum(F.when(moves > c.drift_small, 1).otherwise(0)).over(recent),
        }
    )
    sustained = (F.col("_known") >= c.sustained_window) & (F.col("_small") >= c.sustained_share * c.sustained_window)
    size = F.abs("drift")
    monotonic = (F.col("monotonic_samples") >= c.monotonic_window) & (size >= c.drift_small)
    kind = F.when(monotonic, "monotonic").when(size > c.drift_large, "transient_large").when((size > c.drift_small) & sustained, "sustained_small").otherwise("none")
    df = df.withColumn("drift_type", kind)
    base = F.least(size / c.drift_large, F.lit(1.0))
    severity = F.when(F.col("drift_type") == "monotonic", F.least(base * 1.5, F.lit(1.0))).otherwise(base)
    return df.withColumn("drift_severity", severity).drop("_n", "_sign", "_goes_on", "_known", "_small")


def drift_statistics(df: DataFrame, window: int = 50) -> DataFrame:
    """Mean, largest, variance of recent absolute drift, and stability."""
    recent = last_rows(by_signal(), window)
    size = F.abs("drift")
    df = df.withColumns({"drift_mean": F.avg(size).over(recent), "drift_max": F.max(size).over(recent), "drift_variance": F.var_pop(size).over(recent)})
    spread = F.when(F.col("drift_mean") > 0, F.sqrt("drift_variance") / F.col("drift_mean")).otherwise(0.0)
    return df.withColumn("drift_stability", 1 / (1 + spread))


# --- variance and spikes ---------------------------------------------------------------------------


def variance(df: DataFrame, c: SignalConfig = DEFAULT) -> DataFrame:
    """mean, variance, std_dev and noise_level over the last samples."""
    frame = last_rows(by_signal(), c.variance_window)
    df = df.withColumns({"mean": F.avg("value").over(frame), "variance": F.coalesce(F.var_samp("value").over(frame), F.lit(0.0))})
    df = df.withColumn("std_dev", F.sqrt("variance"))
    return df.withColumn("noise_level", F.when(F.abs("mean") > 1e-9, F.col("std_dev") / F.abs("mean")).otherwise(F.col("std_dev")))


def welford(df: DataFrame) -> DataFrame:
    """Mean and sample variance of all samples so far."""
    frame = so_far(by_signal())
    return df.withColumns({"running_mean": F.avg("value").over(frame), "running_variance": F.coalesce(F.var_samp("value").over(frame), F.lit(0.0))})


def spikes(df: DataFrame, c: SignalConfig = DEFAULT) -> DataFrame:
    """is_spike against the window before the sample, its threshold and deviation, count and frequency."""
    w = by_signal()
    before = w.rowsBetween(-c.variance_window, -1)
    df = df.withColumns(
        {
            "_k": F.count("value").over(before),
            "_m": F.avg("value").over(before),
            "_s": F.sqrt(F.coalesce(F.var_samp("value").over(before), F.lit(0.0))),
            "_n": F.row_number().over(w),
        }
    )
    ready = F.col("_k") >= 2
    off = F.abs(F.col("value") - F.col("_m"))
    df = df.withColumns(
        {
            "spike_limit": F.when(ready, F.col("_m") + c.spike_sigma * F.col("_s")),
            "deviation_sigma": F.when(ready & (F.col("_s") > 0), off / F.col("_s")).otherwise(0.0),
            "_raw": F.coalesce(ready & F.when(F.col("_s") > 0, off > c.spike_sigma * F.col("_s")).otherwise(off > 0), F.lit(False)),
        }
    )
    df = df.withColumn("is_spike", run_length_of("_raw", "_n", w) >= c.spike_debounce)
    edge = F.col("is_spike") & ~F.coalesce(F.lag("is_spike").over(w), F.lit(False))
    df = df.withColumn("_edge", edge.cast("int"))
    df = df.withColumn("spike_count", F.sum("_edge").over(so_far(w)))
    return df.withColumn("spike_frequency", F.col("spike_count") / F.col("_n")).drop("_k", "_m", "_s", "_n", "_raw", "_edge")


# --- oscillation -----------------------------------------------------------------------------------


def oscillation(df: DataFrame, c: SignalConfig) -> DataFrame:
    """components of the reference frequencies, dominant_frequency and oscillation_energy.

    The last ``frequency_window`` samples are standardised and correlated with sines and cosines from
    the window's start; before the window is full, and between cadence points, the last result holds.
    """
    w, n = by_signal(), c.frequency_window
    turns = [[2 * math.pi * f * c.sample_interval * k for k in range(n)] for f in c.frequencies]
    df = df.withColumns({"_x": F.collect_list("value").over(last_rows(w, n)), "_n": F.row_number().over(w)})
    mean = F.aggregate("_x", F.lit(0.0), lambda a, x: a + x) / n
    df = df.withColumn("_c", F.when(F.size("_x") == n, F.transform("_x", lambda x: x - mean)))
    df = df.withColumn("_sd", F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x) / n))
    df = df.withColumn("_z", F.when(F.col("_sd") > 0, F.transform("_c", lambda x: x / F.col("_sd"))).otherwise(F.col("_c")))

    def dot(values: list[float]) -> Column:
        products = F.zip_with("_z", F.array(*[F.lit(v) for v in values]), lambda x, y: x * y)
        return F.aggregate(products, F.lit(0.0), lambda a, x: a + x) / n

    def component(k: int) -> Column:
        s, cos = dot([math.sin(t) for t in turns[k]]), dot([math.cos(t) for t in turns[k]])
        size = F.sqrt(s * s + cos * cos)
        return F.struct(size.alias("magnitude"), F.lit(-k).alias("order"), F.lit(c.frequencies[k]).alias("frequency"), F.atan2(s, cos).alias("phase"))

    fresh = F.when(F.col("_z").isNotNull() & (F.col("_n") % c.cadence == 0), F.array(*[component(k) for k in range(len(turns))]))
    df = df.withColumn("_fresh", fresh)
    df = df.withColumn("components", F.last("_fresh", ignorenulls=True).over(so_far(w)))
    found = F.filter("components", lambda x: x["magnitude"] > c.frequency_threshold)
    df = df.withColumn("_found", F.coalesce(found, F.array().cast(df.schema["components"].dataType)))
    energy = F.aggregate("_found", F.lit(0.0), lambda a, x: a + x["magnitude"] * x["magnitude"])
    df = df.withColumns({"dominant_frequency": F.array_max("_found")["frequency"], "oscillation_energy": energy})
    return df.drop("_x", "_n", "_c", "_sd", "_z", "_fresh", "_found")


def spectrum(df: DataFrame, window: int = 50, interval: float = 0.1) -> DataFrame:
    """peak_frequency and peak_magnitude of the Hann-weighted spectrum of the last samples, without DC."""
    bins = range(1, window // 2 + 1)
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * k / (window - 1)) if window > 1 else 1.0 for k in range(window)]
    df = df.withColumn("_x", F.collect_list("value").over(last_rows(by_signal(), window)))

    def dot(wave) -> Column:
        weights = F.array(*[F.lit(h * v) for h, v in zip(hann, wave, strict=True)])
        return F.aggregate(F.zip_with("_x", weights, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)

    def size(b: int) -> Column:
        c, s = (dot([f(2 * math.pi * b * k / window) for k in range(window)]) for f in (math.cos, math.sin))
        return F.struct((F.sqrt(c * c + s * s) / window).alias("magnitude"), F.lit(-b).alias("order"), F.lit(b / (window * interval)).alias("frequency"))

    df = df.withColumn("_peak", F.when(F.size("_x") == window, F.array_max(F.array(*[size(b) for b in bins]))))
    return df.withColumns({"peak_frequency": F.col("_peak")["frequency"], "peak_magnitude": F.col("_peak")["magnitude"]}).drop("_x", "_peak")


# --- stale, step, plausibility, innovation, missing -------------------------------------------------


def stale(df: DataFrame, c: SignalConfig = DEFAULT, time: str = "ts") -> DataFrame:
    """flatline, timestamp_stale, stale and stale_reason."""
    w = by_signal()
    df = df.withColumns({"_n": F.row_number().over(w), "_same": F.coalesce(F.col("value") == F.lag("value").over(w), F.lit(False))})
    df = df.withColumns({"flatline": run_length_of("_same", "_n", w) + 1 >= c.stale_window, "timestamp_stale": F.coalesce(F.col(time) <= F.lag(time).over(w), F.lit(False))})
    df = df.withColumn("_raw", F.when(F.col("timestamp_stale"), "timestamp").when(F.col("flatline"), "flatline"))
    df = df.withColumns({"stale": F.max(F.col("_raw").isNotNull()).over(last_rows(w, c.stale_recovery)), "_last": F.last("_raw", ignorenulls=True).over(so_far(w))})
    return df.withColumn("stale_reason", F.when(F.col("stale"), F.col("_last"))).drop("_n", "_same", "_raw", "_last")


def step_change(df: DataFrame, c: SignalConfig = DEFAULT) -> DataFrame:
    """step_change and step_offset, by fold."""
    return ordered_fold(df, "signal_id", "scan_ord", ["value"], "step_change boolean, step_offset double", lambda: ((), None, None, 0, 0, False), step_change_step(c.step), df.columns)


def innovation(df: DataFrame, c: SignalConfig = DEFAULT, time: str = "ts") -> DataFrame:
    """The innovation_* columns, by fold; rows with null values are predicted only."""
    outputs = ", ".join(f"innovation_{x} {'boolean' if x == 'spike' else 'double'}" for x in ("residual", "S", "z", "v_hat", "eta", "spike", "spike_ema", "drift_delta", "drift_ema"))
    folded = ordered_fold(df, "signal_id", "scan_ord", ["value", time], outputs, lambda: None, innovation_step(c.innovation), df.columns)
    return folded.withColumn("noise_excess", F.greatest(F.sqrt(F.greatest("innovation_eta", F.lit(0.0))) - 1, F.lit(0.0)))


def plausibility(df: DataFrame, c: SignalConfig, time: str = "ts") -> DataFrame:
    """plausibility_reasons, plausibility_rate and plausibility_violation with persistence and recovery."""
    w = by_signal()
    before, at = F.lag("value").over(w), F.lag(time).over(w)
    # a previous time of exactly 0 counts as none
    dt = F.when(at == 0, 0.0).otherwise(F.col(time) - at)
    rate = F.when(before.isNotNull(), F.abs(F.col("value") - before) / F.when(dt > 0, dt).otherwise(1.0))
    df = df.withColumns({"plausibility_rate": rate, "_n": F.row_number().over(w)})
    tests = [
        ("below_min", F.col("value") < c.value_min) if c.value_min is not None else None,
        ("above_max", F.col("value") > c.value_max) if c.value_max is not None else None,
        ("rate_exceeded", F.col("plausibility_rate") > c.max_rate) if c.max_rate is not None else None,
    ]
    reasons = F.array_compact(F.array(*[F.when(p, name) for name, p in filter(None, tests)])) if any(tests) else F.array().cast("array<string>")
    df = df.withColumn("plausibility_reasons", reasons)
    df = df.withColumns({"_bad": F.size("plausibility_reasons") > 0, "_good": F.size("plausibility_reasons") == 0})
    df = df.withColumns({"_on": run_length_of("_bad", "_n", w) >= c.plausibility_persistence, "_off": run_length_of("_good", "_n", w) >= c.plausibility_recovery})
    return df.withColumn("plausibility_violation", latch(F.col("_on"), F.col("_off"), w)).drop("_n", "_bad", "_good", "_on", "_off")


def missing(df: DataFrame, c: SignalConfig = DEFAULT) -> DataFrame:
    """raw_missing_ratio and missing_ratio over all rows, missing ones included (needs ``penalty``)."""
    frame = last_rows(by_signal(), c.missing_window)
    gap = F.when(F.col("value").isNull(), 1.0).otherwise(0.0)
    return df.withColumns({"raw_missing_ratio": F.avg(gap).over(frame), "missing_ratio": F.avg("penalty").over(frame)})


# --- quality index ---------------------------------------------------------------------------------


def neutral(df: DataFrame) -> DataFrame:
    """Columns of detectors that weren't planned, at values that score 100."""
    defaults = {
        "noise_level": F.lit(0.0), "drift": F.lit(0.0), "spike_frequency": F.lit(0.0), "oscillation_energy": F.lit(0.0), "missing_ratio": F.lit(0.0),
        "stale": F.lit(False), "step_change": F.lit(False), "plausibility_violation": F.lit(False),
    }
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def quality_index(df: DataFrame, c: SignalConfig = DEFAULT) -> DataFrame:
    """Component scores, sqi, quality_class, sqi_trend and alerts."""
    df = neutral(df)
    decay = lambda v, limit: 100 * F.exp(-v / limit)
    flag = lambda name: F.when(F.col(name), 0.0).otherwise(100.0)
    df = df.withColumns(
        {
            "score_noise": decay(F.col("noise_level"), c.noise_threshold),
            "score_drift": decay(F.abs("drift"), c.drift_threshold),
            "score_spikes": 100 * (1 - F.least(F.col("spike_frequency") / c.spike_threshold, F.lit(1.0))),
            "score_oscillation": decay(F.col("oscillation_energy"), c.oscillation_threshold),
            "score_missing": 100 * (1 - F.col("missing_ratio")),
            "score_stale": flag("stale"),
            "score_step": flag("step_change"),
            "score_plausibility": flag("plausibility_violation"),
        }
    )
    total = sum((w * F.col(f"score_{name}") for name, w in c.normalised_weights().items()), F.lit(0.0))
    df = df.withColumn("sqi", F.greatest(F.least(total, F.lit(100.0)), F.lit(0.0)))
    w = by_signal()
    lift = F.avg("sqi").over(w.rowsBetween(-4, 0)) - F.avg("sqi").over(w.rowsBetween(-9, -5))
    full = F.count("sqi").over(w.rowsBetween(-9, 0)) == 10
    return df.withColumns(
        {
            "quality_class": F.when(F.col("sqi") >= 90, "excellent").when(F.col("sqi") >= 75, "good").when(F.col("sqi") >= 50, "fair").when(F.col("sqi") >= 25, "poor").otherwise("critical"),
            "sqi_trend": F.when(full & (lift > 5), "improving").when(full & (lift < -5), "degrading").otherwise("stable"),
            "alert_level": F.when(F.col("sqi") <= c.sqi_critical, "critical").when(F.col("sqi") <= c.sqi_warning, "warning").otherwise("none"),
            "drift_alert": F.abs("drift") >= c.drift_alert,
            "spike_alert": F.col("spike_frequency") >= c.spike_alert,
        }
    )


def dominant_cause() -> Column:
    """The first of the lowest component scores, in their fixed order."""
    return F.array_min(F.array(*[F.struct(F.col(f"score_{c}").alias("s"), F.lit(k).alias("k"), F.lit(c).alias("name")) for k, c in enumerate(COMPONENTS)]))["name"]


def index_statistics(df: DataFrame, window: int = 100) -> DataFrame:
    """Per signal: mean, least, most and current sqi of the last rows."""
    from pyspark.sql import Window

    back = F.row_number().over(Window.partitionBy("signal_id").orderBy(F.desc("scan_ord")))
    recent = df.withColumn("_back", back).where(F.col("_back") <= window)
    return recent.groupBy("signal_id").agg(
        F.avg("sqi").alias("mean_sqi"), F.min("sqi").alias("min_sqi"), F.max("sqi").alias("max_sqi"), F.max_by("sqi", "scan_ord").alias("current_sqi")
    )


def quality_changes(df: DataFrame) -> DataFrame:
    """Rows where a signal's quality class differs from the one before."""
    before = F.lag("quality_class").over(by_signal())
    return df.withColumn("previous_class", before).where(F.col("previous_class").isNotNull() & (F.col("previous_class") != F.col("quality_class")))


def process(df: DataFrame, c: SignalConfig = DEFAULT, required: set[str] = frozenset(), filters: bool = False) -> DataFrame:
    """The pipeline of a signal: every component that has a weight or is required is planned, the others score 100.

    Input: rows (signal_id, scan_ord, ts, value) with all samples, missing ones too, and optionally quality
    or penalty. Missing ratios and the innovation filter see all rows; detectors, index and result only
    non-missing ones. With ``filters`` the smoothed columns are added. Where the innovation filter is on, it
    says what noise, drift and spikes are.
    """
    wanted = c.enabled(required)
    if "penalty" not in df.columns:
        df = quality_mask(df) if "quality" in df.columns else df.withColumn("penalty", F.when(F.col("value").isNull(), 1.0).otherwise(0.0))
    if "missing" in wanted:
        df = missing(df, c)
    if c.innovation_enabled:
        df = innovation(df, c)
    df = moving_average(df.where("value is not null"), c)
    if filters:
        df = smooth(df, c)
    if "step" in wanted:
        df = step_change(df, c)
    df = variance(drift(df, c), c)
    df = df.withColumns({"is_spike": F.col("innovation_spike"), "spike_frequency": F.col("innovation_spike_ema")}) if c.innovation_enabled else spikes(df, c)
    for name, detector in (("oscillation", oscillation), ("stale", stale), ("plausibility", plausibility)):
        if name in wanted:
            df = detector(df, c)
    if not c.innovation_enabled:
        return quality_index(df, c)
    kept = df.withColumns({"_noise": F.col("noise_level"), "_drift": F.col("drift"), "noise_level": F.col("noise_excess"), "drift": F.col("innovation_drift_ema")})
    out = quality_index(kept, c).withColumns({"noise_level": F.col("_noise"), "drift": F.col("_drift")})
    return out.withColumn("drift_alert", F.abs("drift") >= c.drift_alert).drop("_noise", "_drift")

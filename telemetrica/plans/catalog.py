"""Registered queries over the driver tables and their DuckDB oracles.

Floats are rounded to nine digits on both sides. ``SERIES`` and ``GRID`` are the oracle's forms of
``event_series`` and ``event_grid``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetrica.functions.storage import stored
from telemetrica.functions.windows import by_signal
from telemetrica.operators import comms, evaluation, incidents, rca, signals, topology
from telemetrica.operators.signals import SignalConfig
from telemetrica.sources import scans as src

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SERIES = """
series AS (
  SELECT user_id AS signal_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS scan_ord,
    epoch_us(ts) / 1e6 AS ts, value, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS k
  FROM events
)"""
GRID = """
cells AS (
  SELECT CAST(floor(epoch_us(ts) / 1e6 / 3600) AS BIGINT) AS scan_ord, event_type || '_' || (user_id % 4) AS signal_id, avg(value) AS value
  FROM events GROUP BY ALL
), firsts AS (SELECT signal_id, min(scan_ord) AS first_scan FROM cells GROUP BY ALL),
grid AS (
  SELECT f.signal_id, s.scan_ord, c.value FROM (SELECT DISTINCT scan_ord FROM cells) s JOIN firsts f ON s.scan_ord >= f.first_scan
  LEFT JOIN cells c ON c.scan_ord = s.scan_ord AND c.signal_id = f.signal_id
)"""
W = "OVER (PARTITION BY signal_id ORDER BY scan_ord"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 9).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir), with its oracle."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


KEYS = ("signal_id", "scan_ord")
FREQUENCIES = SignalConfig(frequencies=(0.5, 1.0, 2.0), frequency_threshold=0.2)
LIMITED = SignalConfig(value_min=1.0, value_max=150.0, max_rate=50.0, plausibility_persistence=2, plausibility_recovery=3)


# --- conditioning ----------------------------------------------------------------------------------


@query("quality_mask", f"""WITH {SERIES} SELECT signal_id, scan_ord, CASE WHEN k <> 0 THEN value END AS value,
  CASE WHEN k = 0 THEN 1.0 WHEN k = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS penalty FROM series""")  # fmt: skip
def quality_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.quality_mask(src.event_series(spark, sf_dir)).select(*KEYS, "value", "penalty")


@query("moving_average", f"WITH {SERIES} SELECT signal_id, scan_ord, round(avg(value) {W} ROWS 9 PRECEDING), 9) AS filtered_ma FROM series")
def moving_average(spark, sf_dir):
    return rounded(signals.moving_average(src.event_series(spark, sf_dir)), *KEYS, "filtered_ma")


EWMA = f"""WITH RECURSIVE {SERIES}, fold AS (
  SELECT signal_id, scan_ord, value, value AS y FROM series WHERE scan_ord = 1
  UNION ALL SELECT s.signal_id, s.scan_ord, s.value, 0.3e0 * s.value + 0.7e0 * f.y FROM fold f JOIN series s ON s.signal_id = f.signal_id AND s.scan_ord = f.scan_ord + 1
) SELECT signal_id, scan_ord, round(y, 9) AS filtered_ewma, round(value - y, 9) AS highpass FROM fold"""


@query("ewma_highpass", EWMA)
def ewma_highpass(spark, sf_dir):
    return rounded(signals.smooth(src.event_series(spark, sf_dir)), *KEYS, "filtered_ewma", "highpass")


@query("filter_bank", f"""WITH {SERIES} SELECT signal_id, scan_ord, round(avg(value) {W} ROWS 4 PRECEDING), 9) AS ma_5,
  round(avg(value) {W} ROWS 19 PRECEDING), 9) AS ma_20 FROM series""")  # fmt: skip
def filter_bank(spark, sf_dir):
    w = by_signal()
    bank = {f"ma_{n}": F.avg("value").over(w.rowsBetween(1 - n, 0)) for n in (5, 20)}
    return rounded(signals.filter_bank(src.event_series(spark, sf_dir), bank), *KEYS, "ma_5", "ma_20")


@query("buffer_reads", f"""WITH {SERIES} SELECT signal_id, scan_ord, array_to_string(list(round(value, 9)::DECIMAL(18,2)) {W} ROWS 4 PRECEDING), ',') AS samples,
  round(lag(value) {W}), 9) AS previous, count(value) {W} ROWS 4 PRECEDING) = 5 AS is_full FROM series""")  # fmt: skip
def buffer_reads(spark, sf_dir):
    df = signals.buffer_reads(src.event_series(spark, sf_dir), 5)
    text = F.array_join(F.transform("samples", lambda x: x.cast("decimal(18,2)").cast("string")), ",")
    return rounded(df.withColumn("samples", text), *KEYS, "samples", "previous", "is_full")


# --- drift, variance, spikes -----------------------------------------------------------------------

DRIFT = f"""d AS (
  SELECT *, coalesce(value - lag(value) {W}), 0) AS drift FROM series
), sg AS (
  SELECT *, CASE WHEN abs(drift) >= 0.5 THEN sign(drift) ELSE 0 END AS sg FROM d
), br AS (
  SELECT *, CASE WHEN sg <> 0 AND sg = lag(sg) {W}) THEN 0 ELSE 1 END AS br FROM sg
), isl AS (SELECT *, sum(br) {W}) AS isl FROM br
), run AS (
  SELECT *, CASE WHEN sg = 0 THEN 0 ELSE row_number() OVER (PARTITION BY signal_id, isl ORDER BY scan_ord) END AS monotonic_samples,
    count(CASE WHEN scan_ord > 1 THEN 1 END) {W} ROWS 9 PRECEDING) AS known,
    sum(CASE WHEN scan_ord > 1 AND abs(drift) > 0.5 THEN 1 ELSE 0 END) {W} ROWS 9 PRECEDING) AS small
  FROM isl
), drifts AS (
  SELECT *, CASE WHEN monotonic_samples >= 5 THEN 'monotonic' WHEN abs(drift) > 5 THEN 'transient_large'
    WHEN abs(drift) > 0.5 AND known >= 10 AND small >= 7 THEN 'sustained_small' ELSE 'none' END AS drift_type FROM run
)"""


@query("drift", f"""WITH {SERIES}, {DRIFT} SELECT signal_id, scan_ord, round(drift, 9) AS drift, CAST(monotonic_samples AS INT) AS monotonic_samples, drift_type,
  round(CASE WHEN drift_type = 'monotonic' THEN least(least(abs(drift) / 5e0, 1e0) * 1.5e0, 1e0) ELSE least(abs(drift) / 5e0, 1e0) END, 9) AS drift_severity FROM drifts""")  # fmt: skip
def drift(spark, sf_dir):
    return rounded(signals.drift(src.event_series(spark, sf_dir)), *KEYS, "drift", "monotonic_samples", "drift_type", "drift_severity")


@query("drift_statistics", f"""WITH {SERIES}, d AS (SELECT *, coalesce(abs(value - lag(value) {W})), 0) AS d FROM series), s AS (
  SELECT signal_id, scan_ord, avg(d) {W} ROWS 49 PRECEDING) AS m, max(d) {W} ROWS 49 PRECEDING) AS x, var_pop(d) {W} ROWS 49 PRECEDING) AS v FROM d)
  SELECT signal_id, scan_ord, round(m, 9) AS drift_mean, round(x, 9) AS drift_max, round(1 / (1 + CASE WHEN m > 0 THEN sqrt(v) / m ELSE 0 END), 9) AS drift_stability FROM s""")  # fmt: skip
def drift_statistics(spark, sf_dir):
    return rounded(signals.drift_statistics(signals.drift(src.event_series(spark, sf_dir))), *KEYS, "drift_mean", "drift_max", "drift_stability")


VARIANCE = f"""v AS (
  SELECT *, avg(value) {W} ROWS 19 PRECEDING) AS mean, coalesce(var_samp(value) {W} ROWS 19 PRECEDING), 0) AS variance FROM series
), variances AS (SELECT *, sqrt(variance) AS std_dev, CASE WHEN abs(mean) > 1e-9 THEN sqrt(variance) / abs(mean) ELSE sqrt(variance) END AS noise_level FROM v)"""


@query("variance", f"WITH {SERIES}, {VARIANCE} SELECT signal_id, scan_ord, round(mean, 9) AS mean, round(variance, 9) AS variance, round(std_dev, 9) AS std_dev, round(noise_level, 9) AS noise_level FROM variances")
def variance(spark, sf_dir):
    return rounded(signals.variance(src.event_series(spark, sf_dir)), *KEYS, "mean", "variance", "std_dev", "noise_level")


@query("welford", f"WITH {SERIES} SELECT signal_id, scan_ord, round(avg(value) {W}), 9) AS running_mean, round(coalesce(var_samp(value) {W}), 0) + 1e-7, 6) AS running_variance FROM series")
def welford(spark, sf_dir):
    df = signals.welford(src.event_series(spark, sf_dir))
    # variances of two-decimal values lie on rounding ties, which a little more moves both sides off
    return rounded(df.withColumn("running_variance", F.round(F.col("running_variance") + 1e-7, 6)), *KEYS, "running_mean", "running_variance")


SPIKES = f"""b AS (
  SELECT *, count(value) {W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS n, avg(value) {W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS m,
    sqrt(coalesce(var_samp(value) {W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0)) AS s FROM {{base}}
), raw AS (SELECT *, coalesce(n >= 2 AND CASE WHEN s > 0 THEN abs(value - m) > 3 * s ELSE abs(value - m) > 0 END, false) AS is_spike FROM b
), e AS (SELECT *, CASE WHEN is_spike AND NOT coalesce(lag(is_spike) {W}), false) THEN 1 ELSE 0 END AS edge FROM raw
), spiked AS (SELECT *, sum(edge) {W}) AS spike_count, sum(edge) {W})::DOUBLE / row_number() {W}) AS spike_frequency FROM e)"""


@query("spikes", f"""WITH {SERIES}, {SPIKES.format(base='series')} SELECT signal_id, scan_ord, is_spike, round(CASE WHEN n >= 2 THEN m + 3 * s END, 9) AS spike_limit,
  round(CASE WHEN n >= 2 AND s > 0 THEN abs(value - m) / s ELSE 0 END, 9) AS deviation_sigma, CAST(spike_count AS BIGINT) AS spike_count, round(spike_frequency, 9) AS spike_frequency FROM spiked""")  # fmt: skip
def spikes(spark, sf_dir):
    return rounded(signals.spikes(src.event_series(spark, sf_dir)), *KEYS, "is_spike", "spike_limit", "deviation_sigma", "spike_count", "spike_frequency")


# --- oscillation, stale, step, plausibility, innovation, missing -----------------------------------

FULL = f"""full_windows AS (
  SELECT signal_id, scan_ord, list(value) {W} ROWS 49 PRECEDING) AS x FROM series
), x AS (SELECT signal_id, scan_ord, unnest(x) AS v, unnest(range(0, 50)) AS i FROM full_windows WHERE len(x) = 50)"""


@query("oscillation", f"""WITH {SERIES}, {FULL}, st AS (SELECT signal_id, scan_ord, avg(v) AS m, stddev_pop(v) AS sd FROM x GROUP BY ALL),
  z AS (SELECT signal_id, scan_ord, i, CASE WHEN sd > 0 THEN (v - m) / sd ELSE v - m END AS z FROM x JOIN st USING (signal_id, scan_ord)),
  c AS (SELECT signal_id, scan_ord, f, sum(z * sin(2 * pi() * f * 0.1 * i)) / 50 AS s, sum(z * cos(2 * pi() * f * 0.1 * i)) / 50 AS c
    FROM z, (VALUES (0.5e0), (1e0), (2e0)) fs(f) GROUP BY ALL),
  g AS (SELECT signal_id, scan_ord, coalesce(sum(s * s + c * c) FILTER (sqrt(s * s + c * c) > 0.2), 0) AS e, max(sqrt(s * s + c * c)) AS m, arg_max(f, s * s + c * c) AS f, arg_max(atan2(s, c), s * s + c * c) AS p FROM c GROUP BY ALL)
  SELECT s.signal_id, s.scan_ord, round(coalesce(e, 0), 9) AS oscillation_energy, round(m, 9) AS strongest, CASE WHEN m > 0.2 THEN f END AS dominant_frequency, round(p, 6) AS phase FROM series s LEFT JOIN g USING (signal_id, scan_ord)""")  # fmt: skip
def oscillation(spark, sf_dir):
    df = signals.oscillation(src.event_series(spark, sf_dir), FREQUENCIES)
    df = df.withColumns({"strongest": F.array_max("components")["magnitude"], "phase": F.round(F.array_max("components")["phase"], 6)})
    return rounded(df, *KEYS, "oscillation_energy", "strongest", "dominant_frequency", "phase")


@query("spectrum", f"""WITH {SERIES}, {FULL}, h AS (SELECT signal_id, scan_ord, i, v * (0.5e0 - 0.5e0 * cos(2 * pi() * i / 49)) AS v FROM x),
  b AS (SELECT signal_id, scan_ord, b, sqrt(sum(v * cos(2 * pi() * b * i / 50)) ** 2 + sum(v * sin(2 * pi() * b * i / 50)) ** 2) / 50 AS m FROM h, range(1, 26) r(b) GROUP BY ALL),
  g AS (SELECT signal_id, scan_ord, max(m) AS m FROM b GROUP BY ALL)
  SELECT s.signal_id, s.scan_ord, round(m, 6) AS peak_magnitude FROM series s LEFT JOIN g USING (signal_id, scan_ord)""")  # fmt: skip
def spectrum(spark, sf_dir):
    df = signals.spectrum(src.event_series(spark, sf_dir))
    return df.select(*KEYS, F.round("peak_magnitude", 6).alias("peak_magnitude"))


def flat_series(spark, sf_dir):
    """The series with values in tens, which repeat."""
    return src.event_series(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 50) * 50.0)


@query("stale", f"""WITH {SERIES}, q AS (SELECT * REPLACE (floor(value / 50) * 50e0 AS value, floor(ts / 10000) * 10000e0 AS ts) FROM series),
  a AS (SELECT *, CASE WHEN value = lag(value) {W}) THEN 0 ELSE 1 END AS br, coalesce(ts <= lag(ts) {W}), false) AS timestamp_stale FROM q),
  i AS (SELECT *, sum(br) {W}) AS isl FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY signal_id, isl ORDER BY scan_ord) >= 5 AS flatline FROM i),
  z AS (SELECT *, CASE WHEN timestamp_stale THEN 'timestamp' WHEN flatline THEN 'flatline' END AS raw FROM r),
  o AS (SELECT *, max(raw IS NOT NULL) {W} ROWS 2 PRECEDING) AS stale, last_value(raw IGNORE NULLS) {W}) AS reason FROM z)
  SELECT signal_id, scan_ord, flatline, timestamp_stale, stale, CASE WHEN stale THEN reason END AS stale_reason FROM o""")  # fmt: skip
def stale(spark, sf_dir):
    return signals.stale(rough_series(spark, sf_dir)).select(*KEYS, "flatline", "timestamp_stale", "stale", "stale_reason")


STEP = f"""WITH RECURSIVE {SERIES}, m AS (SELECT *, CASE WHEN count(value) {W} ROWS 9 PRECEDING) = 10 THEN avg(value) {W} ROWS 9 PRECEDING) END AS mean FROM series),
fold AS (
  SELECT signal_id, scan_ord, NULL::DOUBLE AS cand, NULL::DOUBLE AS snap, 0 AS confirm, 0 AS recover, false AS active FROM m WHERE scan_ord = 1
  UNION ALL
  SELECT signal_id, scan_ord, CASE WHEN act AND rec >= 5 THEN NULL ELSE c END, CASE WHEN act AND rec >= 5 THEN NULL ELSE sn END, CASE WHEN act AND rec >= 5 THEN 0 ELSE cf END,
    CASE WHEN act AND rec >= 5 THEN 0 ELSE rec END, act AND rec < 5
  FROM (
    SELECT *, CASE WHEN was THEN true ELSE had AND cf >= 3 END AS act, CASE WHEN was THEN CASE WHEN mean IS NOT NULL AND abs(mean - c) <= 5 THEN r0 + 1 ELSE 0 END ELSE 0 END AS rec FROM (
      SELECT s.signal_id, s.scan_ord, s.mean, f.active AS was, f.recover AS r0, f.cand IS NOT NULL AS had,
        CASE WHEN f.active THEN f.cand WHEN f.cand IS NULL THEN CASE WHEN s.mean IS NOT NULL AND abs(s.value - s.mean) >= 5 THEN s.value END
          WHEN abs(s.value - f.cand) <= 5 THEN f.cand END AS c,
        CASE WHEN f.active THEN f.snap WHEN f.cand IS NULL THEN CASE WHEN s.mean IS NOT NULL AND abs(s.value - s.mean) >= 5 THEN s.mean END
          WHEN abs(s.value - f.cand) <= 5 THEN f.snap END AS sn,
        CASE WHEN f.active THEN f.confirm WHEN f.cand IS NULL THEN CASE WHEN s.mean IS NOT NULL AND abs(s.value - s.mean) >= 5 THEN 1 ELSE 0 END
          WHEN abs(s.value - f.cand) <= 5 THEN f.confirm + 1 ELSE 0 END AS cf
      FROM fold f JOIN m s ON s.signal_id = f.signal_id AND s.scan_ord = f.scan_ord + 1))
) SELECT signal_id, scan_ord, active AS step_change, round(cand - snap, 9) AS step_offset FROM fold"""


@query("step_change", STEP)
def step_change(spark, sf_dir):
    return rounded(signals.step_change(src.event_series(spark, sf_dir)), *KEYS, "step_change", "step_offset")


@query("plausibility", f"""WITH {SERIES}, a AS (SELECT *, abs(value - lag(value) {W})) / CASE WHEN ts - lag(ts) {W}) > 0 THEN ts - lag(ts) {W}) ELSE 1 END AS rate FROM series),
  b AS (SELECT *, value < 1 AS lo, value > 150 AS hi, coalesce(rate > 50, false) AS fast FROM a),
  c AS (SELECT *, lo OR hi OR fast AS bad FROM b), d AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) {W}) AS i, sum(CASE WHEN bad THEN 1 ELSE 0 END) {W}) AS j FROM c),
  e AS (SELECT *, CASE WHEN bad AND sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id, i ORDER BY scan_ord) >= 2 THEN true
    WHEN NOT bad AND sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY signal_id, j ORDER BY scan_ord) >= 3 THEN false END AS s FROM d)
  SELECT signal_id, scan_ord, concat_ws(',', CASE WHEN lo THEN 'below_min' END, CASE WHEN hi THEN 'above_max' END, CASE WHEN fast THEN 'rate_exceeded' END) AS plausibility_reasons,
    round(rate, 9) AS plausibility_rate, coalesce(last_value(s IGNORE NULLS) {W}), false) AS plausibility_violation FROM e""")  # fmt: skip
def plausibility(spark, sf_dir):
    df = signals.plausibility(src.event_series(spark, sf_dir), LIMITED)
    return rounded(df.withColumn("plausibility_reasons", F.array_join("plausibility_reasons", ",")), *KEYS, "plausibility_reasons", "plausibility_rate", "plausibility_violation")


INNOVATION = f"""WITH RECURSIVE {SERIES}, q AS (SELECT signal_id, scan_ord, scan_ord * 0.1e0 AS t, CASE WHEN k <> 0 THEN value END AS y FROM series),
fold AS (
  SELECT signal_id, scan_ord, y AS p, 0e0 AS v, CASE WHEN y IS NULL THEN 0e0 ELSE 1e6 END AS a, 0e0 AS b, CASE WHEN y IS NULL THEN 0e0 ELSE 1e4 END AS d, 0e0 AS eta, t AS last,
    CASE WHEN y IS NOT NULL THEN 0e0 END AS e, CASE WHEN y IS NULL THEN 1e0 ELSE 1e6 + 1 END AS s FROM q WHERE scan_ord = 1
  UNION ALL
  SELECT signal_id, scan_ord,
    CASE WHEN p0 IS NULL THEN y WHEN y IS NULL THEN pp ELSE pp + pa / s1 * (y - pp) END,
    CASE WHEN p0 IS NULL THEN 0e0 WHEN y IS NULL THEN v0 ELSE v0 + pb / s1 * (y - pp) END,
    CASE WHEN p0 IS NULL THEN CASE WHEN y IS NULL THEN 0e0 ELSE 1e6 END WHEN y IS NULL THEN pa ELSE (1 - pa / s1) * pa END,
    CASE WHEN p0 IS NULL THEN 0e0 WHEN y IS NULL THEN pb ELSE (1 - pa / s1) * pb END,
    CASE WHEN p0 IS NULL THEN CASE WHEN y IS NULL THEN 0e0 ELSE 1e4 END WHEN y IS NULL THEN pd ELSE pd - pb / s1 * pb END,
    CASE WHEN p0 IS NULL OR y IS NULL THEN CASE WHEN y IS NULL THEN eta0 ELSE 0.95e0 * eta0 END ELSE 0.95e0 * eta0 + 0.05e0 * (y - pp) * (y - pp) / s1 END,
    last,
    CASE WHEN y IS NULL THEN NULL WHEN p0 IS NULL THEN 0e0 ELSE y - pp END,
    CASE WHEN p0 IS NULL THEN CASE WHEN y IS NULL THEN 1e0 ELSE 1e6 + 1 END ELSE s1 END
  FROM (SELECT *, greatest(pa + 1, 1e-12) AS s1 FROM (
    SELECT q.signal_id, q.scan_ord, q.y, f.p AS p0, f.v AS v0, f.eta AS eta0, greatest(f.last, q.t) AS last, f.p + f.v * dt AS pp,
      f.a + dt * (2 * f.b + dt * f.d) + 0.01e0 * dt * dt * dt / 3 AS pa, f.b + dt * f.d + 0.01e0 * dt * dt / 2 AS pb, f.d + 0.01e0 * dt AS pd
    FROM (SELECT f.*, greatest(0, q.t - f.last) AS dt FROM fold f JOIN q ON q.signal_id = f.signal_id AND q.scan_ord = f.scan_ord + 1) f
    JOIN q ON q.signal_id = f.signal_id AND q.scan_ord = f.scan_ord + 1))
) SELECT signal_id, scan_ord, round(e, 5) AS innovation_residual, round(s, 5) AS innovation_S, round(v, 5) AS innovation_v_hat, round(eta, 5) AS innovation_eta FROM fold"""


@query("innovation", INNOVATION)
def innovation(spark, sf_dir):
    rows = signals.quality_mask(src.event_series(spark, sf_dir)).withColumn("ts", F.col("scan_ord") * 0.1)
    df = signals.innovation(rows)
    return df.select(*KEYS, *[F.round(f"innovation_{c}", 5).alias(f"innovation_{c}") for c in ("residual", "S", "v_hat", "eta")])


@query("missing_ratio", f"""WITH {SERIES} SELECT signal_id, scan_ord, round(avg(CASE WHEN k = 0 THEN 1e0 ELSE 0 END) {W} ROWS 99 PRECEDING), 9) AS raw_missing_ratio,
  round(avg(CASE WHEN k = 0 THEN 1e0 WHEN k = 1 THEN 0.5e0 ELSE 0 END) {W} ROWS 99 PRECEDING), 9) AS missing_ratio FROM series""")  # fmt: skip
def missing_ratio(spark, sf_dir):
    return rounded(signals.missing(signals.quality_mask(src.event_series(spark, sf_dir))), *KEYS, "raw_missing_ratio", "missing_ratio")


@query("spike_debounce", f"""WITH {SERIES}, {SPIKES.format(base='series')}, r AS (SELECT *, sum(CASE WHEN is_spike THEN 0 ELSE 1 END) {W}) AS calm FROM spiked
  ), d AS (SELECT *, is_spike AND count(*) FILTER (is_spike) OVER (PARTITION BY signal_id, calm ORDER BY scan_ord) >= 2 AS held FROM r)
  SELECT signal_id, scan_ord, held AS is_spike, CAST(sum(CASE WHEN held AND NOT coalesce(before, false) THEN 1 ELSE 0 END) {W}) AS BIGINT) AS spike_count FROM (SELECT *, lag(held) {W}) AS before FROM d)""")  # fmt: skip
def spike_debounce(spark, sf_dir):
    return signals.spikes(src.event_series(spark, sf_dir), SignalConfig(spike_debounce=2)).select(*KEYS, "is_spike", "spike_count")


@query("sample_parse", f"""WITH {SERIES} SELECT signal_id, scan_ord, CASE k % 3 WHEN 2 THEN NULL ELSE value END AS value, CASE WHEN k % 3 = 1 THEN CASE WHEN k > 4 THEN 'bad' ELSE 'uncertain' END ELSE 'good' END AS quality,
  CASE WHEN k % 3 = 1 THEN k + 0.5e0 END AS source_timestamp FROM (SELECT * REPLACE (CAST(signal_id AS VARCHAR) AS signal_id) FROM series)""")  # fmt: skip
def sample_parse(spark, sf_dir):
    """Samples as numbers, nulls and nested records, written as text and parsed."""
    k = F.get_json_object("props", "$.k").cast("int") % 10
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("signal_id"), F.row_number().over(order).cast("long").alias("scan_index"), k.alias("k"), "value")
    rich = F.to_json(F.struct("value", F.when(F.col("k") > 4, " BAD ").otherwise("Uncertain").alias("quality"), (F.col("k") + 0.5).alias("source_timestamp")))
    raw = F.when(F.col("k") % 3 == 1, rich).when(F.col("k") % 3 == 0, F.col("value").cast("string"))
    parsed = src.samples(rows.select("scan_index", F.lit(0.0).alias("timestamp"), F.create_map("signal_id", raw).alias("signals")))
    return parsed.select(*KEYS, "value", "quality", "source_timestamp")


@query("scan_pivot", """WITH r AS (SELECT floor(epoch_us(ts) / 1e6 / 3600) AS t, event_type AS signal_id, max_by(value, event_id) AS value FROM events GROUP BY ALL), t AS (SELECT t, dense_rank() OVER (ORDER BY t) AS scan_ord FROM (SELECT DISTINCT t FROM r))
  SELECT t.scan_ord, t.t * 3600 AS ts, s.signal_id, r.value FROM t CROSS JOIN (SELECT DISTINCT signal_id FROM r) s LEFT JOIN r ON r.t = t.t AND r.signal_id = s.signal_id""")  # fmt: skip
def scan_pivot(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select((F.floor(src.seconds("ts") / 3600) * 3600.0).alias("timestamp"), F.col("event_type").alias("signal_id"), "value", "event_id")
    return src.scans_of(rows, "event_id").select("scan_ord", "ts", "signal_id", "value")


# --- quality index ---------------------------------------------------------------------------------

INDEX = f"""{SERIES}, {DRIFT}, vv AS (SELECT *, avg(value) {W} ROWS 19 PRECEDING) AS mean, coalesce(var_samp(value) {W} ROWS 19 PRECEDING), 0) AS variance FROM drifts
), noise AS (SELECT *, CASE WHEN abs(mean) > 1e-9 THEN sqrt(variance) / abs(mean) ELSE sqrt(variance) END AS noise_level FROM vv), {SPIKES.format(base='noise')},
scored AS (SELECT *, 100 * exp(-noise_level / 0.1e0) AS score_noise, 100 * exp(-abs(drift) / 1e0) AS score_drift, 100 * (1 - least(spike_frequency / 0.05e0, 1e0)) AS score_spikes FROM spiked
), idx AS (SELECT *, greatest(least(0.25e0 * score_noise + 0.25e0 * score_drift + 0.2e0 * score_spikes + 15e0 + 15e0, 100e0), 0e0) AS sqi FROM scored
), quality AS (SELECT *, CASE WHEN sqi >= 90 THEN 'excellent' WHEN sqi >= 75 THEN 'good' WHEN sqi >= 50 THEN 'fair' WHEN sqi >= 25 THEN 'poor' ELSE 'critical' END AS quality_class,
  CASE WHEN scan_ord >= 10 THEN avg(sqi) {W} ROWS 4 PRECEDING) - avg(sqi) {W} ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) END AS lift FROM idx)"""


def index_rows(spark, sf_dir):
    return signals.process(src.event_series(spark, sf_dir).drop("quality"))


@query("signal_quality", f"""WITH {INDEX} SELECT signal_id, scan_ord, round(score_noise, 9) AS score_noise, round(score_drift, 9) AS score_drift, round(score_spikes, 9) AS score_spikes,
  round(sqi, 9) AS sqi, quality_class, CASE WHEN lift > 5 THEN 'improving' WHEN lift < -5 THEN 'degrading' ELSE 'stable' END AS sqi_trend,
  CASE WHEN sqi <= 25 THEN 'critical' WHEN sqi <= 50 THEN 'warning' ELSE 'none' END AS alert_level, abs(drift) >= 5 AS drift_alert, spike_frequency >= 0.1 AS spike_alert FROM quality""")  # fmt: skip
def signal_quality(spark, sf_dir):
    return rounded(index_rows(spark, sf_dir), *KEYS, "score_noise", "score_drift", "score_spikes", "sqi", "quality_class", "sqi_trend", "alert_level", "drift_alert", "spike_alert")


#: Every component has weight and limits that the series crosses.
EVERY = SignalConfig(
    weights=(0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.2, 0.1), frequencies=(0.5, 1.0, 2.0), frequency_threshold=0.2, value_min=1.0, value_max=150.0, max_rate=50.0, plausibility_persistence=2, plausibility_recovery=3,
    stale_window=2, stale_recovery=2, missing_window=20,
)


def rough_series(spark, sf_dir):
    """The series in tens of fifty, which repeat, with times of ten-thousand seconds, which repeat too, and bad and uncertain samples."""
    df = flat_series(spark, sf_dir)
    return df.withColumn("ts", F.floor(F.col("ts") / 10_000) * 10_000.0)


FULL_STEP = STEP.split("fold AS (")[1].rsplit(") SELECT", 1)[0].replace("FROM m WHERE", "FROM sm WHERE").replace("JOIN m s", "JOIN sm s").replace("s.scan_ord = f.scan_ord + 1", "s.nth = f.nth + 1")
EVERY_SQL = f"""WITH RECURSIVE {SERIES}, masked AS (SELECT signal_id, scan_ord, floor(ts / 10000) * 10000e0 AS ts, CASE WHEN k <> 0 THEN floor(value / 50) * 50e0 END AS value,
    avg(CASE WHEN k = 0 THEN 1e0 WHEN k = 1 THEN 0.5e0 ELSE 0 END) {W} ROWS 19 PRECEDING) AS missing_ratio FROM series
), present AS (SELECT *, row_number() {W}) AS nth FROM masked WHERE value IS NOT NULL
), sm AS (SELECT *, CASE WHEN count(value) {W} ROWS 9 PRECEDING) = 10 THEN avg(value) {W} ROWS 9 PRECEDING) END AS mean FROM present
), steps AS ({FULL_STEP.replace("SELECT signal_id, scan_ord, NULL::DOUBLE AS cand", "SELECT signal_id, nth, NULL::DOUBLE AS cand").replace("SELECT signal_id, scan_ord, CASE WHEN act", "SELECT signal_id, nth, CASE WHEN act").replace("SELECT s.signal_id, s.scan_ord, s.mean", "SELECT s.signal_id, s.nth, s.mean").replace("FROM fold f", "FROM steps f").replace("WHERE scan_ord = 1", "WHERE nth = 1")}
), st AS (SELECT *, CASE WHEN value = lag(value) {W}) THEN 0 ELSE 1 END AS br, coalesce(ts <= lag(ts) {W}), false) AS late, abs(value - lag(value) {W})) / CASE WHEN ts - lag(ts) {W}) > 0 THEN ts - lag(ts) {W}) ELSE 1 END AS rate,
    coalesce(value - lag(value) {W}), 0) AS drift, avg(value) {W} ROWS 19 PRECEDING) AS mean, coalesce(var_samp(value) {W} ROWS 19 PRECEDING), 0) AS variance,
    list(value) {W} ROWS 49 PRECEDING) AS x FROM present
), isl AS (SELECT *, sum(br) {W}) AS isl, value < 1 OR value > 150 OR coalesce(rate > 50, false) AS bad FROM st
), marks AS (SELECT *, late OR row_number() OVER (PARTITION BY signal_id, isl ORDER BY scan_ord) >= 2 AS raw, sum(CASE WHEN bad THEN 0 ELSE 1 END) {W}) AS bi, sum(CASE WHEN bad THEN 1 ELSE 0 END) {W}) AS bj FROM isl
), flags AS (SELECT *, max(raw) {W} ROWS 1 PRECEDING) AS stale, CASE WHEN bad AND sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id, bi ORDER BY scan_ord) >= 2 THEN true
    WHEN NOT bad AND sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY signal_id, bj ORDER BY scan_ord) >= 3 THEN false END AS sw FROM marks
), noise AS (SELECT *, coalesce(last_value(sw IGNORE NULLS) {W}), false) AS violation, CASE WHEN abs(mean) > 1e-9 THEN sqrt(variance) / abs(mean) ELSE sqrt(variance) END AS noise_level FROM flags
), {SPIKES.format(base='noise')}, xs AS (SELECT signal_id, scan_ord, unnest(x) AS v, unnest(range(0, 50)) AS i FROM present_windows),
  ms AS (SELECT signal_id, scan_ord, avg(v) AS m, stddev_pop(v) AS sd FROM xs GROUP BY ALL),
  z AS (SELECT signal_id, scan_ord, i, CASE WHEN sd > 0 THEN (v - m) / sd ELSE v - m END AS z FROM xs JOIN ms USING (signal_id, scan_ord)),
  c AS (SELECT signal_id, scan_ord, f, sum(z * sin(2 * pi() * f * 0.1 * i)) / 50 AS s, sum(z * cos(2 * pi() * f * 0.1 * i)) / 50 AS c FROM z, (VALUES (0.5e0), (1e0), (2e0)) fs(f) GROUP BY ALL),
  osc AS (SELECT signal_id, scan_ord, sum(s * s + c * c) FILTER (sqrt(s * s + c * c) > 0.2) AS e FROM c GROUP BY ALL),
  scores AS (SELECT p.signal_id, p.scan_ord, 100 * exp(-noise_level / 0.1e0) AS score_noise, 100 * exp(-abs(drift) / 1e0) AS score_drift, 100 * (1 - least(spike_frequency / 0.05e0, 1e0)) AS score_spikes,
    100 * exp(-coalesce(e, 0) / 0.3e0) AS score_oscillation, 100 * (1 - missing_ratio) AS score_missing, CASE WHEN stale THEN 0e0 ELSE 100e0 END AS score_stale, CASE WHEN t.active THEN 0e0 ELSE 100e0 END AS score_step,
    CASE WHEN violation THEN 0e0 ELSE 100e0 END AS score_plausibility FROM spiked p LEFT JOIN osc o USING (signal_id, scan_ord) JOIN steps t ON t.signal_id = p.signal_id AND t.nth = p.nth)
  SELECT signal_id, scan_ord, round(score_noise, 9) AS score_noise, round(score_spikes, 9) AS score_spikes, round(score_oscillation, 6) AS score_oscillation, round(score_missing, 9) AS score_missing, score_stale, score_step, score_plausibility,
    round(0.2e0 * score_noise + 0.1e0 * (score_drift + score_spikes + score_oscillation + score_missing + score_stale) + 0.2e0 * score_step + 0.1e0 * score_plausibility, 6) AS sqi FROM scores""".replace(
    "FROM present_windows)", "FROM st WHERE len(x) = 50)"
)


@query("signal_quality_full", EVERY_SQL)
def signal_quality_full(spark, sf_dir):
    df = signals.process(rough_series(spark, sf_dir), EVERY)
    df = df.withColumns({c: F.round(c, 6) for c in ("score_oscillation", "sqi")})
    return rounded(df, *KEYS, *[f"score_{c}" for c in signals.COMPONENTS if c != "drift"], "sqi")


@query("signal_quality_latest", f"WITH {INDEX} SELECT signal_id, max(scan_ord) AS scan_ord, round(max_by(sqi, scan_ord), 9) AS sqi, max_by(quality_class, scan_ord) AS quality_class FROM quality GROUP BY signal_id")
def signal_quality_latest(spark, sf_dir):
    df = index_rows(spark, sf_dir)
    return df.groupBy("signal_id").agg(F.max("scan_ord").alias("scan_ord"), F.round(F.max_by("sqi", "scan_ord"), 9).alias("sqi"), F.max_by("quality_class", "scan_ord").alias("quality_class"))


@query("index_statistics", f"""WITH {INDEX}, backwards AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY scan_ord DESC) AS back FROM quality)
  SELECT signal_id, round(avg(sqi), 9) AS mean_sqi, round(min(sqi), 9) AS min_sqi, round(max(sqi), 9) AS max_sqi, round(max_by(sqi, scan_ord), 9) AS current_sqi FROM backwards WHERE back <= 100 GROUP BY signal_id""")  # fmt: skip
def index_statistics(spark, sf_dir):
    return rounded(signals.index_statistics(index_rows(spark, sf_dir)), "signal_id", "mean_sqi", "min_sqi", "max_sqi", "current_sqi")


@query("quality_changes", f"""WITH {INDEX}, p AS (SELECT *, lag(quality_class) {W}) AS previous_class FROM quality)
  SELECT signal_id, scan_ord, previous_class, quality_class FROM p WHERE previous_class <> quality_class""")  # fmt: skip
def quality_changes(spark, sf_dir):
    return signals.quality_changes(index_rows(spark, sf_dir)).select(*KEYS, "previous_class", "quality_class")


@query("dominant_cause", f"""WITH {INDEX} SELECT signal_id, scan_ord, CASE WHEN score_noise <= least(score_drift, score_spikes, 100) THEN 'noise' WHEN score_drift <= least(score_spikes, 100) THEN 'drift' ELSE 'spikes' END AS dominant_cause FROM quality""")
def dominant_cause(spark, sf_dir):
    return index_rows(spark, sf_dir).select(*KEYS, signals.dominant_cause().alias("dominant_cause"))


# --- incidents -------------------------------------------------------------------------------------

#: Limits under which the grid's signals and groups fall ill and get well again.
FAST = incidents.IncidentPolicy(start_persistence=2, end_persistence=3, start_sqi=40.0, end_sqi=45.0, critical_sqi=36.0, component_floor=40.0)


def grid_status(spark, sf_dir) -> DataFrame:
    """Status of the grid's cells, stored once: present ones with their index, absent ones by missing ratio."""
    grid = src.event_grid(spark, sf_dir).withColumn("penalty", F.when(F.col("value").isNull(), 1.0).otherwise(0.0))
    full = signals.missing(grid, SignalConfig(missing_window=20))
    there = full.where("value is not null")
    scored = signals.quality_index(signals.spikes(signals.variance(signals.drift(there))))
    wanted = [*KEYS, "sqi", *[f"score_{c}" for c in signals.COMPONENTS], "alert_level", "drift_alert", "spike_alert", "quality_class"]
    return stored(incidents.status(full.join(scored.select(*wanted), list(KEYS), "left"), FAST))


STATUS = f"""{GRID}, full_grid AS (SELECT *, avg(CASE WHEN value IS NULL THEN 1e0 ELSE 0 END) {W} ROWS 19 PRECEDING) AS missing_ratio FROM grid
), there AS (SELECT *, coalesce(value - lag(value) {W}), 0) AS drift, avg(value) {W} ROWS 19 PRECEDING) AS mean, coalesce(var_samp(value) {W} ROWS 19 PRECEDING), 0) AS variance
  FROM full_grid WHERE value IS NOT NULL
), noise AS (SELECT *, CASE WHEN abs(mean) > 1e-9 THEN sqrt(variance) / abs(mean) ELSE sqrt(variance) END AS noise_level FROM there), {SPIKES.format(base='noise')},
scored AS (SELECT *, 100 * exp(-noise_level / 0.1e0) AS a, 100 * exp(-abs(drift) / 1e0) AS b, 100 * (1 - least(spike_frequency / 0.05e0, 1e0)) AS c, 100 * (1 - missing_ratio) AS d FROM spiked
), idx AS (SELECT signal_id, scan_ord, a, b, c, d, greatest(least(0.25e0 * a + 0.25e0 * b + 0.2e0 * c + 15e0 + 0.15e0 * d, 100e0), 0e0) AS sqi FROM scored
), joined AS (SELECT f.signal_id, f.scan_ord, f.missing_ratio, 100 * (1 - f.missing_ratio) AS lack, i.sqi, a, b, c, d FROM full_grid f LEFT JOIN idx i USING (signal_id, scan_ord)
), status AS (SELECT signal_id, scan_ord,
  CASE WHEN sqi IS NULL THEN lack <= 40 ELSE sqi <= 40 OR lack <= 40 END AS degraded, CASE WHEN sqi IS NULL THEN lack >= 40 ELSE sqi >= 45 END AS recovered,
  CASE WHEN sqi IS NULL THEN CASE WHEN lack <= 40 THEN 'missing' ELSE 'unknown' END
    WHEN least(a, b, c, d) > 40 THEN 'unknown' WHEN d <= least(a, b, c) THEN 'missing' WHEN b <= least(a, c) THEN 'drift' WHEN c <= a THEN 'spikes' ELSE 'noise' END AS cause,
  CASE WHEN sqi <= 36 THEN 'critical' ELSE 'warning' END AS severity, coalesce(sqi, lack) AS status_sqi FROM joined)"""


@query("incident_status", f"WITH {STATUS} SELECT signal_id, scan_ord, degraded, recovered, cause, severity, round(status_sqi, 9) AS status_sqi FROM status")
def incident_status(spark, sf_dir):
    return rounded(grid_status(spark, sf_dir), *KEYS, "degraded", "recovered", "cause", "severity", "status_sqi")


#: One scan after another, as a machine would: the row before decides with the row at hand.
LIFE = """{name}_rows AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY scan_ord) AS n FROM {base}
), {name}_fold AS (
  SELECT DISTINCT {key}, 0::BIGINT AS n, NULL::BIGINT AS scan_ord, false AS active, 0 AS ill, 0 AS well, NULL::VARCHAR AS cause, NULL::VARCHAR AS severity, NULL::VARCHAR AS parts,
    NULL::BIGINT AS start_scan_index, NULL::BIGINT AS since, NULL::DOUBLE AS min_sqi, NULL::VARCHAR AS event, NULL::VARCHAR AS changed, false AS shown FROM {base}
  UNION ALL
  SELECT {key}, n, scan_ord, begun OR (was AND NOT ended), CASE WHEN was OR begun OR NOT degraded THEN 0 ELSE ill + 1 END, CASE WHEN was AND better AND NOT ended THEN well + 1 ELSE 0 END,
    CASE WHEN begun OR (was AND degraded) OR NOT was THEN cause ELSE cause0 END, CASE WHEN begun OR (was AND degraded) OR NOT was THEN severity ELSE severity0 END,
    CASE WHEN begun OR (was AND degraded) OR NOT was THEN parts ELSE parts0 END, CASE WHEN begun THEN scan_ord - {start} + 1 WHEN was THEN start0 END, CASE WHEN begun THEN scan_ord WHEN was THEN since0 END,
    CASE WHEN begun THEN status_sqi WHEN was AND degraded THEN least(min0, status_sqi) WHEN was THEN min0 END,
    CASE WHEN begun THEN 'started' WHEN ended THEN 'resolved' WHEN was AND degraded AND (cause <> cause0 OR severity <> severity0 OR parts <> parts0) THEN 'updated' END,
    CASE WHEN was AND degraded THEN concat_ws(',', CASE WHEN cause <> cause0 THEN 'cause' END, CASE WHEN severity <> severity0 THEN 'severity' END, CASE WHEN parts <> parts0 THEN 'parts' END) END, was OR begun
  FROM (SELECT b.{key}, b.n, b.scan_ord, b.degraded, b.cause, b.severity, b.parts, b.status_sqi, f.active AS was, f.ill, f.well, f.cause AS cause0, f.severity AS severity0, f.parts AS parts0,
      f.start_scan_index AS start0, f.since AS since0, f.min_sqi AS min0, NOT f.active AND b.degraded AND f.ill + 1 >= {start} AS begun, NOT b.degraded AND b.{recovered} AS better,
      f.active AND NOT b.degraded AND b.{recovered} AND f.well + 1 >= {end} AS ended
    FROM {name}_fold f JOIN {name}_rows b ON b.{key} = f.{key} AND b.n = f.n + 1)
), {name} AS (SELECT f.* FROM {name}_fold f WHERE f.n > 0)"""
INCIDENTS = f"""RECURSIVE {STATUS}, sbase AS (SELECT *, '' AS parts FROM status), {LIFE.format(name='lives', base='sbase', key='signal_id', recovered='recovered', start=2, end=3)}"""


def grid_incidents(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    df = incidents.signal_incidents(grid_status(spark, sf_dir) if rows is None else rows, FAST)
    return incidents.with_times(df.withColumn("timestamp", F.col("scan_ord") * 3600.0), "signal_id", "timestamp")


@query("signal_incidents", f"""WITH {INCIDENTS} SELECT l.signal_id, l.scan_ord, event, l.cause, l.severity, start_scan_index, 'run:' || l.signal_id || ':' || start_scan_index AS incident_id,
  round(s.status_sqi, 9) AS status_sqi, round(min_sqi, 9) AS min_sqi, since * 3600e0 AS start_timestamp, CASE WHEN event = 'resolved' THEN l.scan_ord * 3600e0 END AS end_timestamp,
  CASE event WHEN 'started' THEN 'Incident started for ' || l.signal_id || ' due to ' || l.cause || '.' WHEN 'resolved' THEN 'Incident resolved for ' || l.signal_id || '.'
    ELSE 'Incident updated for ' || l.signal_id || ' with ' || concat_ws(', ', CASE WHEN changed LIKE '%cause%' THEN 'cause ' || l.cause END, CASE WHEN changed LIKE '%severity%' THEN 'severity ' || l.severity END) || '.' END AS message
  FROM lives l JOIN status s USING (signal_id, scan_ord) WHERE event IS NOT NULL""")  # fmt: skip
def signal_incidents(spark, sf_dir):
    wanted = ("event", "cause", "severity", "start_scan_index", "incident_id", "status_sqi", "min_sqi", "start_timestamp", "end_timestamp", "message")
    return rounded(grid_incidents(spark, sf_dir).where("event is not null"), *KEYS, *wanted)


@query("incident_details", f"""WITH {INCIDENTS} SELECT l.signal_id, l.scan_ord, round(j.lack, 9) AS score_missing, round(j.a, 9) AS score_noise, round(j.missing_ratio, 9) AS missing_ratio,
  CASE WHEN j.sqi <= 25 THEN 'critical' WHEN j.sqi <= 50 THEN 'warning' WHEN j.sqi IS NOT NULL THEN 'none' END AS alert_level FROM lives l JOIN joined j USING (signal_id, scan_ord) WHERE event IS NOT NULL""")  # fmt: skip
def incident_details(spark, sf_dir):
    rows = grid_incidents(spark, sf_dir).where("event is not null").withColumn("d", incidents.signal_details())
    told = rows.select(*KEYS, F.col("d.components")["missing"].alias("score_missing"), F.col("d.components")["noise"].alias("score_noise"), F.col("d.effective_missing_ratio").alias("missing_ratio"), F.col("d.alert_level").alias("alert_level"))
    return rounded(told, *told.columns)


@query("incident_counts", f"WITH {INCIDENTS} SELECT event, cause, count(*) AS n FROM lives WHERE event IS NOT NULL GROUP BY ALL")
def incident_counts(spark, sf_dir):
    return grid_incidents(spark, sf_dir).where("event is not null").groupBy("event", "cause").agg(F.count("*").alias("n"))


@query("top_causes", f"WITH {INCIDENTS} SELECT cause, count(*) AS n FROM lives WHERE event = 'started' GROUP BY ALL ORDER BY n DESC, cause LIMIT 3")
def top_causes(spark, sf_dir):
    return incidents.started_by(grid_incidents(spark, sf_dir), "cause").orderBy(F.desc("n"), "cause").limit(3)


GROUPED = incidents.GroupPolicy(depth=1)
GROUPS = f"""{INCIDENTS}, members AS (SELECT split_part(signal_id, '_', 1) AS group_id, scan_ord, count(*) AS members, count(*) FILTER (degraded) AS degraded_members,
  coalesce(string_agg(CASE WHEN degraded THEN signal_id END, ',' ORDER BY signal_id), '') AS degraded_signals, count(*) FILTER (degraded AND cause = 'missing') AS gone FROM status GROUP BY ALL
), gstatus AS (SELECT *, degraded_members::DOUBLE / members AS fraction, degraded_members >= 2 AND degraded_members::DOUBLE / members >= 0.5 AS degraded,
  CASE WHEN gone > degraded_members - gone THEN 'comms' WHEN degraded_members - gone > gone THEN 'data_quality' ELSE 'mixed' END AS cause,
  CASE WHEN degraded_members::DOUBLE / members >= 0.8 THEN 'critical' ELSE 'warning' END AS severity FROM members
), gbase AS (SELECT *, degraded_signals AS parts, true AS recovered, NULL::DOUBLE AS status_sqi FROM gstatus), {LIFE.format(name='glives', base='gbase', key='group_id', recovered='recovered', start=2, end=2)}"""


def grid_groups(spark, sf_dir, status: DataFrame | None = None) -> DataFrame:
    status = grid_status(spark, sf_dir) if status is None else status
    rows = status.withColumn("group_id", incidents.group_of(F.col("signal_id"), GROUPED))
    return incidents.group_incidents(incidents.group_status(rows, GROUPED), GROUPED)


@query("group_incidents", f"""WITH {GROUPS} SELECT g.group_id, g.scan_ord, event, g.cause, g.severity, members, degraded_members, g.parts AS degraded_signals, round(fraction, 9) AS fraction, start_scan_index,
  'run:group:' || g.group_id || ':' || start_scan_index AS group_incident_id, 'Group incident ' || event || ' for ' || g.group_id || CASE WHEN event = 'updated' THEN ' with ' || concat_ws(', ',
    CASE WHEN changed LIKE '%cause%' THEN 'cause ' || g.cause END, CASE WHEN changed LIKE '%severity%' THEN 'severity ' || g.severity END, CASE WHEN changed LIKE '%parts%' THEN 'members' END) ELSE '' END || '.' AS message
  FROM glives g JOIN gstatus s USING (group_id, scan_ord) WHERE event IS NOT NULL""")  # fmt: skip
def group_incidents(spark, sf_dir):
    wanted = ("event", "cause", "severity", "members", "degraded_members", "degraded_signals", "fraction", "start_scan_index", "group_incident_id", "message")
    return rounded(grid_groups(spark, sf_dir).where("event is not null"), "group_id", "scan_ord", *wanted)


@query("group_details", f"""WITH {GROUPS}, per AS (SELECT split_part(signal_id, '_', 1) AS group_id, scan_ord, cause, count(*) AS n FROM status WHERE degraded GROUP BY ALL)
  SELECT group_id, scan_ord, string_agg(cause || '=' || n, ',' ORDER BY cause) AS cause_counts, string_agg(cause || '=' || n, ',' ORDER BY n DESC, cause) AS top_causes FROM per GROUP BY ALL""")  # fmt: skip
def group_details(spark, sf_dir):
    return incidents.group_details(grid_status(spark, sf_dir).withColumn("group_id", incidents.group_of(F.col("signal_id"), GROUPED)))


@query("active_groups", f"""WITH {GROUPS}, z AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY scan_ord DESC) AS back FROM glives)
  SELECT group_id, 'run:group:' || group_id || ':' || start_scan_index AS group_incident_id, cause, severity, parts AS degraded_signals FROM z WHERE back = 1 AND active""")  # fmt: skip
def active_groups(spark, sf_dir):
    return incidents.active_groups(grid_groups(spark, sf_dir))


SUPPRESSED = f"""{GROUPS}, filtered AS (SELECT l.signal_id, l.scan_ord, l.event, coalesce(g.active AND g.cause = 'comms', false) AND l.event IN ('started', 'updated') AS suppressed,
    (SELECT min(r.scan_ord) FROM glives r WHERE r.group_id = l.group_id AND r.event = 'resolved' AND r.scan_ord >= l.scan_ord) AS reemit
  FROM (SELECT *, split_part(signal_id, '_', 1) AS group_id FROM lives WHERE event IS NOT NULL) l LEFT JOIN glives g ON g.group_id = l.group_id AND g.scan_ord = l.scan_ord)"""


def grid_suppressed(spark, sf_dir) -> DataFrame:
    status = grid_status(spark, sf_dir)
    events = grid_incidents(spark, sf_dir, status).where("event is not null").withColumn("group_id", incidents.group_of(F.col("signal_id"), GROUPED))
    return incidents.suppress(events.select(*KEYS, "group_id", "event"), grid_groups(spark, sf_dir, status))


@query("event_suppression", f"WITH {SUPPRESSED} SELECT signal_id, scan_ord, event, suppressed, CASE WHEN suppressed THEN reemit END AS reemit_scan FROM filtered")
def event_suppression(spark, sf_dir):
    return grid_suppressed(spark, sf_dir).select(*KEYS, "event", "suppressed", "reemit_scan")


@query("suppression_counts", f"""WITH {SUPPRESSED}, here AS (SELECT scan_ord, count(*) AS total_events, count(*) FILTER (suppressed) AS suppressed_events,
  count(*) FILTER (suppressed AND event = 'started') AS suppressed_started, count(*) FILTER (suppressed AND event = 'updated') AS suppressed_updated FROM filtered GROUP BY scan_ord
), again AS (SELECT reemit AS scan_ord, count(*) AS reemitted_events FROM filtered WHERE suppressed AND reemit IS NOT NULL GROUP BY ALL)
  SELECT scan_ord, coalesce(total_events, 0) AS total_events, coalesce(suppressed_events, 0) AS suppressed_events, coalesce(suppressed_started, 0) AS suppressed_started,
  coalesce(suppressed_updated, 0) AS suppressed_updated, 0::BIGINT AS suppressed_resolved, coalesce(suppressed_events, 0) AS deferred_events, coalesce(reemitted_events, 0) AS reemitted_events
  FROM here FULL JOIN again USING (scan_ord)""")  # fmt: skip
def suppression_counts(spark, sf_dir):
    return incidents.suppression_counts(stored(grid_suppressed(spark, sf_dir)))


SPANS = """SELECT '{scope}' AS scope, count(*) FILTER (event = 'started') AS started, count(*) FILTER (event = 'updated') AS updated, count(*) FILTER (event = 'resolved') AS resolved,
  count(*) FILTER (event = 'started') - count(*) FILTER (event = 'resolved') AS active_end, round(coalesce(avg(spent), 0), 9) AS mean_duration,
  coalesce(quantile_disc(spent, 0.5), 0) AS p50, coalesce(quantile_disc(spent, 0.95), 0) AS p95 FROM (SELECT event, CASE WHEN event = 'resolved' THEN (scan_ord - since) * 3600e0 END AS spent FROM {lives})"""


def both_incidents(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Signal and group incidents of one stored status, with times."""
    status = grid_status(spark, sf_dir)
    return grid_incidents(spark, sf_dir, status), grid_groups(spark, sf_dir, status).withColumn("timestamp", F.col("scan_ord") * 3600.0)


@query("impact_report", f"WITH {GROUPS} {SPANS.format(scope='signal', lives='lives')} UNION ALL {SPANS.format(scope='group', lives='glives')}")
def impact_report(spark, sf_dir):
    one, two = both_incidents(spark, sf_dir)
    one, two = incidents.impact(one.where("event is not null")), incidents.impact(two.where("event is not null"), "group_incident_id")
    df = one.withColumn("scope", F.lit("signal")).unionByName(two.withColumn("scope", F.lit("group")))
    return rounded(df, "scope", "started", "updated", "resolved", "active_end", "mean_duration", "p50", "p95")


@query("impact_causes", f"WITH {GROUPS} SELECT 'signal' AS scope, cause, count(*) AS n FROM lives WHERE event = 'started' GROUP BY ALL UNION ALL SELECT 'group', cause, count(*) FROM glives WHERE event = 'started' GROUP BY ALL")
def impact_causes(spark, sf_dir):
    one, two = both_incidents(spark, sf_dir)
    return incidents.started_by(one, "cause").withColumn("scope", F.lit("signal")).unionByName(incidents.started_by(two, "cause").withColumn("scope", F.lit("group")))


@query("impact_groups", f"WITH {GROUPS} SELECT group_id, count(*) AS n FROM glives WHERE event = 'started' GROUP BY ALL")
def impact_groups(spark, sf_dir):
    return incidents.started_by(grid_groups(spark, sf_dir), "group_id")


@query("spam_ratio", f"""WITH {GROUPS}, n AS (SELECT (SELECT count(*) FROM lives WHERE event = 'started') AS signal_started, (SELECT count(*) FROM glives WHERE event = 'started') AS group_started)
  SELECT signal_started, group_started, round(CASE WHEN group_started > 0 THEN signal_started::DOUBLE / group_started ELSE 0 END, 9) AS ratio FROM n""")  # fmt: skip
def spam_ratio(spark, sf_dir):
    return rounded(incidents.spam_ratio(*both_incidents(spark, sf_dir)), "signal_started", "group_started", "ratio")


# --- comms and topology ----------------------------------------------------------------------------

METRICS = """metrics AS (
  SELECT year(l_shipdate) * 12 + month(l_shipdate) AS scan_index, CAST(l_suppkey AS VARCHAR) AS rtu_id, CAST(s_nationkey AS VARCHAR) AS poll_group_id, CAST(n_regionkey AS VARCHAR) AS comms_domain_id,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS timeout_count, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS retry_count, CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS crc_error_count,
    CAST(l_discount * 10000 AS DOUBLE) AS poll_jitter_ms, 500e0 * l_linenumber AS poll_cycle_ms, CAST(floor(l_quantity) AS BIGINT) AS bytes_tx, CAST(floor(l_extendedprice / 100) AS BIGINT) AS bytes_rx
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""
ROLLUP = f"""{METRICS}, rollups AS (SELECT scan_index, t AS node_type, CASE t WHEN 'RTU' THEN rtu_id WHEN 'POLL_GROUP' THEN poll_group_id ELSE comms_domain_id END AS node_id, count(*) AS sample_count,
  sum(timeout_count)::DOUBLE / count(*) AS timeout_rate, sum(retry_count)::DOUBLE / count(*) AS retry_rate, sum(crc_error_count)::DOUBLE / count(*) AS crc_error_rate,
  avg(poll_cycle_ms) AS avg_poll_cycle_ms, avg(poll_jitter_ms) AS avg_poll_jitter_ms, sum(bytes_tx)::BIGINT AS bytes_tx, sum(bytes_rx)::BIGINT AS bytes_rx
  FROM metrics, (VALUES ('RTU'), ('POLL_GROUP'), ('COMMS_DOMAIN')) ts(t) GROUP BY ALL)"""


def comms_rows(spark, sf_dir) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    # nations are a fixed set; suppliers are joined by whatever strategy their size asks for
    nations = F.broadcast(read("nation").select("n_nationkey", "n_regionkey"))
    places = read("supplier").select("s_suppkey", "s_nationkey").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = read("lineitem").join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    flag = lambda p: p.cast("int")
    return rows.select(
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("scan_index"),
        F.col("l_suppkey").cast("string").alias("rtu_id"),
        F.col("s_nationkey").cast("string").alias("poll_group_id"),
        F.col("n_regionkey").cast("string").alias("comms_domain_id"),
        flag(F.col("l_returnflag") == "R").alias("timeout_count"),
        flag(F.col("l_linestatus") == "F").alias("retry_count"),
        flag(F.col("l_linenumber") == 7).alias("crc_error_count"),
        (F.col("l_discount") * 10000).cast("double").alias("poll_jitter_ms"),
        (F.col("l_linenumber") * 500.0).alias("poll_cycle_ms"),
        F.floor("l_quantity").cast("long").alias("bytes_tx"),
        F.floor(F.col("l_extendedprice") / 100).cast("long").alias("bytes_rx"),
    )


NODE = ("scan_index", "node_type", "node_id")


@query("comms_rollup", f"""WITH {ROLLUP} SELECT scan_index, node_type, node_id, sample_count, round(timeout_rate, 9) AS timeout_rate, round(retry_rate, 9) AS retry_rate,
  round(crc_error_rate, 9) AS crc_error_rate, round(avg_poll_jitter_ms, 6) AS avg_poll_jitter_ms, bytes_tx, bytes_rx FROM rollups""")  # fmt: skip
def comms_rollup(spark, sf_dir):
    df = comms.rollup(comms_rows(spark, sf_dir)).withColumn("avg_poll_jitter_ms", F.round("avg_poll_jitter_ms", 6))
    return rounded(df, *NODE, "sample_count", "timeout_rate", "retry_rate", "crc_error_rate", "avg_poll_jitter_ms", "bytes_tx", "bytes_rx")


#: Limits that the rollups of the driver tables lie on both sides of.
MIXED = (("timeout_rate", "timeout_rate", 0.2, 0.4), ("retry_rate", "retry_rate", 0.5, 1.1), ("crc_error_rate", "crc_error_rate", 0.03, 0.2), ("avg_poll_jitter_ms", "jitter_ms", 480.0, 650.0), ("avg_poll_cycle_ms", "poll_cycle_ms", 1500.0, 2200.0))
REASONS = ", ".join(f"CASE WHEN {c} >= {critical} THEN '{name}_critical' WHEN {c} >= {warn} THEN '{name}_degraded' END" for c, name, warn, critical in MIXED)
HEALTH = f"""{ROLLUP}, exact AS (SELECT * REPLACE (round(avg_poll_jitter_ms, 6) AS avg_poll_jitter_ms, round(avg_poll_cycle_ms, 6) AS avg_poll_cycle_ms) FROM rollups
), reasoned AS (SELECT *, concat_ws(',', {REASONS}) AS reasons FROM exact
), health AS (SELECT *, CASE WHEN reasons LIKE '%critical%' THEN 'CRITICAL' WHEN reasons <> '' THEN 'DEGRADED' ELSE 'OK' END AS comms_class FROM reasoned)"""


def healths(spark, sf_dir) -> DataFrame:
    rows = comms.rollup(comms_rows(spark, sf_dir))
    return comms.health(rows.withColumns({c: F.round(c, 6) for c in ("avg_poll_jitter_ms", "avg_poll_cycle_ms")}), MIXED)


@query("comms_health", f"WITH {HEALTH} SELECT scan_index, node_type, node_id, comms_class, reasons FROM health")
def comms_health(spark, sf_dir):
    return healths(spark, sf_dir).select(*NODE, "comms_class", "reasons")


@query("comms_worst", f"""WITH {HEALTH} SELECT scan_index, node_type, node_id, comms_class, row_number() OVER (PARTITION BY scan_index, comms_class ORDER BY timeout_rate DESC, node_type, node_id)::INT AS place
  FROM health WHERE comms_class <> 'OK' QUALIFY place <= 10""")  # fmt: skip
def comms_worst(spark, sf_dir):
    return comms.worst_nodes(healths(spark, sf_dir)).select(*NODE, "comms_class", "place")


#: An interval that isn't the mean poll cycle, a node with a capacity of its own, and limits on both sides.
NARROW = comms.BudgetConfig(poll_interval_ms=500.0, capacity_bps={"RTU": 30_000, "POLL_GROUP": 120_000, "COMMS_DOMAIN": 1_000_000}, per_node_capacity_bps={"7": 9_000})
BUDGET = f"""{{base}}, capacities AS (SELECT *, CASE WHEN node_id = '7' THEN 9000 WHEN node_type = 'RTU' THEN 30000 WHEN node_type = 'POLL_GROUP' THEN 120000 ELSE 1000000 END AS capacity_bps FROM {{rows}}
), used AS (SELECT *, coalesce(bytes_tx + bytes_rx, 0) * 8e0 / 0.5e0 AS observed_bps FROM capacities), b AS (SELECT *, observed_bps / capacity_bps AS utilization FROM used
), budgets AS (SELECT *, CASE WHEN utilization >= 0.9 THEN 'CRITICAL' WHEN utilization >= 0.7 THEN 'DEGRADED' ELSE 'OK' END AS budget_level FROM b)"""
TOLD = "concat_ws(',', CASE WHEN budget_level <> 'OK' THEN 'UTILIZATION_' || budget_level END, CASE WHEN 1 - utilization <= 0.1e0 THEN 'LOW_HEADROOM' END) AS budget_reasons"


@query("comms_budget", f"""WITH {BUDGET.format(base=ROLLUP, rows='rollups')} SELECT scan_index, node_type, node_id, round(observed_bps, 6) AS observed_bps, round(utilization, 9) AS utilization,
  budget_level, {TOLD} FROM budgets""")  # fmt: skip
def comms_budget(spark, sf_dir):
    df = comms.budget(comms.rollup(comms_rows(spark, sf_dir)), NARROW).withColumn("observed_bps", F.round("observed_bps", 6))
    return rounded(df, *NODE, "observed_bps", "utilization", "budget_level", "budget_reasons")


ALL_NODES = f"""{ROLLUP}, every_node AS (SELECT 'RTU' AS node_type, CAST(s_suppkey AS VARCHAR) AS node_id, count(DISTINCT l_partkey % 4) AS signals FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL
  UNION ALL SELECT 'POLL_GROUP', CAST(n_nationkey AS VARCHAR), count(DISTINCT l_suppkey * 4 + l_partkey % 4) FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL
  UNION ALL SELECT 'COMMS_DOMAIN', CAST(n_regionkey AS VARCHAR), count(DISTINCT l_suppkey * 4 + l_partkey % 4) FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL
), full_rows AS (SELECT i.scan_index, n.node_type, n.node_id, n.signals, r.bytes_tx, r.bytes_rx FROM (SELECT DISTINCT scan_index FROM rollups) i CROSS JOIN every_node n
  LEFT JOIN rollups r ON r.scan_index = i.scan_index AND r.node_type = n.node_type AND r.node_id = n.node_id)"""


def comms_nodes(spark, sf_dir) -> DataFrame:
    """(node_type, node_id, signals) of suppliers, nations and regions."""
    nodes, edges = places(spark, sf_dir)
    kinds = F.create_map(*[F.lit(x) for pair in (("rtu", "RTU"), ("poll_group", "POLL_GROUP"), ("comms_domain", "COMMS_DOMAIN")) for x in pair])
    counts = topology.descendant_counts(stored(nodes), stored(edges)).where("type <> 'signal'")
    return counts.select(kinds[F.col("type")].alias("node_type"), F.expr("substring(id, 2)").alias("node_id"), F.col("descendants").alias("signals"))


def all_budgets(spark, sf_dir) -> DataFrame:
    return comms.budget_of_all(comms_nodes(spark, sf_dir), stored(comms.rollup(comms_rows(spark, sf_dir))), NARROW)


@query("budget_of_all_nodes", f"""WITH {BUDGET.format(base=ALL_NODES, rows='full_rows')} SELECT scan_index, node_type, node_id, 200 + 18 * signals AS expected_bytes, round(utilization, 9) AS utilization,
  budget_level, {TOLD} FROM budgets""")  # fmt: skip
def budget_of_all_nodes(spark, sf_dir):
    return rounded(all_budgets(spark, sf_dir), *NODE, "expected_bytes", "utilization", "budget_level", "budget_reasons")


@query("budget_summary", f"""WITH {BUDGET.format(base=ROLLUP, rows='rollups')}, ordered AS (SELECT *, CASE node_type WHEN 'COMMS_DOMAIN' THEN 0 WHEN 'POLL_GROUP' THEN 1 ELSE 2 END AS kind FROM budgets WHERE budget_level <> 'OK'
), placed AS (SELECT *, row_number() OVER (PARTITION BY scan_index, budget_level ORDER BY utilization DESC, kind, node_id)::INT AS place FROM ordered QUALIFY place <= 10)
  SELECT scan_index, node_type, node_id, budget_level, place, row_number() OVER (PARTITION BY scan_index ORDER BY budget_level, utilization DESC, kind, node_id) = 1 AS is_bottleneck FROM placed""")  # fmt: skip
def budget_summary(spark, sf_dir):
    return comms.budget_summary(comms.budget(comms.rollup(comms_rows(spark, sf_dir)), NARROW)).select(*NODE, "budget_level", "place", "is_bottleneck")


POLLS = "polls AS (SELECT user_id AS rtu_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, k > 1 AS poll_success, value * 5 AS rtt_ms, value AS jitter_ms, k AS dropout_streak FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS k FROM events))"


def poll_rows(spark, sf_dir) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int") % 10
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("rtu_id"), F.row_number().over(order).cast("long").alias("n"), (k > 1).alias("poll_success"), (F.col("value") * 5).alias("rtt_ms"), F.col("value").alias("jitter_ms"), k.alias("dropout_streak"))


@query("poll_statistics", f"""WITH {POLLS} SELECT rtu_id, n, (NOT poll_success OR rtt_ms >= 500 OR jitter_ms >= 200 OR dropout_streak >= 3) AS degraded, count(*) OVER w AS total_polls,
  CAST(count(*) FILTER (NOT poll_success) OVER w AS BIGINT) AS failed_polls, round(avg(rtt_ms) OVER w, 9) AS avg_rtt_ms, CAST(max(dropout_streak) OVER w AS INT) AS max_dropout_streak
  FROM polls WINDOW w AS (PARTITION BY rtu_id ORDER BY n)""")  # fmt: skip
def poll_statistics(spark, sf_dir):
    df = comms.poll_statistics(comms.poll_health(poll_rows(spark, sf_dir)), "rtu_id", "n")
    return df.select("rtu_id", "n", "degraded", "total_polls", "failed_polls", F.round("avg_rtt_ms", 9).alias("avg_rtt_ms"), "max_dropout_streak")


MONITOR = f"""{POLLS}, st AS (SELECT rtu_id, n, count(*) FILTER (NOT poll_success) OVER w::DOUBLE / count(*) OVER w AS f, avg(rtt_ms) OVER w AS r, avg(jitter_ms) OVER w AS j,
  max(dropout_streak) OVER w AS d FROM polls WINDOW w AS (PARTITION BY rtu_id ORDER BY n)
), tr AS (SELECT *, CASE WHEN n >= 10 THEN avg(f) OVER (w ROWS 4 PRECEDING) - avg(f) OVER (w ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) END AS lift,
  greatest(40 * (1 - f / 0.1e0), 0) + greatest(30 * (1 - r / 500e0), 0) + greatest(20 * (1 - j / 200e0), 0) + (10 - least(d * 2, 10)) AS score FROM st WINDOW w AS (PARTITION BY rtu_id ORDER BY n))"""


@query("comms_quality_monitor", f"""WITH {MONITOR} SELECT rtu_id, n, CASE WHEN lift > 0.05 THEN 'degrading' WHEN lift < -0.05 THEN 'improving' ELSE 'stable' END AS dropout_trend, round(score + 1e-7, 6) AS quality_score,
  CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'fair' WHEN score >= 25 THEN 'poor' ELSE 'critical' END AS quality_class FROM tr""")  # fmt: skip
def comms_quality_monitor(spark, sf_dir):
    df = comms.quality_monitor(comms.poll_statistics(poll_rows(spark, sf_dir), "rtu_id", "n"), "rtu_id", "n")
    # in decimals: scores of 625 polls and more lie on rounding ties even after the shift
    shifted = F.col("quality_score").cast("decimal(18,12)") + F.lit(Decimal("0.0000001"))
    return df.select("rtu_id", "n", "dropout_trend", F.round(shifted, 6).cast("double").alias("quality_score"), "quality_class")


PLACES = """nodes AS (SELECT 'r' || r_regionkey AS id, 'comms_domain' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, 'poll_group' FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'rtu' FROM supplier UNION ALL SELECT DISTINCT 'x' || l_suppkey || '_' || (l_partkey % 4), 'signal' FROM lineitem
), edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
  UNION ALL SELECT DISTINCT 's' || l_suppkey, 'x' || l_suppkey || '_' || (l_partkey % 4) FROM lineitem
), closed AS (SELECT parent AS ancestor, child AS descendant, 1 AS distance FROM edges UNION ALL SELECT c.ancestor, e.child, distance + 1 FROM closed c JOIN edges e ON c.descendant = e.parent)"""


def places(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    sig = F.concat(F.lit("x"), F.col("l_suppkey").cast("string"), F.lit("_"), (F.col("l_partkey") % 4).cast("string"))
    lines = read("lineitem").select("l_suppkey", sig.alias("signal")).distinct()
    kinds = [("region", name("r", "r_regionkey"), "comms_domain"), ("nation", name("n", "n_nationkey"), "poll_group"), ("supplier", name("s", "s_suppkey"), "rtu")]
    nodes = lines.select(F.col("signal").alias("id"), F.lit("signal").alias("type"))
    for t, c, kind in kinds:
        nodes = nodes.unionByName(read(t).select(c.alias("id"), F.lit(kind).alias("type")))
    edges = lines.select(name("s", "l_suppkey").alias("parent"), F.col("signal").alias("child"))
    edges = edges.unionByName(read("nation").select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")))
    return nodes, edges.unionByName(read("supplier").select(name("n", "s_nationkey").alias("parent"), name("s", "s_suppkey").alias("child")))


@query("topology_closure", f"WITH RECURSIVE {PLACES} SELECT ancestor, descendant, distance FROM closed")
def topology_closure(spark, sf_dir):
    return topology.closure(places(spark, sf_dir)[1])


@query("topology_counts", f"""WITH RECURSIVE {PLACES} SELECT n.id, n.type, count(d.id) AS descendants FROM nodes n LEFT JOIN closed c ON c.ancestor = n.id LEFT JOIN nodes d ON d.id = c.descendant AND d.type = 'signal' GROUP BY ALL""")
def topology_counts(spark, sf_dir):
    return topology.descendant_counts(*places(spark, sf_dir))


@query("topology_siblings", f"""WITH {PLACES.split('), closed')[0]}), p AS (SELECT id, type, coalesce(parent, '#' || type) AS under FROM nodes LEFT JOIN edges ON child = id)
  SELECT a.id, b.id AS sibling FROM p a JOIN p b ON a.under = b.under AND a.id <> b.id""")  # fmt: skip
def topology_siblings(spark, sf_dir):
    return topology.siblings(*places(spark, sf_dir))


@query("topology_parents", f"""WITH {PLACES.split('), closed')[0]}) SELECT s.child AS signal_id, s.parent AS rtu_id, g.parent AS poll_group_id, d.parent AS comms_domain_id
  FROM edges s JOIN edges g ON g.child = s.parent JOIN edges d ON d.child = g.parent WHERE s.child LIKE 'x%'""")  # fmt: skip
def topology_parents(spark, sf_dir):
    return topology.typed_parents(*places(spark, sf_dir)).select("signal_id", "rtu_id", "poll_group_id", "comms_domain_id")


@query("topology_ends", f"""WITH {PLACES.split('), closed')[0]}) SELECT id, type, NOT EXISTS (FROM edges WHERE child = id) AS is_root FROM nodes
  WHERE NOT EXISTS (FROM edges WHERE child = id) OR NOT EXISTS (FROM edges WHERE parent = id)""")  # fmt: skip
def topology_ends(spark, sf_dir):
    nodes, edges = places(spark, sf_dir)
    top, bottom = topology.roots(nodes, edges), topology.leaves(nodes, edges)
    return top.withColumn("is_root", F.lit(True)).unionByName(bottom.join(top.select("id"), "id", "left_anti").withColumn("is_root", F.lit(False)))


@query("node_order", f"""WITH {PLACES.split('), closed')[0]}) SELECT id, type, row_number() OVER (ORDER BY CASE type WHEN 'comms_domain' THEN 0 WHEN 'poll_group' THEN 1 WHEN 'rtu' THEN 2 ELSE 3 END, id)::INT AS node_order FROM nodes""")
def node_order(spark, sf_dir):
    return topology.node_order(places(spark, sf_dir)[0])


@query("topology_ancestors", f"WITH RECURSIVE {PLACES} SELECT descendant AS id, string_agg(ancestor, '/' ORDER BY distance DESC) AS ancestors FROM closed GROUP BY ALL")
def topology_ancestors(spark, sf_dir):
    return topology.ancestors(places(spark, sf_dir)[1])


@query("group_membership", f"""WITH {GRID} SELECT signal_id, CASE WHEN signal_id LIKE 'click%' THEN 'clicks' WHEN signal_id LIKE '%\\_0' ESCAPE '\\' THEN 'zeros' END AS explicit_group, split_part(signal_id, '_', 1) AS prefix_group, signal_id AS deep_group FROM firsts""")
def group_membership(spark, sf_dir):
    names = src.event_grid(spark, sf_dir).select("signal_id").distinct()
    explicit = F.when(F.col("signal_id").startswith("click"), "clicks").when(F.col("signal_id").endswith("_0"), "zeros")
    deep, none = incidents.group_of(F.col("signal_id"), incidents.GroupPolicy(depth=2)), incidents.group_of(F.col("signal_id"), incidents.GroupPolicy(depth=3))
    return names.select("signal_id", explicit.alias("explicit_group"), incidents.group_of(F.col("signal_id"), GROUPED).alias("prefix_group"), F.coalesce(none, deep).alias("deep_group"))


# --- sources, evaluation ---------------------------------------------------------------------------


@query("densify", f"WITH {GRID} SELECT signal_id, scan_ord, round(value, 9) AS value FROM grid")
def densify(spark, sf_dir):
    return rounded(src.event_grid(spark, sf_dir), *KEYS, "value")


@query("registry", f"WITH {GRID} SELECT signal_id, first_scan, row_number() OVER (ORDER BY first_scan, signal_id)::INT AS registration FROM firsts")
def registry(spark, sf_dir):
    return src.registry(src.event_grid(spark, sf_dir))


@query("scan_interval", "WITH t AS (SELECT DISTINCT epoch_us(ts) / 1e6 AS t FROM events), d AS (SELECT t - lag(t) OVER (ORDER BY t) AS d FROM t) SELECT round(coalesce(median(d), 0.1e0), 6) AS scan_interval FROM d WHERE d > 0")
def scan_interval(spark, sf_dir):
    times = spark.read.parquet(f"{sf_dir}/events.parquet").select(src.seconds("ts").alias("timestamp"))
    return src.scan_interval(times, 0.1).select(F.round("scan_interval", 6).alias("scan_interval"))


@query("point_quality", f"WITH {SERIES} SELECT signal_id, scan_ord, CASE WHEN k > 1 THEN value END AS value FROM series")
def point_quality(spark, sf_dir):
    return src.points(src.event_series(spark, sf_dir)).select(*KEYS, "value")


@query("latest_values", f"WITH {SERIES} SELECT signal_id, max_by(value, scan_ord) AS value, count(*) AS n FROM series GROUP BY signal_id")
def latest_values(spark, sf_dir):
    return src.event_series(spark, sf_dir).groupBy("signal_id").agg(F.max_by("value", "scan_ord").alias("value"), F.count("*").alias("n"))


@query("sweep_grid", "SELECT a AS start_sqi, b AS end_sqi, c AS persistence FROM (VALUES (40e0), (50e0)) x(a), (VALUES (60e0), (70e0)) y(b), (VALUES (1), (3), (5)) z(c)")
def sweep_grid(spark, sf_dir):
    return evaluation.grid(spark, {"start_sqi": [40.0, 50.0], "end_sqi": [60.0, 70.0], "persistence": [1, 3, 5]})


def intervals(rows: DataFrame, hit) -> DataFrame:
    """Runs of rows where ``hit`` holds, as (signal_id, start, end)."""
    w = by_signal()
    marked = rows.withColumn("_hit", hit).withColumn("_i", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(w))
    return marked.where("_hit").groupBy("signal_id", "_i").agg(F.min("scan_ord").alias("start"), F.max("scan_ord").alias("end")).drop("_i")


LABELLED = f"""{SERIES}, li AS (SELECT *, sum(CASE WHEN value > 100 THEN 0 ELSE 1 END) {W}) AS i FROM series), pi AS (SELECT *, sum(CASE WHEN value > 120 THEN 0 ELSE 1 END) {W}) AS i FROM series
), labelled AS (SELECT signal_id, min(scan_ord) AS s, max(scan_ord) AS e FROM li WHERE value > 100 GROUP BY signal_id, i), predicted AS (SELECT signal_id, min(scan_ord) AS s, max(scan_ord) AS e FROM pi WHERE value > 120 GROUP BY signal_id, i)"""


def matched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = src.event_series(spark, sf_dir)
    labels = intervals(rows, F.col("value") > 100)
    # invented causes and severities, of which labels name some
    told = lambda df: df.withColumns({"cause": F.concat(F.lit("c"), (F.col("start") % 3).cast("string")), "severity": F.concat(F.lit("s"), (F.col("start") % 2).cast("string"))})
    labels = told(labels).withColumn("severity", F.when(F.col("start") % 2 == 0, F.col("severity")))
    return evaluation.match(told(intervals(rows, F.col("value") > 120)), labels), labels


@query("label_match", f"""WITH {LABELLED}, pairs AS (SELECT p.signal_id, p.s AS pred_start, p.e AS pred_end, l.s AS label_start, l.e AS label_end FROM predicted p JOIN labelled l ON l.signal_id = p.signal_id AND p.s <= l.e AND p.e >= l.s),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY signal_id, label_start ORDER BY pred_start) AS k FROM pairs)
  SELECT p.signal_id, p.s AS pred_start, p.e AS pred_end, f.label_start, f.label_end FROM predicted p LEFT JOIN firsts f ON f.signal_id = p.signal_id AND f.pred_start = p.s AND f.k = 1""")  # fmt: skip
def label_match(spark, sf_dir):
    return matched(spark, sf_dir)[0].select("signal_id", "pred_start", "pred_end", "label_start", "label_end")


@query("evaluation_metrics", f"""WITH {LABELLED}, hits AS (SELECT l.signal_id, l.s, min(p.s) AS ps FROM labelled l JOIN predicted p ON l.signal_id = p.signal_id AND p.s <= l.e AND p.e >= l.s GROUP BY ALL),
  n AS (SELECT (SELECT count(*) FROM predicted) AS predicted, (SELECT count(*) FROM hits) AS matched, (SELECT count(*) FROM labelled) AS labels, (SELECT avg(greatest(ps - s, 0)) FROM hits) AS m)
  SELECT predicted, matched, labels, predicted / 5e0 AS starts_ratio, (SELECT round(avg(CASE WHEN ps % 3 = s % 3 THEN 1 ELSE 0 END), 9) FROM hits) AS cause_accuracy,
  (SELECT round(avg(CASE WHEN ps % 2 = s % 2 THEN 1 ELSE 0 END) FILTER (s % 2 = 0), 9) FROM hits) AS severity_accuracy, round(matched::DOUBLE / predicted, 9) AS precision, round(matched::DOUBLE / labels, 9) AS recall, round(coalesce(m, 0), 9) AS mttd_scans,
  round(2 * (matched::DOUBLE / predicted) * (matched::DOUBLE / labels) / (matched::DOUBLE / predicted + matched::DOUBLE / labels), 9) AS f1 FROM n""")  # fmt: skip
def evaluation_metrics(spark, sf_dir):
    wanted = ("predicted", "matched", "labels", "precision", "recall", "mttd_scans", "f1", "cause_accuracy", "severity_accuracy", "starts_ratio")
    return rounded(evaluation.metrics(*matched(spark, sf_dir), group_started=5), *wanted)


@query("scan_cost", f"""WITH {GRID}, n AS (SELECT scan_ord, count(*) AS n FROM grid GROUP BY ALL), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS c FROM n)
  SELECT round(max(n) * (1 + (0.02e0 * 10 + 0.03e0 * 20 + 0.04e0 * 50 + 0.01e0 * 100 + 0.02e0 * 5 + 0.02e0 * 10) / 100), 9) AS scan_p95_estimate,
    (SELECT count(*) FROM firsts) * ((10 + 20 + 50 + 100 + 5 + 3 + 10 + 3 + 5) * 8 + 256)::DOUBLE AS memory_estimate_bytes FROM r WHERE k = floor(0.95 * (c - 1))""")  # fmt: skip
def scan_cost(spark, sf_dir):
    return rounded(evaluation.scan_cost(src.event_grid(spark, sf_dir), SignalConfig()), "scan_p95_estimate", "memory_estimate_bytes")


# --- root causes -----------------------------------------------------------------------------------


#: Limit of missing ratios under which signals come and go.
LOST = 0.6


def grid_places(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A topology of the grid's signals: event types, their first letters, one domain."""
    kind = F.substring_index("signal_id", "_", 1)
    up = stored(names.select("signal_id", F.concat(F.lit("rtu_"), kind).alias("r"), F.concat(F.lit("pg_"), F.substring(kind, 1, 1)).alias("g")))
    level = lambda c, t: up.select(F.col(c).alias("id"), F.lit(t).alias("type")).distinct()
    top = names.sparkSession.range(1).select(F.lit("cd").alias("id"), F.lit("comms_domain").alias("type"))
    nodes = level("signal_id", "signal").unionByName(level("r", "rtu")).unionByName(level("g", "poll_group")).unionByName(top)
    over = lambda a, b: up.select(a.alias("parent"), b.alias("child")).distinct()
    edges = over(F.col("r"), F.col("signal_id")).unionByName(over(F.col("g"), F.col("r"))).unionByName(over(F.lit("cd"), F.col("g")))
    return nodes, edges


def rca_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored observations over the grid's incidents, and its topology."""
    rows = grid_incidents(spark, sf_dir)
    lowest = signals.dominant_cause()
    least = F.least(*[F.col(f"score_{c}") for c in signals.COMPONENTS])
    low = F.when(F.col("sqi").isNotNull(), F.when(least < 100, lowest).otherwise("unknown"))
    # missing and in every fifth scan critical incidents count, and the classes of one signal in four, so that there are well, ill and lost scans
    grave = F.col("active") & ((F.col("cause") == "missing") | ((F.col("severity") == "critical") & (F.col("scan_ord") % 5 == 0)))
    seen = F.when(F.col("signal_id").endswith("_3"), F.col("quality_class")).alias("quality_class")
    obs = rows.select(*KEYS, seen, "sqi", "missing_ratio", F.when(grave, F.col("cause")).alias("event_cause"), low.alias("low_cause"))
    obs = stored(rca.observations(obs, missing_limit=LOST))
    return obs, *grid_places(obs.select("signal_id").distinct())


OBSERVED = f"""{INCIDENTS}, facts AS (SELECT l.signal_id, l.scan_ord, j.sqi, j.missing_ratio, CASE WHEN l.active AND (l.cause = 'missing' OR (l.severity = 'critical' AND l.scan_ord % 5 = 0)) THEN l.cause END AS event_cause, coalesce(j.sqi >= 25 AND j.sqi < 50, false) AND l.signal_id LIKE '%\\_3' ESCAPE '\\' AS poor,
    CASE WHEN least(a, b, c, d) >= 100 THEN 'unknown' WHEN a <= least(b, c, d) THEN 'noise' WHEN b <= least(c, d) THEN 'drift' WHEN c <= d THEN 'spikes' ELSE 'missing' END AS low
  FROM lives l JOIN joined j USING (signal_id, scan_ord)
), hits AS (SELECT *, event_cause IS NOT NULL OR poor OR missing_ratio >= 0.6 AS hit, coalesce(event_cause, CASE WHEN poor THEN low END, 'missing') AS cause FROM facts
), breaks AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) {W}) AS i FROM hits
), obs AS (SELECT *, min(CASE WHEN hit THEN scan_ord END) OVER (PARTITION BY signal_id, i) AS onset FROM breaks
), tree AS (SELECT DISTINCT signal_id AS node_id, 'signal' AS type, 'rtu_' || split_part(signal_id, '_', 1) AS over FROM obs UNION ALL
  SELECT DISTINCT 'rtu_' || split_part(signal_id, '_', 1), 'rtu', 'pg_' || signal_id[1] FROM obs UNION ALL SELECT DISTINCT 'pg_' || signal_id[1], 'poll_group', 'cd' FROM obs UNION ALL SELECT 'cd', 'comms_domain', NULL
), leaf AS (SELECT DISTINCT signal_id FROM obs
), under AS (SELECT signal_id AS node_id, signal_id FROM leaf UNION ALL SELECT 'rtu_' || split_part(signal_id, '_', 1), signal_id FROM leaf UNION ALL SELECT 'pg_' || signal_id[1], signal_id FROM leaf UNION ALL SELECT 'cd', signal_id FROM leaf
), ev AS (SELECT scan_ord, t.node_id, t.type, t.over, any_value(n.total) AS total, count(*) FILTER (hit) AS affected, coalesce(max(onset) FILTER (hit) - min(onset) FILTER (hit), 0) AS span,
    count(*) FILTER (hit AND cause IN ('missing', 'stale')) AS comms, count(*) FILTER (hit AND cause IN ('noise', 'drift', 'spikes', 'oscillation')) AS quality
  FROM obs JOIN under u USING (signal_id) JOIN tree t ON t.node_id = u.node_id JOIN (SELECT node_id, count(*) AS total FROM under GROUP BY ALL) n ON n.node_id = u.node_id GROUP BY scan_ord, t.node_id, t.type, t.over
), fr AS (SELECT *, affected::DOUBLE / total AS fraction, exp(-span / 5e0) AS coherence, CASE WHEN affected > 0 THEN comms::DOUBLE / affected ELSE 0 END AS signature FROM ev
), conc AS (SELECT *, coalesce(fraction - (SELECT max(o.fraction) FROM fr o WHERE o.scan_ord = fr.scan_ord AND o.over = fr.over AND o.node_id <> fr.node_id), 0) AS concentration FROM fr
), cand AS (SELECT *, greatest(least((0.45e0 * fraction + 0.25e0 * greatest(least((concentration + 1) / 2, 1), 0) + 0.2e0 * coherence + 0.1e0 * signature) / 1.2e0, 1), 0) AS score, CASE type WHEN 'comms_domain' THEN 0 WHEN 'poll_group' THEN 1 WHEN 'rtu' THEN 2 ELSE 3 END AS kind
  FROM conc WHERE fraction >= CASE type WHEN 'comms_domain' THEN 0.25e0 WHEN 'poll_group' THEN 0.25e0 WHEN 'rtu' THEN 0.5e0 ELSE 1e0 END
), rk AS (SELECT *, row_number() OVER q AS rank, coalesce(score - lead(score) OVER q, 0.2e0) AS margin, CASE WHEN lag(scan_ord) OVER v = scan_ord - 1 THEN NULL ELSE scan_ord END AS first
  FROM cand WINDOW q AS (PARTITION BY scan_ord ORDER BY score DESC, kind, node_id), v AS (PARTITION BY node_id ORDER BY scan_ord)
), ranked AS (SELECT *, 0.4e0 * score + 0.3e0 * least(margin / 0.2e0, 1) + 0.3e0 * least((scan_ord - last_value(first IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY scan_ord)) / 2e0, 1) AS confidence FROM rk)"""
CANDIDATES = """SELECT scan_ord, node_id, type, total, affected, round(fraction, 9) AS fraction, round(concentration, 9) AS concentration, round(coherence, 9) AS coherence, round(signature, 9) AS signature,
  round(score, 9) AS score, rank::INT AS rank, round(confidence, 9) AS confidence,
  CASE WHEN confidence >= 0.9 THEN 'VERY_HIGH' WHEN confidence >= 0.75 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MODERATE' WHEN confidence >= 0.25 THEN 'LOW' ELSE 'VERY_LOW' END AS confidence_label,
  CASE WHEN affected = 0 THEN 'INVESTIGATE' WHEN comms::DOUBLE / affected > 0.7 THEN CASE type WHEN 'comms_domain' THEN 'CHECK_NETWORK_INFRASTRUCTURE' WHEN 'poll_group' THEN 'CHECK_POLL_GROUP_CONFIG' WHEN 'rtu' THEN 'CHECK_RTU_CONNECTIVITY'
    ELSE 'CHECK_SIGNAL_PATH' END WHEN quality::DOUBLE / affected > 0.5 THEN 'CHECK_SENSOR_CALIBRATION' ELSE 'INVESTIGATE' END AS action FROM ranked"""


def ranked(inputs) -> DataFrame:
    return stored(rca.confidences(rca.candidates(stored(rca.evidence(*inputs)))))


@query("root_causes", f"WITH {OBSERVED} {CANDIDATES}")
def root_causes(spark, sf_dir):
    wanted = ("scan_ord", "node_id", "type", "total", "affected", "fraction", "concentration", "coherence", "signature", "score", "rank", "action", "confidence", "confidence_label")
    return rounded(ranked(rca_inputs(spark, sf_dir)), *wanted)


@query("root_cause_report", f"""WITH {OBSERVED}, state AS (SELECT scan_ord, count(*) AS observed, count(*) FILTER (hit) AS affected_signals FROM obs GROUP BY ALL)
  SELECT s.scan_ord, observed, affected_signals, CASE WHEN affected_signals = 0 THEN 'OK' WHEN affected_signals > 0.5 * observed THEN 'OUTAGE' ELSE 'DEGRADED' END AS overall_state,
  CASE WHEN p.confidence >= 0.5 THEN p.node_id END AS primary_node_id, CASE WHEN p.confidence >= 0.5 THEN p.type END AS primary_type, CASE WHEN p.confidence >= 0.5 THEN round(p.score, 9) END AS primary_score,
  coalesce((SELECT string_agg(r.node_id, ',' ORDER BY r.rank) FROM ranked r WHERE r.scan_ord = s.scan_ord AND r.rank BETWEEN 2 AND 6), '') AS secondary
  FROM state s LEFT JOIN ranked p ON p.scan_ord = s.scan_ord AND p.rank = 1""")  # fmt: skip
def root_cause_report(spark, sf_dir):
    inputs = rca_inputs(spark, sf_dir)
    rows = rca.report(inputs[0], ranked(inputs), min_confidence=0.5)
    return rounded(rows, "scan_ord", "observed", "affected_signals", "overall_state", "primary_node_id", "primary_type", "primary_score", "secondary")


@query("impacted_nodes", f"WITH {OBSERVED} SELECT scan_ord, type, node_id FROM ev WHERE affected > 0")
def impacted_nodes(spark, sf_dir):
    return rca.impacted(rca.evidence(*rca_inputs(spark, sf_dir)))


@query("representative_signals", f"""WITH {OBSERVED} SELECT scan_ord, node_id, row_number() OVER (PARTITION BY scan_ord, node_id ORDER BY coalesce(sqi, 100), onset, signal_id)::INT AS place, signal_id
  FROM obs JOIN under USING (signal_id) WHERE hit QUALIFY place <= 12""")  # fmt: skip
def representative_signals(spark, sf_dir):
    return rca.representatives(*rca_inputs(spark, sf_dir))


@query("supporting_incidents", f"""WITH {OBSERVED} SELECT l.scan_ord, l.signal_id, l.event, row_number() OVER (PARTITION BY l.scan_ord ORDER BY coalesce(sqi, 100), l.signal_id)::INT AS place
  FROM lives l JOIN facts f USING (signal_id, scan_ord) WHERE l.event IS NOT NULL QUALIFY place <= 3""")  # fmt: skip
def supporting_incidents(spark, sf_dir):
    return rca.supporting(grid_incidents(spark, sf_dir).where("event is not null"), 3).select("scan_ord", "signal_id", "event", "place")


LINKS = f"""{OBSERVED}, aff AS (SELECT scan_ord, count(*) FILTER (hit) AS n, count(*) FILTER (hit AND cause IN ('missing', 'stale')) AS m,
    max(onset) FILTER (hit AND cause IN ('missing', 'stale')) - min(onset) FILTER (hit AND cause IN ('missing', 'stale')) AS span FROM obs GROUP BY ALL
), lk AS (SELECT scan_ord, CASE WHEN n > 0 THEN greatest(least(0.6e0 * m / n + 0.5e0 * coalesce(exp(-span / 4e0), 0) - 0.9e0 * (n - m) / n, 1), 0) ELSE 0 END AS raw FROM aff
), likeness AS (SELECT scan_ord, CASE WHEN raw >= 0.35 THEN raw ELSE 0 END AS likeness FROM lk
), strong AS (SELECT *, greatest(least((greatest(least((fraction - 0.7e0) / 0.2e0, 1), 0) + greatest(least((signature * 0.2e0 - 0.02e0) / 0.08e0, 1), 0) + greatest(least((coherence * 1000e0 - 250) / 500e0, 1), 0)) / 3, 1), 0) AS strength FROM conc
), boosted AS (SELECT s.*, likeness, CASE type WHEN 'rtu' THEN 0.5e0 WHEN 'signal' THEN 0e0 ELSE 1e0 END * likeness AS lifted FROM strong s JOIN likeness USING (scan_ord)
), both_terms AS (SELECT *, 0.35e0 * lifted * strength * fraction * greatest(least(concentration, 1), 0) AS boost, 0.25e0 * lifted * (1 - strength) * fraction AS counter FROM boosted)"""


@query("comms_root_causes", f"""WITH {LINKS} SELECT scan_ord, node_id, round(likeness, 9) AS likeness, round(strength, 9) AS strength, round(boost, 9) AS comms_boost, round(counter, 9) AS comms_counter,
  round(greatest(least((0.45e0 * fraction + 0.25e0 * greatest(least((concentration + 1) / 2, 1), 0) + 0.2e0 * coherence + 0.1e0 * signature + boost - counter) / 1.2e0, 1), 0), 9) AS score
  FROM both_terms WHERE fraction >= CASE type WHEN 'comms_domain' THEN 0.25e0 WHEN 'poll_group' THEN 0.25e0 WHEN 'rtu' THEN 0.5e0 ELSE 1e0 END""")  # fmt: skip
def comms_root_causes(spark, sf_dir):
    """Candidates with boost and counter of communications; the nodes' measures are made of their evidence."""
    inputs = rca_inputs(spark, sf_dir)
    found = stored(rca.evidence(*inputs))
    measures = found.select("scan_ord", "node_id", F.col("fraction").alias("utilization"), (F.col("signature") * 0.2).alias("timeout_rate"), (F.col("coherence") * 1000).alias("avg_poll_jitter_ms"))
    rows = rca.candidates(found, rca.likeness(inputs[0]), rca.strength(measures))
    return rounded(rows, "scan_ord", "node_id", "likeness", "strength", "comms_boost", "comms_counter", "score")


TRACKED = f"""{OBSERVED}, ends AS (SELECT node_id, scan_ord, lead(scan_ord) OVER (PARTITION BY node_id ORDER BY scan_ord) AS next FROM ranked
), trows AS (SELECT node_id, scan_ord, score, confidence FROM ranked UNION ALL SELECT node_id, scan_ord + 1, NULL, NULL FROM ends WHERE coalesce(next <> scan_ord + 1, true) AND scan_ord < (SELECT max(scan_ord) FROM obs)
), tnum AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY scan_ord) AS n FROM trows
), track AS (
  SELECT DISTINCT node_id, 0::BIGINT AS n, NULL::BIGINT AS scan_ord, NULL::BIGINT AS start, NULL::DOUBLE AS pc, NULL::DOUBLE AS ps, NULL::BIGINT AS until, 'none' AS action, NULL::DOUBLE AS oc, NULL::DOUBLE AS os, NULL::BIGINT AS ostart FROM tnum
  UNION ALL
  SELECT node_id, n, scan_ord, CASE WHEN opened THEN scan_ord WHEN kept THEN start END, CASE WHEN opened THEN confidence WHEN kept THEN greatest(pc, confidence) END, CASE WHEN opened THEN score WHEN kept THEN greatest(ps, score) END,
    CASE WHEN closed THEN scan_ord + 3 ELSE until END, CASE WHEN opened THEN 'opened' WHEN kept THEN 'updated' WHEN closed THEN 'closed' ELSE 'none' END,
    CASE WHEN opened THEN confidence WHEN kept THEN greatest(pc, confidence) WHEN closed THEN pc END, CASE WHEN opened THEN score WHEN kept THEN greatest(ps, score) WHEN closed THEN ps END, CASE WHEN opened THEN scan_ord ELSE start END
  FROM (SELECT *, start IS NOT NULL AND NOT closed AS kept, NOT closed AND start IS NULL AND score IS NOT NULL AND NOT coalesce(scan_ord < until, false) AND confidence >= 0.7 AND score >= 0.5 AS opened FROM (
    SELECT t.node_id, t.n, t.scan_ord, t.score, t.confidence, f.start, f.pc, f.ps, f.until, f.start IS NOT NULL AND (t.score IS NULL OR t.confidence < 0.3 OR t.score < 0.2) AS closed FROM track f JOIN tnum t ON t.node_id = f.node_id AND t.n = f.n + 1))
), tracked AS (SELECT node_id, scan_ord, action, oc AS peak_confidence, os AS peak_score, ostart AS start_scan FROM track WHERE action <> 'none')"""


def tracked(inputs) -> DataFrame:
    return rca.track(ranked(inputs), inputs[0].agg(F.max("scan_ord").alias("scan_ord")))


@query("node_incidents", f"WITH {TRACKED} SELECT node_id, scan_ord, action, round(peak_confidence, 9) AS peak_confidence, round(peak_score, 9) AS peak_score, start_scan FROM tracked")
def node_incidents(spark, sf_dir):
    return rounded(tracked(rca_inputs(spark, sf_dir)), "node_id", "scan_ord", "action", "peak_confidence", "peak_score", "start_scan")


@query("topology_suppression", f"""WITH {TRACKED}, act AS (SELECT k.scan_ord, k.node_id, k.peak_confidence FROM tracked k JOIN tree t USING (node_id) WHERE action <> 'closed' AND type <> 'signal' AND peak_confidence >= 0.5
), ups AS (SELECT node_id AS d, over AS a FROM tree WHERE over IS NOT NULL UNION ALL SELECT u.d, t.over FROM ups u JOIN tree t ON t.node_id = u.a WHERE t.over IS NOT NULL
), sup AS (SELECT scan_ord, d AS node_id, a.node_id AS suppressed_by, row_number() OVER (PARTITION BY scan_ord, d ORDER BY peak_confidence DESC, a.node_id) AS k FROM act a JOIN ups ON ups.a = a.node_id)
  SELECT scan_ord, node_id, suppressed_by FROM sup WHERE k = 1""")  # fmt: skip
def topology_suppression(spark, sf_dir):
    inputs = rca_inputs(spark, sf_dir)
    active = tracked(inputs).where("action <> 'closed'").join(inputs[1].select(F.col("id").alias("node_id"), "type"), "node_id")
    return rca.suppressors(active, inputs[2])


@query("unsuppressed_candidates", f"""WITH {TRACKED}, act AS (SELECT k.scan_ord, k.node_id, k.peak_confidence FROM tracked k JOIN tree t USING (node_id) WHERE action <> 'closed' AND type <> 'signal' AND peak_confidence >= 0.5
), ups AS (SELECT node_id AS d, over AS a FROM tree WHERE over IS NOT NULL UNION ALL SELECT u.d, t.over FROM ups u JOIN tree t ON t.node_id = u.a WHERE t.over IS NOT NULL)
  SELECT scan_ord, node_id FROM ranked r WHERE NOT EXISTS (FROM act a JOIN ups ON ups.a = a.node_id WHERE a.scan_ord = r.scan_ord AND ups.d = r.node_id)""")  # fmt: skip
def unsuppressed_candidates(spark, sf_dir):
    inputs = rca_inputs(spark, sf_dir)
    rows = ranked(inputs)
    active = rca.track(rows, inputs[0].agg(F.max("scan_ord").alias("scan_ord"))).where("action <> 'closed'").join(inputs[1].select(F.col("id").alias("node_id"), "type"), "node_id")
    return rca.unsuppressed(rows.select("scan_ord", "node_id"), rca.suppressors(active, inputs[2]))

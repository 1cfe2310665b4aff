"""Sources: scan files, CSV signals, point readings, and the driver tables as signals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetrica.functions.storage import stored

#: Field names and types of scan records.
SAMPLE = "struct<value:double,quality:string,source_timestamp:double>"
COMMS = (
    "array<struct<scan_index:long,scan_timestamp:double,signal_id:string,rtu_id:string,poll_group_id:string,comms_domain_id:string,"
    "poll_cycle_ms:double,poll_jitter_ms:double,timeout_count:int,retry_count:int,crc_error_count:int,bytes_tx:long,bytes_rx:long>>"
)
SCAN = f"scan_index long, timestamp double, signals string, comms_metrics {COMMS}"
QUALITIES = ("good", "uncertain", "bad")
SCAN_KEYS, SAMPLE_KEYS = ("scan_index", "timestamp", "signals", "comms_metrics"), ("value", "quality", "source_timestamp")
COMMS_KEYS = tuple(x.split(":")[0] for x in COMMS.removeprefix("array<struct<").removesuffix(">>").split(","))


def read_scans(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Scan records of JSON lines, signals still as text; blank lines are passed over."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.text(path).where(F.trim("value") != "")
    record = F.from_json("value", SCAN.replace("signals string", "signals map<string,string>"))
    return lines.select(record.alias("r"), "value").select("r.*", F.col("value").alias("line"))


def invalid_scans(scans: DataFrame) -> DataFrame:
    """The records that miss a required field, hold unknown keys or qualities, or comms metrics without all keys, with the reason."""
    top = F.from_json("line", "map<string,string>")
    nested = F.filter(F.map_values("signals"), lambda x: F.ltrim(x).startswith("{"))
    qualities = F.transform(nested, lambda x: F.lower(F.trim(F.get_json_object(x, "$.quality"))))
    metrics = F.from_json(top["comms_metrics"], "array<map<string,string>>")
    within = lambda keys, allowed: F.size(F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))) > 0
    needed = F.array(*[F.lit(k) for k in COMMS_KEYS])
    reason = (
        F.when(F.col("scan_index").isNull(), "scan_index")
        .when(F.col("timestamp").isNull(), "timestamp")
        .when(F.col("signals").isNull(), "signals")
        .when(within(F.map_keys(top), SCAN_KEYS), "unknown key")
        .when(F.exists(nested, lambda x: within(F.json_object_keys(x), SAMPLE_KEYS)), "unknown sample key")
        .when(F.exists(qualities, lambda q: q.isNotNull() & ~q.isin(*QUALITIES)), "quality")
        .when(top["comms_metrics"].isNotNull() & metrics.isNull(), "comms_metrics")
        .when(F.exists(metrics, lambda m: F.size(F.array_except(needed, F.map_keys(m))) > 0), "comms key")
    )
    return scans.withColumn("reason", reason).where("reason is not null")


def samples(scans: DataFrame) -> DataFrame:
    """Long rows (scan_ord, ts, signal_id, value, quality, source_timestamp) of scan records."""
    rows = scans.select("scan_index", "timestamp", F.explode("signals").alias("signal_id", "raw"))
    rich = F.from_json("raw", SAMPLE)
    nested = F.ltrim("raw").startswith("{")
    return rows.select(
        F.col("scan_index").alias("scan_ord"),
        F.col("timestamp").alias("ts"),
        "signal_id",
        F.when(nested, rich["value"]).otherwise(F.expr("try_cast(raw as double)")).alias("value"),
        F.coalesce(F.when(nested, F.lower(F.trim(rich["quality"]))), F.lit("good")).alias("quality"),
        F.when(nested, rich["source_timestamp"]).alias("source_timestamp"),
    )


def comms_metrics(scans: DataFrame) -> DataFrame:
    return scans.select(F.explode("comms_metrics").alias("m")).select("m.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows (timestamp, signal_id, value) of a CSV file with header; blanks are null, a blank id is an error."""
    raw = spark.read.csv(path, header=True, enforceSchema=False, schema="timestamp string, signal_id string, value string")
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    checked = F.when(blank("signal_id").isNull(), F.raise_error(F.lit("signal_id is empty"))).otherwise(blank("signal_id"))
    return raw.select(blank("timestamp").cast("double").alias("timestamp"), checked.alias("signal_id"), blank("value").cast("double").alias("value"))


def scans_of(rows: DataFrame, order: str) -> DataFrame:
    """(scan_ord, ts, signal_id, value): one scan per timestamp, every signal of the rows in it (absent cells null);
    of repeated cells the last in ``order``. Rows without timestamp are scans of their own behind the others.
    """
    timed = rows.where("timestamp is not null")
    cells = timed.groupBy("timestamp", "signal_id").agg(F.max_by(F.struct("value"), order).alias("v")).select("timestamp", "signal_id", "v.value")
    times = numbered(timed.select("timestamp").distinct(), "timestamp", "scan_ord")
    loose = numbered(rows.where("timestamp is null"), order, "_k")
    grid = times.join(rows.select("signal_id").distinct()).join(cells, ["timestamp", "signal_id"], "left")
    after = times.agg(F.coalesce(F.max("scan_ord"), F.lit(0)).alias("_after"))  # one row
    last = loose.join(F.broadcast(after)).select((F.col("_after") + F.col("_k")).alias("scan_ord"), F.lit(None).cast("double").alias("ts"), "signal_id", "value")
    return grid.select("scan_ord", F.col("timestamp").alias("ts"), "signal_id", "value").unionByName(last)


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` numbered from 1 in ``order``, by ranges: each range is numbered by itself and starts after those before it."""
    ranged = stored(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_r", F.spark_partition_id()))
    sizes = ranged.groupBy("_r").agg(F.count("*").alias("_n"))  # a row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy("_r").orderBy(order))
    return ranged.withColumn("_at", at).join(F.broadcast(sizes.select("_r", before.alias("_b"))), "_r").withColumn(name, F.col("_at") + F.col("_b")).drop("_r", "_at", "_b")


def scan_interval(times: DataFrame, default: float) -> DataFrame:
    """One row: the median of the positive steps between timestamps, or the default."""
    at = numbered(times.select("timestamp").where("timestamp is not null").distinct(), "timestamp", "_k")
    before = at.select((F.col("_k") + 1).alias("_k"), F.col("timestamp").alias("_b"))
    steps = at.join(before, "_k").withColumn("step", F.col("timestamp") - F.col("_b")).where("step > 0")
    return steps.agg(F.coalesce(F.median("step"), F.lit(default)).alias("scan_interval"))


def registry(rows: DataFrame, most: int | None = None, policy: str = "error") -> DataFrame:
    """Signals in order of first appearance; beyond ``most`` an error or ignored."""
    first = rows.groupBy("signal_id").agg(F.min("scan_ord").alias("first_scan"))
    placed = numbered(first.withColumn("_o", F.struct("first_scan", "signal_id")), "_o", "registration")
    out = placed.drop("_o").withColumn("registration", F.col("registration").cast("int"))
    if most is None:
        return out
    if policy == "ignore_new":
        return out.where(F.col("registration") <= most)
    return out.withColumn("registration", F.when(F.col("registration") > most, F.raise_error(F.lit("too many signals"))).otherwise(F.col("registration")))


def unregister(known: DataFrame, ids: list[str]) -> DataFrame:
    """The registry without some signals."""
    return known.where(~F.col("signal_id").isin(*ids))


def evicting_registry(rows: DataFrame, most: int) -> DataFrame:
    """(signal_id, registered_scan, evicted_scan) where a new signal drives out the one registered longest.

    A signal that was driven out registers anew when it comes again. The policy ties all signals together, so it is
    one ordered pass; it holds ``most`` signals and reads a row a signal and scan.
    """
    kind = rows.schema["signal_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        out: list[tuple] = []
        shape = None
        for batch in batches:
            shape = batch.schema
            for scan, signal in zip(batch.column("scan_ord").to_pylist(), batch.column("signal_id").to_pylist(), strict=True):
                if signal not in held:
                    if len(held) >= most:
                        oldest = next(iter(held))
                        out.append((oldest, held.pop(oldest), scan))
                    held[signal] = scan
            yield packed(out, shape)
            out = []
        if held:
            yield packed([(signal, scan, None) for signal, scan in held.items()], shape)

    def packed(out: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (shape.field("signal_id").type, pa.int64(), pa.int64()), strict=True)], ["signal_id", "registered_scan", "evicted_scan"])

    seen = rows.select(F.col("scan_ord").cast("long"), "signal_id").distinct()
    return seen.repartition(1).sortWithinPartitions("scan_ord", "signal_id").mapInArrow(run, f"signal_id {kind}, registered_scan long, evicted_scan long")


def densify(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Every registered signal in every scan from its first on; absent cells are missing.

    Each signal's scan numbers are spelt out from its first to the last of all and met with the scans that
    there are, so all joins are on equal keys; scan numbers count scans.
    """
    cells = [c for c in rows.columns if c not in ("ts", "signal_id", "scan_ord")]
    scans = rows.groupBy("scan_ord").agg(F.max("ts").alias("ts")) if "ts" in rows.columns else rows.select("scan_ord").distinct()
    last = scans.agg(F.max("scan_ord").alias("_last"))  # one row
    spelt = known.select("signal_id", "first_scan").join(F.broadcast(last)).select("signal_id", F.explode(F.sequence("first_scan", "_last")).alias("scan_ord"))
    return spelt.join(scans, "scan_ord").join(rows.select("scan_ord", "signal_id", *cells), ["scan_ord", "signal_id"], "left")


def unknown_signals(rows: DataFrame, known: DataFrame, policy: str = "ignore") -> DataFrame:
    """Rows of known signals; with policy ``error`` the smallest unknown id is named."""
    if policy == "error":
        stray = rows.join(known, "signal_id", "left_anti").agg(F.min("signal_id")).first()[0]
        if stray is not None:
            raise KeyError(f"unknown signal: {stray}")
    return rows.join(known, "signal_id", "left_semi")


def points(rows: DataFrame) -> DataFrame:
    """Point readings as samples: any quality but GOOD reads as missing."""
    return rows.withColumn("value", F.when(F.upper("quality") == "GOOD", F.col("value")))


def changed_points(rows: DataFrame) -> DataFrame:
    """Points whose type or address isn't the same in all readings."""
    kinds = rows.groupBy("point_id").agg(F.countDistinct("point_type", "address").alias("variants"))
    return kinds.where("variants > 1")


def simulated(spark: SparkSession, signals: int, scans: int, interval: float = 0.1, seed: int = 42, noise: float = 0.5) -> DataFrame:
    """10 sin(2 pi 0.5 t) with noise, for each signal and scan."""
    n = spark.range(signals * scans)
    t = F.col("scan_ord") * interval
    rows = n.select((F.col("id") % signals).alias("signal_id"), F.floor(F.col("id") / signals).alias("scan_ord"))
    return rows.withColumns({"ts": t, "value": 10 * F.sin(2 * 3.141592653589793 * 0.5 * t) + noise * F.randn(seed)})


def drifting(spark: SparkSession, signals: int, scans: int, slope: float = 0.05, **more) -> DataFrame:
    """``simulated`` signals that move away by ``slope`` a scan."""
    return simulated(spark, signals, scans, **more).withColumn("value", F.col("value") + slope * F.col("scan_ord"))


def spiked(spark: SparkSession, signals: int, scans: int, every: int = 50, height: float = 30.0, **more) -> DataFrame:
    """``simulated`` signals with a spike in every so many scans."""
    hit = F.col("scan_ord") % every == every - 1
    return simulated(spark, signals, scans, **more).withColumn("value", F.col("value") + F.when(hit, height).otherwise(0.0))


# --- the driver tables as signals ------------------------------------------------------------------


def seconds(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal per user: (signal_id, scan_ord, ts, value, quality), in order of time."""
    # renamed before numbering, so that later windows find the rows dealt and sorted by the key already
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.col("user_id").alias("signal_id"), "value", "props")
    order = Window.partitionBy("signal_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int") % 10
    return events.select(
        "signal_id",
        F.row_number().over(order).cast("long").alias("scan_ord"),
        seconds("ts").alias("ts"),
        "value",
        F.when(k == 0, "bad").when(k == 1, "uncertain").otherwise("good").alias("quality"),
    )


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly scans of 20 signals (type and user class), null where nothing happened since the first one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "user_id", "value")
    hour = F.floor(seconds("ts") / 3600).cast("long")
    cells = stored(events.groupBy(hour.alias("scan_ord"), F.concat_ws("_", "event_type", (F.col("user_id") % 4).cast("string")).alias("signal_id")).agg(F.avg("value").alias("value")))
    first = cells.groupBy("signal_id").agg(F.min("scan_ord").alias("first_scan"))
    return densify(cells, first).select("signal_id", "scan_ord", "value")

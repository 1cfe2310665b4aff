"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between Spark and a worker, where the session doesn't say.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in bytes, so that long texts don't add up; the bound stays with the session."""
    if df.sparkSession.conf.get(BATCH_KEY, None) is None:
        df.sparkSession.conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``rows`` applied to each Arrow batch; one narrow stage, memory bounded by a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield rows(batch)

    return in_arrow(df, run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; chosen here only where all run on one machine."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints"


def _cuts(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cuts-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: a short lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{_cuts(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Delete the tables that ``cut`` has written for this application; results made from them must be stored by then."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_cuts(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_resident: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], object]):
    """What this worker keeps between tasks for the operator that it works for; another operator's is let go first."""
    if key not in _resident:
        if any(k[0] != key[0] for k in _resident):
            _resident.clear()
            give_back()
        _resident[key] = make()
    return _resident[key]


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Fixed value: a word of the contracts.
WORD = re.compile(r"[^ \t-\r]+")
#: White space that str.split() splits at and the contracts don't.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def words_of(text: str) -> list[str]:
    """The maximal runs without ASCII white space."""
    return WORD.findall(text) if OTHER_SPACE.search(text) else text.split()

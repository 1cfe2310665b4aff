"""Structured Streaming: the same steps as the batch folds, kept in state per signal.

Rows of a signal are taken in scan order within each micro-batch; state is bounded by one fold state
per signal and dropped after ``ttl`` without rows (if given). Late rows aren't dropped: order is arrival
order, as in batch; a watermark and ``dropDuplicatesWithinWatermark`` can be put before it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stateful_fold(df: DataFrame, key: str, order: str, inputs: list[str], outputs: str, start: Callable, step: Callable, ttl: int | None = None) -> DataFrame:
    """Key, order and ``outputs`` (DDL) of ``step`` over a stream; the state is one pickled value."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [x.strip().rsplit(" ", 1)[0] for x in outputs.split(",")]

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        held = pickle.loads(state.get[0]) if state.exists else start()
        out = []
        for values in rows[inputs].itertuples(index=False):
            held, found = step(held, *[None if pd.isna(v) else v for v in values])
            out.append(found)
        state.update((pickle.dumps(held),))
        if ttl:
            state.setTimeoutDuration(ttl)
        result = pd.DataFrame(out, columns=names)
        result.insert(0, order, rows[order].to_numpy())
        result.insert(0, key, keys[0])
        yield result

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout
    columns = list(dict.fromkeys([key, order, *inputs]))
    return df.select(*columns).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {outputs}", "held binary", "append", timeout)


def publish(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, interval: str | None = None):
    """A running query that hands every micro-batch to all sinks; without an interval it ends with the input."""

    def each(batch: DataFrame, number: int) -> None:
        for sink in sinks:
            sink(batch, number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start() if interval else writer.trigger(availableNow=True).start()

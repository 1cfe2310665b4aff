"""Best-two-fit packing of token sequences, planned on the histogram of piece lengths.

Fill a bin greedily with the longest piece that fits, then replace its smallest piece with two
unpacked pieces that fill the expanded gap more tightly. Bins that look alike are planned once, with
a multiplicity, so the driver sees only one count per length (at most ``capacity`` numbers, whatever
the input). Pieces then find their place by their rank among the pieces of their length; ranks are
counted in salted buckets, so a length that a third of all pieces share is dealt over many tasks.

Defined results: a null text is an empty one; an empty text is the end token alone; equal pieces
(repeated rows and ids included) get different places; an empty table gives an empty result; columns
other than the two named are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetrica.llm.bytebpe import encode_ids
from telemetrica.llm.common import cut, map_batches, table, texts_of

CAPACITY = 1024
END = 2
ROWS_PER_BUCKET = 250_000


@dataclass
class Plan:
    """Where the pieces of each length go: per length, first ranks of runs with their first sequence and offset."""

    first: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    sequences: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the piece with each length and rank (from 0)."""
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            run = np.searchsorted(self.first[int(n)], ranks[at], side="right") - 1
            sequence[at] = self.sequence[int(n)][run] + ranks[at] - self.first[int(n)][run]
            offset[at] = self.offset[int(n)][run]
        return sequence, offset


def _greedy(left: np.ndarray, capacity: int) -> list[int]:
    """The longest piece left, then again and again the longest that still fits."""
    left, gap, chosen = left.copy(), capacity, []
    while gap:
        fits = np.flatnonzero(left[: gap + 1])
        if not len(fits):
            break
        n = int(fits[-1])
        take = min(int(left[n]), gap // n)
        chosen += [n] * take
        left[n] -= take
        gap -= n * take
    return chosen


def _two_for_smallest(chosen: list[int], left: np.ndarray, capacity: int) -> list[int]:
    """``chosen`` with its smallest piece replaced by the tightest pair of unpacked ones, if tighter."""
    gap = capacity - sum(chosen)
    if not gap or len(chosen) < 2:
        return chosen
    smallest = chosen[-1]
    left = left.copy()
    for n, k in Counter(chosen).items():
        left[n] -= k
    room = gap + smallest
    lengths = np.flatnonzero(left[: room + 1])
    if not len(lengths):
        return chosen
    at = np.searchsorted(lengths, room - lengths, side="right") - 1
    alone = (at >= 0) & (lengths[np.maximum(at, 0)] == lengths) & (left[lengths] < 2)
    at = np.where(alone, at - 1, at)
    total = np.where(at >= 0, lengths + lengths[np.maximum(at, 0)], 0)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    if total[best] <= smallest:
        return chosen
    return chosen[:-1] + sorted((int(lengths[best]), int(lengths[at[best]])), reverse=True)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (piece lengths, how many such bins) for ``counts`` pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        left[n] += k
    bins = []
    while left.any():
        chosen = _two_for_smallest(_greedy(left, capacity), left, capacity)
        uses = Counter(chosen)
        times = min(int(left[n]) // k for n, k in uses.items())
        for n, k in uses.items():
            left[n] -= k * times
        bins.append((chosen, times))
    return bins


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The places that ``best_two_fit`` gives to the pieces of each length, as runs of ranks."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for lengths, times in best_two_fit(counts, capacity):
        offset = 0
        for n in lengths:
            runs.setdefault(n, []).append((used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    columns = {n: np.array(r, np.int64).T for n, r in runs.items()}
    return Plan({n: c[0] for n, c in columns.items()}, {n: c[1] for n, c in columns.items()}, {n: c[2] for n, c in columns.items()}, sequence)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Encoded documents cut into pieces: id, piece, start, length, ids_crc32 and, if asked for, the ids.

    Only documents of more than ``capacity`` tokens are cut; the odd length comes first.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end = np.array([END], "<u4").tobytes()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, piece, start, length, crc, ids = [], [], [], [], [], []
        for row, raw in enumerate(encode_ids(texts_of(batch, text_column), path)):
            raw += end
            n, at, k = len(raw) // 4, 0, 0
            while at < n:
                size = min(n - at, capacity) if at or n <= capacity else n % capacity or capacity
                part = raw[4 * at : 4 * (at + size)]
                owner.append(row)
                piece.append(k)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(part)
                at, k = at + size, k + 1
        columns = [batch.column(id_column).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32())]
        columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
        names = [id_column, "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs.select(id_column, text_column), rows, schema)


def pack(parts: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id") -> DataFrame:
    """``parts`` (as ``pieces`` gives them, already stored) with sequence_id and offset."""
    total = parts.count()
    buckets = max(8, -(-total // ROWS_PER_BUCKET))
    salted = parts.withColumn("_bucket", F.pmod(F.xxhash64(id_column, "piece"), F.lit(buckets)))
    sizes = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    histogram = sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()  # one row a length
    places = plan({r["length"]: r["n"] for r in histogram}, capacity)
    within = Window.partitionBy("length", "_bucket").orderBy(id_column, "piece", "ids_crc32")
    ranked = (
        salted.withColumn("_row", F.row_number().over(within))
        .join(bases.select("length", "_bucket", "_base"), ["length", "_bucket"])
        .withColumn("_rank", F.col("_base") + F.col("_row") - 1)
        .select(*parts.columns, "_rank")
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sequence, offset = places.place(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
        kept = batch.select(parts_columns)
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*parts_columns, "sequence_id", "offset"])

    parts_columns = parts.columns
    return map_batches(ranked, rows, schema)


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack(cut(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))))


QUERIES = {"op7_best_two_fit": op7_best_two_fit}
ORACLES: dict[str, str] = {}

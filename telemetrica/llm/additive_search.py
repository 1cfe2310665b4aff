"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one full-dimensional word from each codebook. Codebooks are
fitted on a bounded sample (residual k-means, then least squares over beam-searched codes); every
vector is encoded by beam search and stored as codes with the norm of its approximation. A query is
scored against blocks of codes by looking up its products with all code words; the best
``SHORTLIST`` are ranked again on the original vectors, in double precision. Codes are dealt to blocks by
hash, so a block holds about its share of a query's best; a block's list is that share and six standard
deviations more, which bounds what is shuffled to little more than ``SHORTLIST`` rows a query.

Equal vectors are one class: a class is encoded once and answers with its smallest ids, so any number
of copies is searched exactly and at the price of one.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without
id, take no part. Vectors of different lengths aren't compared: each length is searched by itself.
Repeated rows count once, and an id with several vectors takes part with each. Ties go to the smaller id. With fewer candidates than ``k`` all are returned; an empty table or no query
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetrica.llm.common import cut, in_arrow, map_batches, table

BOOKS, CODES = 16, 256
BEAM = 4
#: Bound of the sample that codebooks are fitted on, in vectors.
SAMPLE = 16384
ROUNDS, REFINEMENTS = 6, 2
WEIGHT = 0.3
SHORTLIST = 1024
BLOCK_CODES, BLOCK_QUERIES = 1 << 18, 512
#: Vectors that a task encodes.
TASK_VECTORS = 1 << 16
K = 10


class Codebooks:
    """Codebooks of ``BOOKS`` times at most ``CODES`` words, and encoding by beam search."""

    def __init__(self, books: np.ndarray):
        self.books = np.ascontiguousarray(books, np.float32)
        flat = self.books.reshape(-1, books.shape[2])
        self.products = flat @ flat.T
        self.norms = np.einsum("ij,ij->i", flat, flat)

    def __reduce__(self):
        return Codebooks, (self.books,)  # products are made anew where they are needed

    @classmethod
    def fitted(cls, x: np.ndarray) -> Codebooks:
        """Codebooks for a sample of vectors."""
        rng = np.random.default_rng(7)
        size = min(CODES, len(x))
        x = x.astype(np.float32)
        rest, books = x.copy(), []
        for _ in range(BOOKS):
            words = rest[rng.choice(len(rest), size, replace=False)].copy()
            for _ in range(ROUNDS):
                near = (np.square(words).sum(1)[None, :] - 2 * rest @ words.T).argmin(1)
                count = np.bincount(near, minlength=size)
                total = np.zeros_like(words)
                np.add.at(total, near, rest)
                words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], rest[rng.integers(0, len(rest), size)])
            near = (np.square(words).sum(1)[None, :] - 2 * rest @ words.T).argmin(1)
            rest = rest - words[near]
            books.append(words)
        own = cls(np.stack(books))
        for _ in range(REFINEMENTS):
            codes, _ = own.encode(x)
            flat = codes.astype(np.int64) + size * np.arange(BOOKS)
            together = np.zeros((BOOKS * size, BOOKS * size), np.float32)
            for i in range(BOOKS):
                for j in range(BOOKS):
                    np.add.at(together, (flat[:, i], flat[:, j]), 1.0)
            total = np.zeros((BOOKS * size, x.shape[1]), np.float32)
            for i in range(BOOKS):
                np.add.at(total, flat[:, i], x)
            # a little weight on the words as they are keeps unused ones
            before = own.books.reshape(-1, x.shape[1])
            del own
            together.flat[:: len(together) + 1] += WEIGHT
            own = cls(np.linalg.solve(together, total + WEIGHT * before).reshape(BOOKS, size, -1))
            del together
        return own

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each vector and the squared norms of the sums they stand for."""
        parts = [self._encode(x[k : k + 1024].astype(np.float32)) for k in range(0, len(x), 1024)]
        return np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])

    def _encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, size = self.books.shape[:2]
        dots = x @ self.books.reshape(m * size, -1).T
        rows = np.arange(len(x))[:, None]
        codes = np.zeros((len(x), 1, 0), np.int64)
        error = np.zeros((len(x), 1), np.float32)  # less the squared norm of x
        for book in range(m):
            lo, hi = book * size, (book + 1) * size
            step = (self.norms[lo:hi] - 2 * dots[:, lo:hi])[:, None, :] + error[:, :, None]
            for k in range(book):
                step = step + 2 * self.products[codes[:, :, k] + k * size, lo:hi]
            flat = step.reshape(len(x), -1)
            width = min(BEAM, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            error = np.take_along_axis(flat, best, 1)
            codes = np.concatenate([codes[rows, best // size], (best % size)[:, :, None]], axis=2)
        first = error.argmin(1)
        chosen = codes[np.arange(len(x)), first]
        norms = error[np.arange(len(x)), first] + 2 * np.take_along_axis(dots, chosen + size * np.arange(m), 1).sum(1)
        return chosen.astype(np.uint8), norms

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query with every code word: (queries, books, words)."""
        return np.einsum("qd,mkd->qmk", queries.astype(np.float32), self.books, optimize=True)


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, v): the rows that take part."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long vectors as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def coded(classes: DataFrame, books: Codebooks) -> DataFrame:
    """(id, code, norm) of each class; a narrow stage."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, norms = books.encode(matrix(batch.column("v")))
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float32))], ["id", "code", "norm"])

    return map_batches(classes.select("id", "v"), rows, "id long, code binary, norm float")


def packed_codes(codes: DataFrame, blocks: int) -> DataFrame:
    """(block, ids, codes, norms): the rows of ``coded``, dealt to ``blocks`` blocks by the hash of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and now != block[a]:
                    yield packed(now, held)
                    held = []
                now = int(block[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield packed(now, held)

    def packed(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        of = pa.Table.from_batches(held)
        ids, norms = of.column("id").to_numpy(), of.column("norm").to_numpy()
        columns = [ids.astype("<i8").tobytes(), b"".join(of.column("code").to_pylist()), norms.astype("<f4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([c], pa.binary()) for c in columns]], ["block", "ids", "codes", "norms"])

    dealt = codes.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).repartition("block").sortWithinPartitions("block")
    return in_arrow(dealt, run, "block long, ids binary, codes binary, norms binary")


def block_list(shortlist: int, blocks: int) -> int:
    """How many of a query's best a block reports, so that of the best ``shortlist`` none is missed but with a chance of 1 in 10^9."""
    share = shortlist / blocks
    return min(shortlist, int(share + 6 * share**0.5 + 16))


def packed_queries(queries: DataFrame) -> DataFrame:
    """Blocks (ids, vectors) of queries, each of ``BLOCK_QUERIES`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_QUERIES):
                part = batch.slice(k, BLOCK_QUERIES)
                columns = [part.column("id").to_numpy().astype("<i8"), matrix(part.column("v")).astype("<f4")]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["qids", "vectors"])

    return in_arrow(queries, run, "qids binary, vectors binary")


def shortlists(pairs: DataFrame, books: Codebooks, size: int) -> DataFrame:
    """For each block of queries and block of codes, each query's ``size`` best: (query_id, id, approx)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qids, ids = np.frombuffer(row["qids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                queries = np.frombuffer(row["vectors"], "<f4").reshape(len(qids), -1)
                codes, norms = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["norms"], "<f4")
                for k in range(0, len(qids), 64):
                    look = books.tables(queries[k : k + 64])
                    score = np.broadcast_to(norms, (len(look), len(ids))).copy()
                    for m in range(look.shape[1]):
                        score -= 2 * look[:, m, :][:, codes[:, m]]
                    width = min(size, len(ids))
                    best = np.argpartition(score, width - 1, axis=1)[:, :width]
                    columns = [np.repeat(qids[k : k + 64], width), ids[best].ravel(), np.take_along_axis(score, best, 1).ravel().astype(np.float64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "id", "approx"])

    return in_arrow(pairs, run, "query_id long, id long, approx double")


def distances(pairs: DataFrame) -> DataFrame:
    """(query_id, class_id, score) of pairs (query_id, q, id, v): the Euclidean distance, in double precision."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = np.sqrt(np.square(matrix(batch.column("q")) - matrix(batch.column("v"))).sum(axis=1))
        return pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(score)], ["query_id", "class_id", "score"])

    return map_batches(pairs, rows, "query_id long, class_id long, score double")


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, is_query, k: int = K, shortlist: int = SHORTLIST) -> DataFrame:
    """The ``k`` nearest found for each row that ``is_query`` (a condition on id) takes, itself excepted:
    query_id, rank, vec_id, score.
    """
    rows = usable(vectors)
    lengths = [r[0] for r in rows.groupBy(F.size("v")).count().orderBy(F.desc("count")).collect()]  # a number a length
    found = [_search(rows.where(F.size("v") == d) if len(lengths) > 1 else rows, is_query, k, shortlist) for d in lengths]
    found = [f for f in found if f is not None]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], RESULT)


def _search(rows: DataFrame, is_query, k: int, shortlist: int) -> DataFrame | None:
    """``search`` among vectors (id, v) of one length; None without queries."""
    spark = rows.sparkSession
    keyed = rows.withColumn("digest", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256)).distinct()
    smallest = Window.partitionBy("digest").orderBy("id")
    members = cut(keyed.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1))
    classes = members.where("n = 1").select("id", "v", "digest")
    queries = cut(keyed.where(is_query).select("id", "v"))
    if not queries.limit(1).count():
        return None
    chosen = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(F.transform("v", lambda x: x.cast("float")).alias("v")).toArrow()
    books = Codebooks.fitted(matrix(chosen.column("v").combine_chunks()))
    del chosen
    many = classes.count()
    blocks, tasks = max(1, -(-many // BLOCK_CODES)), max(spark.sparkContext.defaultParallelism, -(-many // TASK_VECTORS))
    codes = cut(packed_codes(coded(classes.select("id", "v").repartition(tasks), books), blocks))
    # where blocks are fewer than tasks can be, each meets the queries in several parts
    parts = -(-spark.sparkContext.defaultParallelism // blocks)
    dealt = codes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    against = packed_queries(queries.repartition(tasks)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    against = against.withColumn("part", F.pmod(F.xxhash64("qids"), F.lit(parts)))
    found = shortlists(dealt.join(against, ["block", "part"]), books, block_list(shortlist, blocks))
    best = Window.partitionBy("query_id").orderBy("approx", "id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= shortlist).select("query_id", "id")
    exact = distances(found.join(classes.select("id", "v"), "id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").select("query_id", "q", "id", "v"))
    named = members.select("digest", F.col("id").alias("vec_id")).join(classes.select("digest", F.col("id").alias("class_id")), "digest")
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    # beyond k + 1 classes by distance nothing can be among the k nearest
    nearest = Window.partitionBy("query_id").orderBy("score", "class_id")
    near = exact.withColumn("n", F.rank().over(nearest)).where(F.col("n") <= k + 1).drop("n")
    answers = near.join(named, "class_id").where("vec_id <> query_id").withColumn("rank", F.row_number().over(final))
    return answers.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


QUERIES = {"op1_additive_search": op1_additive_search}
ORACLES: dict[str, str] = {}

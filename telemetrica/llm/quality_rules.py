"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Each document's statistics are transformed into a vector; every language and source gets a mean and
covariance by minimum covariance determinant, from all of its documents. Three starts (medians and
quartiles; the same with the correlations of squashed values; plain mean and covariance) take
concentration steps, each of which keeps the nearest share of the documents and takes mean and covariance
anew, until no determinant falls any more (``MAX_STEPS`` at most); of the three ends the one with the least
determinant is the group's estimate. Documents whose Mahalanobis distance is beyond the chi-square cut
are rejected. A step is one aggregation over binned distances, so no group is ever gathered: the rows
that move are a bounded number of sums per group, task and bin; the bin in which the share ends counts
by the part of it that is needed.

Groups under ``MIN_GROUP`` documents are pooled by language, then with each other; those still under it
are judged by the estimate from all documents that pass the base. Variances have a floor, so that features which are almost always zero don't
reject a document for one symbol.

Defined results: a null text has no words and fails the base; null languages or sources are groups of
their own; repeated rows count as often as they occur and get equal verdicts; an empty table gives an
empty result; columns other than those named are ignored by ``assess`` and kept by ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetrica.llm.common import cut, map_batches, table, texts_of, words_of

SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Square roots of shares: of symbols, capitalised words, exclamations, words of punctuation alone,
#: words equal to the one before, words in repeated windows and repeated lines.
FEATURES = ("symbols", "capitals", "marks", "bare", "echoes", "repeats", "lines")
#: Least standard deviation of each feature, on its transformed scale.
FLOOR = (0.06, 0.08, 0.06, 0.06, 0.10, 0.15, 0.25)
D = len(FEATURES)
SHARE = 0.7
MAX_STEPS = 12
#: Steps end when no group's determinant changes by more than this share.
SETTLED = 1e-3
MIN_GROUP = 200
#: Probability that a regular document lies within the cut.
WITHIN = 1 - 1e-6
BINS_PER_DOUBLING = 8
BROADCAST_GROUPS = 10_000
REST, ALL = "\x00rest", "\x00all"


def n_repeat_words(words: list[str]) -> int:
    """Words in five-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 6:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, range(n)), np.int64, n)
    code = ids
    for k in range(1, 5):
        if int(code.max()) * n + n >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code[:-1] * n + ids[k:]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(5):
        inside[k : k + len(code)] |= twice
    return int(inside.sum())


def statistics(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then the feature vector."""
    words = words_of(text)
    n, joined = len(words), "".join(words)
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    doubled = len(lines) - len(set(lines))
    repeats = n_repeat_words(words)
    chars = max(len(joined), 1)
    capitals = sum(map(str.isupper, words))
    bare = [w.strip(PUNCTUATION) for w in words].count("")
    echoes = sum(map(eq, words, words[1:]))
    marks = (joined.count("!") + joined.count("?")) / chars
    shares = (symbols / chars, capitals / max(n, 1), marks, bare / max(n, 1), echoes / max(n, 1), repeats / max(n, 1), doubled / max(len(lines), 1))
    return n, len(joined), symbols, doubled, repeats, *map(math.sqrt, shares)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row: id, lang, source, the five counts, base_failed and the features ``x``."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, x array<double>"

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics(t) for t in texts_of(batch)]
        counts = [pa.array([f[k] for f in found], pa.int64()) for k in range(5)]
        failed = pa.array([f[0] < 10 or 100 * f[4] > 20 * f[0] for f in found], pa.bool_())
        vectors = pa.array([f[5:] for f in found], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(id_column), batch.column("lang"), batch.column("source"), *counts, failed, vectors], [id_column, "lang", "source", *COUNTS, "base_failed", "x"])

    return map_batches(docs.select(id_column, F.col("lang").cast("string"), F.col("source").cast("string"), "text"), rows, schema)


def gamma_share(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square_quantile(p: float, d: int) -> float:
    low, high = 1e-9, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_share(d / 2, mid / 2) < p else (low, mid)
    return high


#: Makes the covariance of the nearest share consistent for normal data.
CONSISTENT = SHARE / gamma_share(D / 2 + 1, chi_square_quantile(SHARE, D) / 2)
CUT = chi_square_quantile(WITHIN, D)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


FIT = "g string, start int, m array<double>, p array<double>, d double"


def fit_of(mean: np.ndarray, cov: np.ndarray) -> tuple[list[float], list[float], float]:
    """Mean, inverse covariance as a list and logarithm of the determinant, with the least deviations added."""
    cov = cov + np.diag(np.square(FLOOR))
    inverse = np.linalg.inv(cov)
    return mean.tolist(), [float(inverse[i, j]) for i, j in PAIRS], float(np.linalg.slogdet(cov)[1])


def spread_of(n: float, sums: list[float], products: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from count, sums and sums of products."""
    mean, cov = np.array(sums) / n, np.zeros((D, D))
    for (i, j), v in zip(PAIRS, products, strict=True):
        cov[i, j] = cov[j, i] = v / n - mean[i] * mean[j]
    return mean, cov


def sums_of(x: Callable[[int], Column], weight: Column | None = None) -> list[Column]:
    """Aggregates s (sums) and q (sums of products) of the components that ``x`` names."""
    w = (lambda c: c) if weight is None else (lambda c: c * weight)
    return [F.array(*[F.sum(w(x(i))) for i in range(D)]).alias("s"), F.array(*[F.sum(w(x(i) * x(j))) for i, j in PAIRS]).alias("q")]


def precision(moments: DataFrame) -> DataFrame:
    """(g, start, n, s, q): count, sums and sums of products, as ``FIT``."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        fits = []
        for n, s, q in zip(*[batch.column(c).to_pylist() for c in "nsq"], strict=True):
            mean, cov = spread_of(n, s, q)
            fits.append(fit_of(mean, CONSISTENT * cov))
        return as_fits(batch.column("g"), batch.column("start"), fits)

    return map_batches(moments, rows, FIT)


def as_fits(groups: pa.Array, starts: pa.Array, fits: list[tuple]) -> pa.RecordBatch:
    columns = [groups, starts.cast(pa.int32()), *[pa.array([f[k] for f in fits], pa.list_(pa.float64())) for k in (0, 1)], pa.array([f[2] for f in fits], pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["g", "start", "m", "p", "d"])


def distance() -> Column:
    """The squared Mahalanobis distance of ``x`` from mean ``m`` by inverse covariance ``p``."""
    off = [F.col("x")[i] - F.col("m")[i] for i in range(D)]
    return sum(((1 if i == j else 2) * F.col("p")[k] * off[i] * off[j] for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


def beginnings(rows: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The starts of each group of ``rows`` (g, x), as ``FIT``."""
    quartiles = rows.groupBy("g").agg(*[F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 1000).alias(f"_{i}") for i in range(D)])
    spread = [F.greatest((F.col(f"_{i}")[2] - F.col(f"_{i}")[0]) / 1.349, F.lit(FLOOR[i])) for i in range(D)]
    middle = cut(quartiles.select("g", F.array(*[F.col(f"_{i}")[1] for i in range(D)]).alias("mid"), F.array(*spread).alias("spread")))
    squashed = F.array(*[F.tanh((F.col("x")[i] - F.col("mid")[i]) / F.col("spread")[i]) for i in range(D)])
    with_both = rows.join(small(middle), "g").select("g", "mid", "spread", "x", squashed.alias("z"))
    of_x, of_z = sums_of(lambda i: F.col("x")[i]), sums_of(lambda i: F.col("z")[i])
    moments = with_both.groupBy("g").agg(F.count("*").alias("n"), *of_x, of_z[0].alias("zs"), of_z[1].alias("zq"), F.first("mid").alias("mid"), F.first("spread").alias("spread"))

    def starts(batch: pa.RecordBatch) -> pa.RecordBatch:
        fits = []
        for n, s, q, zs, zq, mid, spread in zip(*[batch.column(c).to_pylist() for c in ("n", "s", "q", "zs", "zq", "mid", "spread")], strict=True):
            wide = np.square(spread) - np.square(FLOOR)
            _, cov = spread_of(n, zs, zq)
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            turned = cov / scale[:, None] / scale[None, :] * np.sqrt(wide)[:, None] * np.sqrt(wide)[None, :]
            np.fill_diagonal(turned, wide)
            fits += [fit_of(np.array(mid), np.diag(wide)), fit_of(np.array(mid), turned), fit_of(*spread_of(n, s, q))]
        k = batch.num_rows
        return as_fits(batch.column("g").take(pa.array(np.repeat(np.arange(k), 3))), pa.array(np.tile([0, 1, 2], k)), fits)

    return map_batches(moments.select("g", "n", "s", "q", "zs", "zq", "mid", "spread"), starts, FIT)


def concentrated(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """One step from each fit (g, start, m, p): mean and covariance of the nearest ``SHARE`` of the group, as ``FIT``."""
    binned = rows.join(fit.drop("d"), "g").withColumn("b", F.floor(BINS_PER_DOUBLING * F.log2(distance() + F.lit(1e-3))))
    by_bin = binned.groupBy("g", "start", "b").agg(F.count("*").alias("n"), *sums_of(lambda i: F.col("x")[i]))
    whole = Window.partitionBy("g", "start")
    before = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    near = by_bin.withColumn("_all", F.sum("n").over(whole)).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    part = F.least(F.lit(1.0), (SHARE * F.col("_all") - F.col("_before")) / F.col("n"))
    near = near.withColumn("_part", part).where("_part > 0")
    sums = F.array(*[F.sum(F.col("s")[i] * F.col("_part")) for i in range(D)]).alias("s")
    products = F.array(*[F.sum(F.col("q")[k] * F.col("_part")) for k in range(len(PAIRS))]).alias("q")
    return precision(near.groupBy("g", "start").agg(F.sum(F.col("n") * F.col("_part")).alias("n"), sums, products).select("g", "start", "n", "s", "q"))


def estimates(rows: DataFrame, few: bool) -> DataFrame:
    """Mean and inverse covariance (g, m, p), with the logarithm d of the determinant, per group of ``rows`` (g, x); ``few``: their number is bounded."""
    small = F.broadcast if few else (lambda df: df)
    fit = cut(beginnings(rows, small))
    for step in range(MAX_STEPS):
        new = cut(concentrated(rows, small(fit)))
        moved = new.join(fit.select("g", "start", F.col("d").alias("_d")), ["g", "start"]).agg(F.max(F.abs(F.col("d") - F.col("_d")))).first()[0]
        fit = new
        if step and (moved is None or moved < SETTLED):
            break
    return fit.groupBy("g").agg(F.min_by(F.struct("m", "p", "d"), F.struct("d", "start")).alias("f")).select("g", "f.*")


def grouped(stats: DataFrame) -> tuple[DataFrame, bool]:
    """``stats`` with ``g``, the group to judge by (null where the whole group fails the base), and whether the groups are few."""
    key = F.concat_ws("\x01", F.coalesce("lang", F.lit("\x00")), F.coalesce("source", F.lit("\x00")))
    pool = F.concat_ws("\x01", F.coalesce("lang", F.lit("\x00")), F.lit(REST))
    sizes = stats.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("g", F.when(F.col("n") >= MIN_GROUP, key).otherwise(pool))
    sizes = sizes.withColumn("n", F.sum("n").over(Window.partitionBy("g")))
    sizes = sizes.withColumn("g", F.when(F.col("n") >= MIN_GROUP, F.col("g")).otherwise(F.lit(REST)))
    # the last pool has at most MIN_GROUP rows a language
    rest = sizes.where(F.col("g") == REST).agg(F.sum("n")).collect()[0][0] or 0
    if rest < MIN_GROUP:
        sizes = sizes.withColumn("g", F.when(F.col("g") == REST, F.lit(ALL)).otherwise(F.col("g")))
    sizes = cut(sizes.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "g"))
    few = sizes.count() <= BROADCAST_GROUPS
    same = F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))
    return stats.join(F.broadcast(sizes) if few else sizes, same, "left").drop("_l", "_s"), few


def assess(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row: id, the five counts, base_failed, kept, and distance (squared; null where not judged)."""
    stats, few = grouped(cut(measure(docs, id_column)))
    passed = stats.where(~F.col("base_failed"))
    rows = passed.select("g", "x")
    if passed.where(F.col("g") == ALL).limit(1).count():
        rows = rows.where(F.col("g") != ALL).unionByName(passed.select(F.lit(ALL).alias("g"), "x"))
    fit = estimates(rows, few).drop("d")
    judged = stats.join(F.broadcast(fit) if few else fit, "g", "left").withColumn("distance", distance())
    verdict = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= CUT))
    return judged.select(id_column, *COUNTS, "base_failed", verdict.alias("kept"), "distance")


def keep(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose documents ``assess`` keeps; ids are taken as unique."""
    kept = assess(docs, id_column).where("kept").select(F.col(id_column).alias("_kept")).distinct()
    return docs.join(kept, docs[id_column].eqNullSafe(kept["_kept"]), "left_semi").select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES: dict[str, str] = {}

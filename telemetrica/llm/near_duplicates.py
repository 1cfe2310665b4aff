"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Each distinct shingle set gets a signature of ``VALUES`` values, dealt to ``TREES`` trees without overlap;
every tree sorts the signatures by its own values. Sets that share ``SHALLOW`` leading values in a tree
form a region of it. The depth of a region is adapted to what it holds: neighbours in its order, which
have the longest common prefix, are confirmed first (each set's strongest ones) and joined into
components; only regions that this leaves divided are searched at the shallow depth, and there every
pair of sets in two components is looked at, in the first tree where it shares a region. Pairs whose
signatures don't rule out the similarity are confirmed on the full sets inside the region, and only links
that join components come out of it, so the rows made are never more than a region's sets.

A divided region is dealt into blocks: the members of all but its largest component meet all members,
``BLOCK`` rows against ``BLOCK`` rows a group, so a task holds a bounded number of sets of bounded size,
however crowded the region. Copies (equal sets) are one class from the start, so their number costs
nothing; components are found by star contraction in DataFrames; nothing but counts reaches the driver.

Defined results: null or wordless texts have 0 shingles and are alone; fewer words than a shingle make
one shingle of all of them; rows that share an id are one document that has all their sets; a null id
is alone and kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetrica.llm.common import cut, in_arrow, map_batches, resident, table, texts_of

WORDS = 5
#: At least this many hundredths of the union are shared.
SIMILAR = 80
#: MinHash values of a set: each is used by one tree, and all estimate the similarity.
TREES, SHALLOW, DEEP = 32, 4, 8
VALUES = TREES * DEEP
STRONGEST = 6
#: Pairs with a smaller share of equal values aren't confirmed: 5.5 standard deviations below.
HOPELESS = 0.8 - 5.5 * (0.8 * 0.2 / VALUES) ** 0.5
PART_BYTES = 1 << 19
#: Rows of one side of a block of a divided region, and shingles that its searching side holds.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Shared shingles that are counted at a time.
COUNTED = 1 << 20

_random = np.random.default_rng(20240601)
MULTIPLIERS = _random.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _random.integers(0, 1 << 63, VALUES, np.uint64)
ORDERS = _random.permutation(VALUES).reshape(TREES, DEEP)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True


def _powers_of(n: int) -> list[np.ndarray]:
    out = []
    for b in (BASE, INVERSE):
        factors = np.full(n, b, np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors, dtype=np.uint64))
    return out


def powers(n: int) -> list[np.ndarray]:
    """Powers of the polynomial's base and of its inverse, ``n`` at least; those that most parts need are kept."""
    most = 2 * PART_BYTES
    return resident(("powers", most), lambda: _powers_of(most)) if n <= most else _powers_of(n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _part_shingles(raws: list[bytes], words: int) -> list[np.ndarray]:
    data = LOWER[np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", np.uint8)]
    gap = GAP[data]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    forward, back = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], dtype=np.uint64)])
    word = mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    code = word
    if len(word) >= words:
        m = len(word) - words + 1
        code = word[:m].copy()
        for k in range(1, words):
            code = code * BASE + word[k : k + m]
        code = mixed(code)
    first = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])]) + 1
    at = np.searchsorted(starts, first)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(code[a : b - words + 1]))
        elif b > a:
            one = np.uint64(b - a)
            for h in word[a:b]:
                one = mixed(np.array([one], np.uint64) * BASE + h)[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str], words: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, as sorted 64-bit hashes; a part of the texts is in memory at a time."""
    part, size = [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        if part and size + len(raw) > PART_BYTES:
            with np.errstate(over="ignore"):
                found = _part_shingles(part, words)
            yield from found
            part, size = [], 0
        part.append(raw)
        size += len(raw)
    if part:
        with np.errstate(over="ignore"):
            found = _part_shingles(part, words)
        yield from found


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted 64-bit hashes."""
    return list(shingle_sets(texts, words))


def min_hashes(found: np.ndarray) -> bytes:
    """The signature of a non-empty shingle set, 16 bits a value."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 128):
        least = np.minimum(least, (MULTIPLIERS[:, None] * found[None, k : k + 128] + ADDENDS[:, None]).min(axis=1))
    return (mixed(least) >> np.uint64(48)).astype("<u2").tobytes()


def sketch(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, n_shingles, and (null for empty sets) digest and signature of the set."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, signatures = [], [], []
        for s in shingle_sets(texts_of(batch), words):
            counts.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            with np.errstate(over="ignore"):
                signatures.append(min_hashes(s) if len(s) else None)
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "signature"])

    return map_batches(docs.select("doc_id", "text"), rows, "doc_id long, n_shingles long, digest binary, signature binary")


def forest(nodes: DataFrame) -> DataFrame:
    """Rows (tree, near, far, node): the leading values of each node's signature in each tree."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(-1, VALUES)
        n = len(values)
        packed = values[:, ORDERS].astype(">u2").reshape(n * TREES, DEEP)
        near, far = packed[:, :SHALLOW].copy().view(">i8").ravel(), packed[:, SHALLOW:].copy().view(">i8").ravel()
        trees = np.tile(np.arange(TREES, dtype=np.int32), n)
        node = np.repeat(batch.column("node").to_numpy(), TREES)
        return pa.RecordBatch.from_arrays([pa.array(trees), pa.array(near.astype(np.int64)), pa.array(far.astype(np.int64)), pa.array(node)], ["tree", "near", "far", "node"])

    return map_batches(nodes.select("node", "signature"), rows, "tree int, near long, far long, node long")


def in_order(rows: DataFrame) -> DataFrame:
    """Each tree's rows in its order, in ranges of about equal size: a crowded region is dealt over as many as it fills."""
    return rows.repartitionByRange("tree", "near", "far", "node").sortWithinPartitions("tree", "near", "far", "node")


def neighbours(rows: DataFrame) -> DataFrame:
    """The rows of regions of two nodes or more, with the node before in its region and their common prefix.

    The first and last row of a range are kept, too: their region may go on in another range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.zeros((4, 0), np.int64)  # the last row, whose successor isn't known, and the one before
        for batch in batches:
            new = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)])
            yield from emit(np.concatenate([left, new], axis=1), left.shape[1], False)
            left = np.concatenate([left, new], axis=1)[:, -2:]
        if left.shape[1]:
            yield from emit(left, left.shape[1], True)

    def emit(rows: np.ndarray, known: int, last: bool) -> Iterator[pa.RecordBatch]:
        n = rows.shape[1]
        same = np.zeros(n + 1, bool)
        same[1:n] = (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1])
        with_next = same[:n] | same[1:]
        # rows up to the last but one before, and the last one only when nothing follows
        chosen = with_next.copy()
        if known == 0:
            chosen[0] = True
        chosen[: max(known - 1, 0)] = False
        chosen[n - 1] = last
        at = np.flatnonzero(chosen)
        if not len(at):
            return
        before = np.where(same[at], rows[3, np.maximum(at - 1, 0)], -1)
        differ = (rows[2, at] ^ rows[2, np.maximum(at - 1, 0)]).view(np.uint64)
        common = SHALLOW + sum((differ >> np.uint64(64 - 16 * k)) == 0 for k in range(1, DEEP - SHALLOW)) + (differ == 0)
        columns = [pa.array(rows[0, at].astype(np.int32)), *[pa.array(rows[k, at]) for k in (1, 3)]]
        columns += [pa.array(before, mask=~same[at]), pa.array(common.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["tree", "near", "node", "before", "common"])

    return in_arrow(in_order(rows), run, "tree int, near long, node long, before long, common int")


def divided_blocks(rows: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (tree, near, node) of regions with several labels, dealt into blocks: tree, near, i, j, probed, node, label, other.

    All but the members of a region's largest component (``other``) search, in blocks ``i``; all members
    are searched, in blocks ``j``. A region of at most ``BLOCK`` rows is one block.
    """
    named = classes.select("node", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    marked = rows.select("tree", "near", "node").join(named, "node")
    by_label = marked.groupBy("tree", "near", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    regions = by_label.groupBy("tree", "near").agg(
        F.max(F.struct("n", "label", "size")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("labels")
    )
    regions = regions.where("labels > 1").select(
        "tree",
        "near",
        F.col("most.label").alias("main"),
        F.ceil(F.greatest((F.col("n") - F.col("most.n")) / BLOCK, (F.col("size") - F.col("most.size")) / BLOCK_SHINGLES)).cast("int").alias("ni"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("nj"),
    )
    met = marked.join(regions, ["tree", "near"]).withColumn("other", F.col("label") != F.col("main"))
    i, j = F.pmod(F.xxhash64("node"), F.col("ni")).cast("int"), F.pmod(F.xxhash64("node", "label"), F.col("nj")).cast("int")
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    searching = F.when(F.col("other"), F.transform(up_to(F.col("nj")), lambda k: F.struct(i.alias("i"), k.alias("j"), F.lit(False).alias("probed"))))
    searched = F.transform(up_to(F.col("ni")), lambda k: F.struct(k.alias("i"), j.alias("j"), F.lit(True).alias("probed")))
    places = F.concat(F.coalesce(searching, F.array().cast("array<struct<i:int,j:int,probed:boolean>>")), searched)
    return met.select("tree", "near", "node", "label", "other", F.explode(places).alias("at")).select("tree", "near", "at.*", "node", "label", "other")


KEY = ("tree", "near", "i", "j")


def by_block(rows: DataFrame, kind: Callable[[], Plausible | Linked], schema: str) -> DataFrame:
    """Each block's rows handed to an object of its own: those that search come first and are held, those searched pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, kind()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in KEY])
            probed = batch.column("probed").to_numpy(zero_copy_only=False)
            node, label, other = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("node", "label", "other"))
            columns = (node, label, other, *group.load(batch))
            starts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0) | (probed[1:] != probed[:-1])) + 1
            for a, b in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                key = tuple(keys[:, a].tolist())
                if key != now:
                    yield from group.end()
                    now, group = key, kind()
                part = [c[a:b] for c in columns]
                if not probed[a]:
                    group.held.append(part)
                elif group.held:
                    yield from group.meet(key, part)
        yield from group.end()

    dealt = rows.repartition(*KEY).sortWithinPartitions(*KEY, "probed", "node")
    return in_arrow(dealt, run, schema)


class Plausible:
    """Which rows of a block have a partner whose signature doesn't rule the similarity out."""

    def __init__(self):
        self.held: list[list] = []
        self.hit: np.ndarray | None = None

    @staticmethod
    def load(batch: pa.RecordBatch) -> tuple:
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(-1, VALUES)
        return values, np.ascontiguousarray(values[:, ORDERS[:, :SHALLOW]]).view(np.int64)[..., 0]

    def meet(self, key: tuple, rows: list) -> Iterator[pa.RecordBatch]:
        if self.hit is None:
            self.held = [np.concatenate(c) for c in zip(*self.held, strict=True)] if len(self.held) > 1 else self.held[0]
            self.key, self.hit = key, np.zeros(len(self.held[0]), bool)
        nodes, labels, _, values, keys = self.held
        there, theirs, other, their_values, their_keys = rows
        tree = key[0]
        met = np.zeros(len(there), bool)
        for k in range(len(nodes)):
            # two that search each other meet once, and a pair in the first tree where it shares a region
            at = np.flatnonzero((theirs != labels[k]) & (~other | (there > nodes[k])))
            if tree:
                at = at[~(their_keys[at, :tree] == keys[k, :tree]).any(axis=1)]
            at = at[np.count_nonzero(their_values[at] == values[k], axis=1) >= HOPELESS * VALUES]
            met[at] = True
            self.hit[k] |= len(at) > 0
        if met.any():
            yield self.batch(there[met], theirs[met], other[met], True)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.hit is not None and self.hit.any():
            yield self.batch(*[c[self.hit] for c in self.held[:3]], False)

    def batch(self, nodes: np.ndarray, labels: np.ndarray, other: np.ndarray, probed: bool) -> pa.RecordBatch:
        n = len(nodes)
        columns = [pa.array(np.full(n, k), t) for k, t in zip(self.key, (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
        columns += [pa.array(np.full(n, probed)), pa.array(nodes), pa.array(labels), pa.array(other)]
        return pa.RecordBatch.from_arrays(columns, [*KEY, "probed", "node", "label", "other"])


PLACE = "tree int, near long, i int, j int, probed boolean, node long, label long, other boolean"


class Linked:
    """Links of a block that join labels: similar enough on the full sets, and not joined by earlier ones."""

    def __init__(self, similar: int):
        self.similar = similar
        self.held: list[list] = []
        self.index: tuple | None = None
        self.joined: dict[int, int] = {}

    @staticmethod
    def load(batch: pa.RecordBatch) -> tuple:
        return ([np.frombuffer(s, "<u8") for s in batch.column("shingles").to_pylist()],)

    def root(self, label: int) -> int:
        while (up := self.joined.get(label, label)) != label:
            label = up
        return label

    def indexed(self) -> tuple:
        """The held sets, and of each shingle in them whose it is."""
        sets = [s for h in self.held for s in h[3]]
        flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        distinct, first = np.unique(flat[order], return_index=True)
        nodes, labels = (np.concatenate([h[k] for h in self.held]) for k in (0, 1))
        return nodes, labels, sizes, distinct, np.append(first, len(flat)), np.repeat(np.arange(len(sets)), sizes)[order]

    def meet(self, key: tuple, rows: list) -> Iterator[pa.RecordBatch]:
        if self.index is None:
            self.index = self.indexed()
        nodes, labels, sizes, distinct, first, owner = self.index
        found = []
        for node, label, other, one in zip(*rows, strict=True):
            at = np.searchsorted(distinct, one)
            at = at[distinct[np.minimum(at, len(distinct) - 1)] == one]
            counts = first[at + 1] - first[at]
            ends = np.cumsum(counts)
            cuts = [0, *np.searchsorted(ends, np.arange(COUNTED, ends[-1], COUNTED)), len(at)] if len(at) else [0, 0]
            shared = np.zeros(len(nodes), np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                n = counts[a:b]
                begin = np.repeat(first[at[a:b]] - (np.cumsum(n) - n), n)
                shared += np.bincount(owner[begin + np.arange(len(begin))], minlength=len(nodes))
            close = (shared > 0) & (100 * shared >= self.similar * (sizes + len(one) - shared)) & (labels != label)
            for k in np.flatnonzero(close & ((nodes < node) if other else True)).tolist():
                x, y = self.root(int(labels[k])), self.root(int(label))
                if x != y:
                    self.joined[max(x, y)] = min(x, y)
                    found.append((int(nodes[k]), int(node)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def joining_links(blocks: DataFrame, classes: DataFrame, texts: DataFrame, words: int, similar: int) -> DataFrame:
    """Links (a, b) that join labels inside the blocks of divided regions; at most one less than a block has rows."""

    signed = blocks.join(classes.select("node", "signature"), "node").select(*KEY, "probed", "node", "label", "other", "signature")
    plausible = cut(by_block(signed, Plausible, PLACE))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in shingle_sets(texts_of(batch), words)], pa.binary())], ["node", "shingles"])

    named = plausible.select("node").distinct().join(texts.select(F.col("doc_id").alias("node"), "text"), "node")
    sets = cut(map_batches(named.select("node", "text"), rows, "node long, shingles binary"))
    full = plausible.join(sets, "node").select(*KEY, "probed", "node", "label", "other", "shingles")
    return by_block(full, lambda: Linked(similar), "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """The pairs of ids whose full shingle sets are similar enough."""
    one = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    two = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = shingles([*texts_of(batch, "ta"), *texts_of(batch, "tb")], words)
        n = batch.num_rows
        shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sides[:n], sides[n:], strict=True)]
        links = [100 * s >= similar * (len(x) + len(y) - s) and s > 0 for s, x, y in zip(shared, sides[:n], sides[n:], strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    return map_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb"), rows, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """Per node of ``links`` (a, b): node and label, the smallest node of its component.

    Stars are contracted until nothing changes: each node's larger neighbours, then its smaller ones,
    are tied to the smallest node it knows. Every round is written to the shared folder.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def cluster(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept, for shingles of ``words`` words."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketched = cut(sketch(docs, words))
    classes = cut(
        sketched.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("signature").alias("signature"), F.min("n_shingles").alias("size"))
    )
    rows = cut(neighbours(forest(classes)))
    texts = docs.where("doc_id is not null")

    # the strongest pairs next to each other in some tree
    met = rows.where("before is not null and before <> node").select(F.least("node", "before").alias("a"), F.greatest("node", "before").alias("b"), "common")
    weighed = cut(met.groupBy("a", "b").agg(F.sum("common").alias("w")))
    ends = weighed.select(F.col("a").alias("n"), "*").unionByName(weighed.select(F.col("b").alias("n"), "*"))
    place = Window.partitionBy("n").orderBy(F.desc("w"), F.xxhash64("a", "b"))
    first = cut(ends.withColumn("k", F.row_number().over(place)).where(F.col("k") <= STRONGEST).select("a", "b").distinct())
    # ids that have several sets tie those sets together
    same_id = sketched.where("digest is not null and doc_id is not null").select("digest", "doc_id").distinct()
    same_id = same_id.join(classes.select("digest", "node"), "digest").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    linked = cut(confirmed(first, texts, words, similar))
    labels = cut(components(linked))

    # every pair of a region that is still divided
    more = cut(joining_links(divided_blocks(rows, classes, labels), classes, texts, words, similar))
    ids = same_id.join(sketched.groupBy(F.col("doc_id").alias("b")).agg(F.countDistinct("digest").alias("k")).where("k > 1"), "b").select("a", "b")
    # links found late tie whole components, so only their labels are contracted again
    late = more.unionByName(ids)
    for end in ("a", "b"):
        known = labels.select(F.col("node").alias(end), F.col("label").alias("_label"))
        late = late.join(known, end, "left").withColumn(end, F.coalesce("_label", end)).drop("_label")
    tied = components(late).select(F.col("node").alias("_tied"), F.col("label").alias("_final"))

    named = classes.select("digest", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.join(tied, F.col("label") == F.col("_tied"), "left").select("digest", F.coalesce("_final", "label").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """One row's document of each group: the rows whose id is their component's smallest."""
    kept = cluster(docs, words, similar).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi").select(*docs.columns)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"), words=4)


QUERIES = {"op3_near_duplicates": op3_near_duplicates}
ORACLES: dict[str, str] = {}

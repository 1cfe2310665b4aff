"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a hashed word vector, the mean of hashed vectors of its character trigrams and
four-grams, and the smoothed log-odds of the word and of its strongest gram between toxic and other
training documents (counted in training without the document's own fifth of the sample). Two gated recurrent layers read each window in both directions, attention pools their
states, and a document's score is calibrated from the logits of all its overlapping windows.

The network is fitted on the driver on a bounded sample of labelled documents: at most ``SAMPLE_DOCS`` of
each class, in the order of a hash of their ids, as long as they have ``SAMPLE_WINDOWS`` windows together
(one that doesn't fit is passed over). A sampled document enters with all its windows.
Scoring reads every window of every text; memory is bounded by ``WINDOW_BATCH`` windows.

Defined results: null, empty and wordless texts have no windows and get the lowest calibrated score;
labels that are null or other than 0 and 1 are passed over; with labels of fewer than two classes every
score is that class's (0 without labels); repeated rows are scored one by one; the id, and columns other
than the text, are never read by the score.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetrica.llm.common import cut, in_arrow, map_batches, resident, table, texts_of

SAMPLE_DOCS, SAMPLE_WINDOWS = 1500, 60_000
WINDOW, STRIDE = 32, 16
WORD_ROWS, GRAM_ROWS, ODDS_ROWS, GRAM_ODDS = 2048, 2048, 1 << 18, 1 << 16
WIDTH, HIDDEN, ATTEND = 6, 8, 8
INPUT = 2 * WIDTH + 2
PARTS = 5
#: Share of words that enter training without their vectors, so that odds and context must do.
BLANK = 0.5
EPOCHS, BATCH, RATE = 10, 128, 0.01
WINDOW_BATCH = 2048
KNOWN_WORDS = 150_000
TOKEN = re.compile(r"\w+")
THRESHOLD = 0.3


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def word_row(word: str) -> tuple[int, int, list[int]]:
    """Rows of a word in the odds and word tables, and of all its grams in theirs."""
    raw = b"^" + word.encode("utf-8", "replace") + b"$"
    code = zlib.crc32(raw)
    return code % ODDS_ROWS, (code >> 8) % WORD_ROWS, [zlib.crc32(raw[i : i + k]) % GRAM_ODDS for i in range(len(raw) - 2) for k in (3, 4)]


class Grams:
    """Rows of the grams of words, as many as each has: word k's are flat[first[k]:first[k + 1]]."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray):
        self.flat, self.first = np.asarray(flat, np.int32), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def take(self, words: np.ndarray) -> Grams:
        counts = np.diff(self.first)[words]
        begin = np.repeat(self.first[:-1][words] - (np.cumsum(counts) - counts), counts)
        return Grams(self.flat[begin + np.arange(len(begin))], counts)

    def of(self) -> np.ndarray:
        """The word that each gram belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def mean(self, table: np.ndarray) -> np.ndarray:
        """Per word the mean of its grams' vectors, zeros without grams."""
        of, n = self.of(), len(self.first) - 1
        rows = self.flat % GRAM_ROWS
        total = np.stack([np.bincount(of, table[rows, k], n) for k in range(table.shape[1])], 1)
        return total / np.maximum(np.diff(self.first), 1)[:, None]


def ragged(grams: np.ndarray | tuple[Grams, np.ndarray]) -> tuple[Grams, np.ndarray]:
    """Grams of distinct words and the place of each word of a batch; from rows padded with -1, too."""
    if isinstance(grams, tuple):
        return grams
    there = grams >= 0
    return Grams(grams[there], there.sum(-1).ravel()), np.arange(there[..., 0].size).reshape(grams.shape[:-1])


def starts(n: int) -> list[int]:
    """First words of the windows that cover ``n`` words."""
    return [0] if 0 < n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW] if n else []


class Network:
    """Parameters and passes of the network, for windows of word inputs."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        self.p = {"words": n(WORD_ROWS, WIDTH), "grams": n(GRAM_ROWS, WIDTH)}
        for d in "fb":
            self.p |= {f"W{d}": n(INPUT, 3 * HIDDEN) * 3, f"U{d}": n(HIDDEN, 3 * HIDDEN) * 3, f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": n(2 * HIDDEN, ATTEND) * 3, "a": np.zeros(ATTEND, np.float32), "v": n(ATTEND) * 3, "o": n(2 * HIDDEN) * 3, "q": np.zeros(1, np.float32)}

    def inputs(self, word: np.ndarray, grams: np.ndarray | tuple[Grams, np.ndarray], odds: np.ndarray, seen: np.ndarray | float = 1.0) -> np.ndarray:
        """Input vectors; grams: as ``ragged`` takes them; seen: 0 where a word's vectors are left out."""
        own, at = ragged(grams)
        mean = own.mean(self.p["grams"])[at]
        return np.concatenate([self.p["words"][word] * seen, mean * seen, odds], -1).astype(np.float32)

    def recur(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (windows, words, HIDDEN) in direction ``d``, from input gates (windows, words, 3 HIDDEN)."""
        b, t, _ = gates.shape
        h = np.zeros((b, HIDDEN), np.float32)
        out = np.zeros((b, t, HIDDEN), np.float32)
        U = self.p[f"U{d}"]
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            g, r = gates[:, k], h @ U
            zr = sigmoid(g[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
            z, s = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + s * r[:, 2 * HIDDEN :])
            m = mask[:, k, None]
            new = h + m * (1 - z) * (n - h)
            if keep is not None:
                keep.append((k, h, z, s, n, r[:, 2 * HIDDEN :], m))
            out[:, k] = h = new
        return out

    def attend(self, states: np.ndarray, mask: np.ndarray) -> tuple:
        u = np.tanh(states @ self.p["A"] + self.p["a"])
        e = np.where(mask > 0, u @ self.p["v"], -1e9)
        w = np.exp(e - e.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        pooled = (w[..., None] * states).sum(1)
        return u, w, pooled, pooled @ self.p["o"] + self.p["q"][0]

    def logits(self, gates: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self.recur(gates[d], mask, d) for d in "fb"], -1)
        return self.attend(states, mask)[3]

    def gradients(self, word, grams, odds, mask, target, weight, seen=1.0) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted cross-entropy of a batch and its gradients."""
        x = self.inputs(word, grams, odds, seen)
        keeps: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.recur(x @ self.p[f"W{d}"] + self.p[f"c{d}"], mask, d, keeps[d]) for d in "fb"], -1)
        u, w, pooled, logit = self.attend(states, mask)
        prob = sigmoid(logit)
        loss = -float(np.sum(weight * (target * np.log(prob + 1e-7) + (1 - target) * np.log(1 - prob + 1e-7))))
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dl = weight * (prob - target)
        g["o"], g["q"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dp = dl[:, None] * self.p["o"]
        ds = w[..., None] * dp[:, None]
        dw = (states * dp[:, None]).sum(-1)
        de = w * (dw - (w * dw).sum(1, keepdims=True))
        g["v"] = (u * de[..., None]).sum((0, 1))
        du = de[..., None] * self.p["v"] * (1 - u * u)
        g["A"], g["a"] = np.einsum("bth,bta->ha", states, du), du.sum((0, 1))
        ds = ds + du @ self.p["A"].T
        dx = np.zeros_like(x)
        for i, d in enumerate("fb"):
            part = ds[..., i * HIDDEN : (i + 1) * HIDDEN]
            dh = np.zeros((len(x), HIDDEN), np.float32)
            dg = np.zeros((*x.shape[:2], 3 * HIDDEN), np.float32)
            for k, h, z, s, n, rn, m in reversed(keeps[d]):
                dh = dh + part[:, k]
                dn = dh * m * (1 - z) * (1 - n * n)
                dz = dh * m * (h - n) * z * (1 - z)
                dr = dn * rn * s * (1 - s)
                back = np.concatenate([dz, dr, dn * s], 1)
                dg[:, k] = np.concatenate([dz, dr, dn], 1)
                g[f"U{d}"] += h.T @ back
                dh = dh * (1 - m * (1 - z)) + back @ self.p[f"U{d}"].T
            g[f"W{d}"], g[f"c{d}"] = np.einsum("bti,btg->ig", x, dg), dg.sum((0, 1))
            dx += dg @ self.p[f"W{d}"].T
        dx[..., : 2 * WIDTH] *= seen
        np.add.at(g["words"], word, dx[..., :WIDTH])
        own, at = ragged(grams)
        share = np.zeros((len(own.first) - 1, WIDTH), dx.dtype)
        np.add.at(share, at, dx[..., WIDTH : 2 * WIDTH])
        share /= np.maximum(np.diff(own.first), 1)[:, None]
        np.add.at(g["grams"], own.flat % GRAM_ROWS, share[own.of()])
        return loss, g


def log_odds(toxic: np.ndarray, other: np.ndarray, n_toxic, n_other) -> np.ndarray:
    """Smoothed log-odds of document counts, drawn to 0 where little is known."""
    seen = toxic + other
    raw = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    return np.clip(seen / (seen + 2) * raw, -4, 4).astype(np.float32)


def word_odds(words: np.ndarray, grams: np.ndarray, word_rows: np.ndarray, own: Grams) -> np.ndarray:
    """Per word its own log-odds and those of its strongest gram."""
    strongest = np.maximum.reduceat(grams[own.flat], own.first[:-1])  # every word has grams
    return np.stack([words[word_rows], strongest], 1).astype(np.float32)


@dataclass
class Model:
    """What scoring needs: the network, the odds and the calibration; ``constant`` if nothing was learned."""

    net: Network | None = None
    odds: np.ndarray | None = None
    gram_odds: np.ndarray | None = None
    calibration: np.ndarray | None = None
    constant: float = 0.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def calibrated(self, logits: np.ndarray) -> float:
        """The score of a document from the logits of its windows."""
        return float(1 / (1 + np.exp(-np.clip(features(logits) @ self.calibration, -30, 30))))


def features(logits: np.ndarray) -> np.ndarray:
    """What the calibration sees of a document: strongest, third strongest and mean of its windows."""
    if not len(logits):
        return np.array([-8.0, -8.0, 0.0, 1.0])
    top = np.sort(np.clip(logits, -8, 8))[::-1]
    return np.array([top[0], top[min(2, len(top) - 1)], sigmoid(top).mean(), 1.0])


class Windows:
    """Windows of training documents as arrays; ``doc`` tells whose each one is."""

    def __init__(self, docs: list[list[str]], toxic: np.ndarray):
        place: dict[str, int] = {}
        packed, counted, words, odds = array("i"), array("i"), array("i"), array("i")
        self.doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        ids = np.zeros((len(self.doc), WINDOW), np.int32)
        self.mask = np.zeros((len(self.doc), WINDOW), np.float32)
        for k, win in enumerate(w for d in docs for w in d):
            found = win.split(" ")
            for w in found:
                if w not in place:
                    place[w] = len(place)
                    o, r, grams = word_row(w)
                    odds.append(o)
                    words.append(r)
                    packed.extend(grams)
                    counted.append(len(grams))
            ids[k, : len(found)] = [place[w] for w in found]
            self.mask[k, : len(found)] = 1
        del place
        odds_rows, word_rows = np.array(odds, np.int32), np.array(words, np.int32)
        gram_rows = Grams(np.array(packed, np.int32), np.array(counted, np.int64))
        ends = np.cumsum([0, *[len(d) for d in docs]])
        seen = [np.unique(ids[x:y][self.mask[x:y] > 0]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
        part = np.arange(len(docs)) % PARTS
        counts = np.zeros((PARTS, 2, ODDS_ROWS), np.float32)
        gram_counts = np.zeros((PARTS, 2, GRAM_ODDS), np.float32)
        for own, y, k in zip(seen, toxic, part, strict=True):
            counts[k, int(y), np.unique(odds_rows[own])] += 1
            gram_counts[k, int(y), np.unique(gram_rows.take(own).flat)] += 1
        sizes = np.array([[((part == k) & (toxic == y)).sum() for y in (0, 1)] for k in range(PARTS)], float)
        whole, whole_grams, n = counts.sum(0), gram_counts.sum(0), sizes.sum(0)
        self.table = log_odds(whole[1], whole[0], n[1], n[0])
        self.gram_table = log_odds(whole_grams[1], whole_grams[0], n[1], n[0])
        # a document's own part is left out of the counts that its odds come from
        self.odds = np.zeros((*ids.shape, 2), np.float32)
        for k in range(PARTS):
            rest, grams, m = whole - counts[k], whole_grams - gram_counts[k], n - sizes[k]
            at = part[self.doc] == k
            both = word_odds(log_odds(rest[1], rest[0], m[1], m[0]), log_odds(grams[1], grams[0], m[1], m[0]), odds_rows, gram_rows)
            self.odds[at] = both[ids[at]] * self.mask[at][..., None]
        self.word, self.ids, self.gram_rows = word_rows[ids], ids, gram_rows

    def take(self, at: np.ndarray) -> tuple:
        distinct, place = np.unique(self.ids[at], return_inverse=True)
        return self.word[at], (self.gram_rows.take(distinct), place.reshape(len(at), WINDOW)), self.odds[at], self.mask[at]

    def logits(self, net: Network) -> np.ndarray:
        out = []
        for k in range(0, len(self.doc), 512):
            word, grams, odds, mask = self.take(np.arange(k, min(k + 512, len(self.doc))))
            x = net.inputs(word, grams, odds)
            out.append(net.logits({d: x @ net.p[f"W{d}"] + net.p[f"c{d}"] for d in "fb"}, mask))
        return np.concatenate(out)


def fit(docs: list[list[str]], toxic: list[int], share: float | None = None) -> Model:
    """A model from documents as windows (words joined by spaces), with labels; ``share`` is the true share of toxic ones."""
    y = np.array(toxic, np.int64)
    if len(set(toxic)) < 2:
        return Model(constant=float(y[0]) if len(y) else 0.0)
    data, net, rng = Windows(docs, y), Network(), np.random.default_rng(5)
    label = y[data.doc]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    strength = (data.odds * (data.odds > 0)).sum(2).max(1)
    step = 0
    for epoch in range(EPOCHS):
        if epoch in (2, 4, 6, 8):
            strength = data.logits(net)
        # of each document its strongest window, and of the others one at random besides
        order = np.lexsort((rng.random(len(label)), strength, data.doc))
        last = np.flatnonzero(np.r_[data.doc[order][1:] != data.doc[order][:-1], True])
        strongest = order[last]
        chosen = np.concatenate([strongest, rng.choice(np.flatnonzero(label == 0), min(len(docs) // 2, int((label == 0).sum())), replace=False)])
        chosen = rng.permutation(chosen)
        balance = np.where(label[chosen] == 1, 0.5 / max((label[chosen] == 1).mean(), 1e-6), 0.5 / max((label[chosen] == 0).mean(), 1e-6))
        for k in range(0, len(chosen), BATCH):
            at = chosen[k : k + BATCH]
            weight = (balance[k : k + BATCH] / len(at)).astype(np.float32)
            seen = (rng.random((len(at), WINDOW, 1)) >= BLANK).astype(np.float32) / (1 - BLANK)
            _, grads = net.gradients(*data.take(at), label[at].astype(np.float32), weight, seen)
            step += 1
            for name, g in grads.items():
                m, v = moments[name]
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                rate = RATE / 10 if name in ("words", "grams") else RATE
                net.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) + 1e-2 * rate * net.p[name]).astype(np.float32)
    logits = data.logits(net)
    x = np.stack([features(logits[data.doc == i]) for i in range(len(docs))])
    true = y.mean() if share is None else share
    weight = np.where(y == 1, true / y.mean(), (1 - true) / (1 - y.mean()))
    return Model(net, data.table, data.gram_table, calibrate(x, y, weight))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


class Scorer:
    """Scores of whole texts; input gates of words seen are kept, up to ``KNOWN_WORDS``."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.gates = {d: np.zeros((1, 3 * HIDDEN), np.float32) for d in "fb"}

    def learn(self, words: list[str]) -> None:
        rows = [word_row(w) for w in words]
        grams = Grams(np.fromiter((g for r in rows for g in r[2]), np.int32), np.array([len(r[2]) for r in rows]))
        net = self.model.net
        odds = word_odds(self.model.odds, self.model.gram_odds, np.array([r[0] for r in rows]), grams)
        x = net.inputs(np.array([r[1] for r in rows]), (grams, np.arange(len(rows))), odds)
        at = len(self.gates["f"])
        self.place.update(zip(words, range(at, at + len(words)), strict=True))
        self.gates = {d: np.concatenate([self.gates[d], x @ net.p[f"W{d}"] + net.p[f"c{d}"]]) for d in "fb"}

    def scores(self, texts: list[str]) -> list[float]:
        if self.model.net is None:
            return [self.model.constant] * len(texts)
        out: list[float] = []
        part: list[list[str]] = []
        size = 0
        for text in texts:
            part.append(tokens(text))
            size += len(part[-1]) // STRIDE + 1
            if size >= WINDOW_BATCH:
                out += self._scores(part)
                part, size = [], 0
        return out + self._scores(part)

    def _scores(self, docs: list[list[str]]) -> list[float]:
        unseen = set().union(*docs).difference(self.place)
        if len(self.place) + len(unseen) > KNOWN_WORDS:
            self.forget()
            unseen = set().union(*docs)
        if unseen:
            self.learn(list(unseen))
        ids = [np.fromiter(map(self.place.__getitem__, d), np.int64, len(d)) for d in docs]
        begins = [starts(len(d)) for d in docs]
        counts = [len(b) for b in begins]
        first = np.cumsum([0, *[len(d) for d in docs]])
        flat = np.concatenate([*ids, np.zeros(WINDOW, np.int64)])
        at = np.array([b + f for bs, f in zip(begins, first, strict=False) for b in bs], np.int64)
        long = np.array([min(len(d), WINDOW) for d, bs in zip(docs, begins, strict=True) for _ in bs], np.int64)
        logits = np.zeros(len(at))
        for k in range(0, len(at), WINDOW_BATCH):
            words = flat[at[k : k + WINDOW_BATCH, None] + np.arange(WINDOW)]
            mask = (np.arange(WINDOW) < long[k : k + WINDOW_BATCH, None]).astype(np.float32)
            logits[k : k + WINDOW_BATCH] = self.model.net.logits({d: self.gates[d][words] for d in "fb"}, mask)
        ends = np.cumsum([0, *counts])
        return [self.model.calibrated(logits[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def scorer(model: Model) -> Scorer:
    """This process's scorer of ``model``."""
    return resident((f"toxicity {model.key}",), lambda: Scorer(model))


def held_out() -> Column:
    """True for the quarter of ids that nothing is learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of the labelled rows that aren't held out."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    # at most 2 * SAMPLE_DOCS rows, each an id and a label
    sample = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS) for y in (0, 1)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample[0].unionByName(sample[1])), "doc_id")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        windows = []
        for text in texts_of(batch):
            words = tokens(text)
            windows.append([" ".join(words[a : a + WINDOW]) for a in starts(len(words))])
        columns = [batch.column("doc_id"), batch.column("toxic"), pa.array([len(w) for w in windows], pa.int32()), pa.array(windows, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "n", "windows"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cutup = cut(map_batches(chosen, rows, f"doc_id {kind}, toxic int, n int, windows array<string>").where("n > 0"))
    # of rows that share an id the one with most windows
    first = Window.partitionBy("doc_id").orderBy(F.desc("n"), F.xxhash64("windows"))
    one = cutup.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    left, taken = {0: SAMPLE_WINDOWS, 1: SAMPLE_WINDOWS}, []
    for r in one.select("doc_id", "toxic", "n").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["n"] <= left[r["toxic"]]:
            left[r["toxic"]] -= r["n"]
            taken.append((r["doc_id"],))
    if not taken:
        return fit([], [], None)
    ids = docs.sparkSession.createDataFrame(taken, f"doc_id {kind}")
    found = one.join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "windows").collect()
    found.sort(key=lambda r: r["doc_id"])
    total = sum(sizes.values())
    return fit([r["windows"] for r in found], [r["toxic"] for r in found], sizes.get(1, 0) / total if total else None)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scorer(model).scores(texts_of(batch))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = map_batches(docs.select("doc_id", "text"), rows, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under the threshold."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = scorer(model).scores(texts_of(batch))
                yield batch.select(names).filter(pa.array([s < threshold for s in found], pa.bool_()))

    return in_arrow(docs, run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}

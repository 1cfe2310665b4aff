"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

The last token of a byte-pair encoding of a word's prefix is its only vocabulary suffix that keeps
its boundary next to the last token of what stands before it. So ``count[i] = count[i - len(t)] + 1``
for that suffix ``t``, and one pass gives the exact count at every prefix; truncation and budget
questions are then look-ups, without encoding anything again.

Defined results: a null text counts as empty (0 tokens, one prefix); ties and repeated rows are kept
row by row; columns beyond the two that are named are ignored, whatever they are called.
"""

from __future__ import annotations

import json
import re
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from telemetrica.llm.bytebpe import PRE_TOKEN, ChunkTable, byte_alphabet, chunks_of, parts_of, plain_core
from telemetrica.llm.common import map_batches, resident, table, texts_of

LIMIT = 1024
#: Words of at most this many bytes are counted together, ``TOGETHER`` at a time.
SHORT, TOGETHER = 24, 1 << 14
MEMO_ENTRIES = 400_000


class PrefixCounter:
    """Token counts at every code-point prefix, for the vocabulary in ``path``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda piece: bytes(map(alphabet.__getitem__, piece))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        added = set(self.special)
        self.units = [raw(p) for p in spec["model"]["vocab"] if p not in added]
        self.place = {u: k for k, u in enumerate(self.units)}
        self.longest = max(map(len, self.units))
        self.core, self.core_id = plain_core(spec, Tokenizer.from_file(path)), {raw(p): k for p, k in spec["model"]["vocab"].items() if p not in added}
        self.whole = np.full(len(self.units), -1, np.int8)
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes | list[int]] = {}
        self.pattern = regex.compile(PRE_TOKEN)
        self.odd = re.compile("|".join([r"(?!\A)[\s']", *map(re.escape, self.special)]))
        self.cuts = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.table = ChunkTable(self._relatives)
        self._grow()

    def _grow(self) -> None:
        """The tree of all units read backwards: sorted edges (node * 256 + byte), where they lead, and the unit that ends at a node."""
        edges: dict[int, int] = {}
        ends: list[int] = [-1]
        for k, unit in enumerate(self.units):
            node = 0
            for b in reversed(unit):
                node = edges.setdefault(node << 8 | b, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = k
        codes = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(codes)
        self.edges, self.leads, self.ends = codes[order], np.fromiter(edges.values(), np.int64, len(edges))[order], np.array(ends, np.int64)

    def _merge(self, word: bytes) -> list[bytes]:
        """The merges of one short word, lowest rank first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _reachable(self, unit: int) -> bool:
        """Whether merges make the unit of its own bytes."""
        if self.whole[unit] < 0:
            self.whole[unit] = self._merge(self.units[unit]) == [self.units[unit]]
        return bool(self.whole[unit])

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether merges of the two units' bytes end in the two units."""
        pair = left * len(self.units) + right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) > MEMO_ENTRIES:
                self.fits.clear()
            a, b = self.units[left], self.units[right]
            if self.core is None or a + b in self.place:  # the core takes any unit for whole
                known = self._merge(a + b) == [a, b]
            else:
                known = self.core._encode_single_piece(a + b) == [self.core_id[a], self.core_id[b]]
            self.fits[pair] = known
        return known

    def _column(self, word: bytes) -> list[int]:
        """Counts at each byte prefix of one pre-token, from the left."""
        out: list[tuple[int, int]] = []
        for i in range(1, len(word) + 1):
            for n in range(min(i, self.longest), 0, -1):
                unit = self.place.get(word[i - n : i])
                if unit is not None and self._reachable(unit):
                    if n == i:
                        out.append((1, unit))
                        break
                    count, before = out[i - n - 1]
                    if self._adjacent(before, unit):
                        out.append((count + 1, unit))
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return [n for n, _ in out]

    def _columns(self, words: list[bytes]) -> list[bytes]:
        """``_column`` of many words of at most ``SHORT`` bytes, position by position for all of them."""
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        sizes = np.array([len(words[k]) for k in order])
        width = int(sizes[0])
        data = np.frombuffer(b"".join(words[k].ljust(width, b"\0") for k in order), np.uint8).reshape(-1, width)
        alive = [int((sizes >= i).sum()) for i in range(1, width + 1)]  # words with an i-th byte come first
        counts, last = np.zeros((len(words), width + 1), np.int64), np.zeros((len(words), width + 1), np.int64)
        for i, m in enumerate(alive, 1):
            # units that end at byte i, by their length
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            rows, node = np.arange(m), np.zeros(m, np.int64)
            for n in range(1, i + 1):
                code = node << 8 | data[rows, i - n]
                at = np.minimum(np.searchsorted(self.edges, code), len(self.edges) - 1)
                on = self.edges[at] == code
                rows, node = rows[on], self.leads[at[on]]
                unit = self.ends[node]
                ended = unit >= 0
                if ended.any():
                    found.append((n, rows[ended], unit[ended]))
                if not len(rows):
                    break
            for n, rows, unit in reversed(found):
                open_ = counts[rows, i] == 0
                rows, unit = rows[open_], unit[open_]
                if not len(rows):
                    continue
                for k in np.unique(unit[self.whole[unit] < 0]).tolist():
                    self._reachable(k)
                good = self.whole[unit] == 1
                rows, unit = rows[good], unit[good]
                if n < i:
                    pairs, inverse = np.unique(last[rows, i - n] * len(self.units) + unit, return_inverse=True)
                    good = np.fromiter((self._adjacent(*divmod(p, len(self.units))) for p in pairs.tolist()), bool, len(pairs))[inverse]
                    rows, unit = rows[good], unit[good]
                counts[rows, i], last[rows, i] = counts[rows, i - n] + 1, unit
            if not counts[:m, i].all():
                raise ValueError("the vocabulary lacks a byte")
        small = counts[:, 1:].astype(np.uint8)
        out = [b""] * len(words)
        for k, row, size in zip(order, small, sizes.tolist(), strict=True):
            out[k] = row[:size].tobytes()
        return out

    def _learn(self, words: set[str]) -> None:
        """Take short words that aren't known yet into the table of words."""
        if len(self.words) + len(words) > MEMO_ENTRIES:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        raws = [w.encode() for w in new]
        short = [k for k, r in enumerate(raws) if len(r) <= SHORT]
        for k in range(0, len(short), TOGETHER):
            part = short[k : k + TOGETHER]
            for at, column in zip(part, self._columns([raws[j] for j in part]), strict=True):
                self.words[new[at]] = self._by_character(new[at], column)

    @staticmethod
    def _by_character(word: str, column: bytes | list[int]) -> bytes | list[int]:
        """Of the counts at byte prefixes those at code-point prefixes."""
        if len(column) == len(word):
            return column
        return type(column)(column[end - 1] for end in accumulate(len(c.encode()) for c in word))

    def _word(self, word: str) -> bytes | list[int]:
        """Counts at each code-point prefix of a text that is one pre-token."""
        known = self.words.get(word)
        if known is None:
            raw = word.encode()
            known = self._by_character(word, self._column(raw))
            if len(raw) <= SHORT:
                self.words[word] = known
        return known

    def _plain(self, text: str) -> list[int]:
        """Counts at each prefix of a text without added tokens."""
        out: list[int] = []
        base, spans = 0, [m.span() for m in self.pattern.finditer(text)]
        k = 0
        while k < len(spans):
            start, end = spans[k]
            word = text[start:end]
            if word[0] == "'" and len(word) == 3 and word[1:].isalpha():
                # a contraction cut short is an apostrophe and a letter
                ordinary = self._word("'")[-1]
                counts = [ordinary, ordinary + self._word(word[1])[-1], self._word(word)[-1]]
            elif word[0] == "'" and len(word) == 2 and word[1:].isalpha():
                counts = [self._word("'")[-1], self._word(word)[-1]]
            elif word.isspace():
                # any prefix that ends inside a run of white space has all of the run as one pre-token
                stop = end
                while stop < len(text) and text[stop].isspace():
                    stop += 1
                run = text[start:stop]
                out += [base + n for n in self._word(run)]
                inner = 0
                while k < len(spans) and spans[k][1] <= stop:
                    inner += self._word(text[spans[k][0] : spans[k][1]])[-1]
                    k += 1
                base += inner
                if k < len(spans) and spans[k][0] < stop:
                    counts = self._word(text[spans[k][0] : spans[k][1]])
                    out += [base + n for n in counts[stop - spans[k][0] :]]
                    base += counts[-1]
                    k += 1
                continue
            else:
                counts = self._word(word)
            out += [base + n for n in counts]
            base += counts[-1]
            k += 1
        return out

    def _counts(self, text: str) -> list[int]:
        if not self.cuts or not self.cuts.search(text):
            return self._plain(text)
        out: list[int] = []
        base = at = 0
        for m in self.cuts.finditer(text):
            # short of its end an added token's string is ordinary text; complete, it is one token
            ordinary = self._plain(text[at : m.end() - 1])
            out += [base + n for n in ordinary]
            before = self._plain(text[at : m.start()])
            base += (before[-1] if before else 0) + 1
            out.append(base)
            at = m.end()
        return out + [base + n for n in self._plain(text[at:])]

    def _relatives(self, chunks: list[str]) -> list[bytes | list[int]]:
        """Counts at each prefix of each chunk, as bytes if they are small."""
        split = list(map(self.pattern.findall, chunks))
        self._learn(set(chain.from_iterable(split)))
        odd, out = self.odd.search, []
        for chunk, words in zip(chunks, split, strict=True):
            if odd(chunk):
                counts = self._counts(chunk)
            elif len(words) == 1:
                counts = self._word(words[0])
            else:
                counts, base = [], 0
                for word in words:
                    own = self._word(word)
                    counts += [base + n for n in own]
                    base += own[-1]
            out.append(counts if isinstance(counts, bytes) or (counts and max(counts) > 255) else bytes(counts))
        return out

    def tables(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its count at every prefix: entry ``i`` is for the first ``i`` code points."""
        return [t for part in parts_of(texts) for t in self._tables(part)]

    def _tables(self, texts: list[str]) -> list[np.ndarray]:
        lists = [chunks_of(t) for t in texts]
        get = self.table.look_up(lists).__getitem__
        out = []
        for chunks in lists:
            found = list(map(get, chunks))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            if sizes.max() < 256:
                inner = np.frombuffer(b"".join(found), np.uint8)
            else:
                inner = np.concatenate([np.frombuffer(x, np.uint8) if isinstance(x, bytes) else x for x in found]).astype(np.int64)
            ends = np.cumsum(sizes)
            totals = np.where(sizes > 0, inner[np.maximum(ends, 1) - 1] if len(inner) else 0, 0).astype(np.int64)
            base = np.repeat(np.cumsum(totals) - totals, sizes)
            out.append(np.concatenate([[0], base + inner]).astype(np.uint32))
        return out


def fitting_prefix(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens; 0 for a negative budget."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) if len(fits) else 0


def counter(path: str) -> PrefixCounter:
    """This process's counter for ``path``."""
    return resident(("prefixes", path), lambda: PrefixCounter(path))


def count_tokens(docs: DataFrame, path: str, budget: int = LIMIT, id_column: str = "doc_id", text_column: str = "text", with_table: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit, n_budget (code points of the longest prefix within
    ``budget`` tokens), and with ``with_table`` the whole prefix table as little-endian uint32 bytes.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean, n_budget long"
    schema += ", prefix_counts binary" * with_table

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, text_column)
        tables = counter(path).tables(texts)
        totals = [int(t[-1]) for t in tables]
        columns = [
            batch.column(id_column),
            pa.array([len(t.encode()) for t in texts], pa.int64()),
            pa.array(totals, pa.int64()),
            pa.array([n > budget for n in totals], pa.bool_()),
            pa.array([fitting_prefix(t, budget) for t in tables], pa.int64()),
        ]
        names = [id_column, "n_bytes", "n_tokens", "over_limit", "n_budget"]
        if with_table:
            columns.append(pa.array([t.astype("<u4").tobytes() for t in tables], pa.binary()))
            names.append("prefix_counts")
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs.select(id_column, text_column), rows, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}

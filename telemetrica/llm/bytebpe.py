"""Byte-level BPE over chunks: texts are cut where the library's pre-tokenizer always cuts.

A single space between two non-space characters always begins a pre-token, so a text is the
concatenation of chunks that encode independently. Chunks repeat far more often than texts, so each
Python worker keeps a bounded table of encoded chunks; a full table is emptied, which costs time only.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np

from telemetrica.llm.common import resident

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = re.compile(r"\s\s")
CHUNK = re.compile(r"(?<=\S)(?= \S)")
MARK = "\uffff"
TABLE_ENTRIES = 500_000
PART_CHARS = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def chunks_of(text: str) -> list[str]:
    """``text`` cut before each single space that stands between two non-space characters."""
    if MARK in text or SPACES.search(text) or text[-1:] == " ":
        return CHUNK.split(text)
    return text.replace(" ", "\uffff ").split(MARK)


def parts_of(texts: list[str], chars: int = PART_CHARS) -> Iterator[list[str]]:
    """``texts`` in runs of about ``chars``, so that only one run's chunks are in memory."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


class ChunkTable:
    """Values of chunks, computed in batches by ``compute``; two generations of ``entries / 2`` are kept."""

    def __init__(self, compute, entries: int = TABLE_ENTRIES):
        self.compute, self.half, self.new, self.old = compute, entries // 2, {}, {}

    def look_up(self, lists: list[list[str]]) -> dict:
        """A mapping that holds every chunk of ``lists``."""
        if len(self.new) > self.half:
            self.new, self.old = {}, self.new
        unseen = set(chain.from_iterable(lists)).difference(self.new)
        known = self.old.keys() & unseen
        self.new.update({x: self.old.pop(x) for x in known})
        missing = list(unseen - known)
        self.new.update(zip(missing, self.compute(missing), strict=True))
        return self.new


def plain_core(spec: dict, library):
    """tiktoken's encoding set up from a byte-level vocabulary file; None unless it must give the ids of ``library``, a tokenizers one.

    Both take the pair of lowest rank first, leftmost of equals, if the file's ids are in the order of its merges. tiktoken
    takes a unit for whole at once, so the library's merges have to make every unit of its own characters; all are tried.
    """
    vocabulary, added = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    if any(vocabulary[a + b] != 256 + k for k, (a, b) in enumerate(pairs)):
        return None
    split = library.model.tokenize
    if any([t.id for t in split(p)] != [k] for p, k in vocabulary.items() if p not in added):
        return None
    import tiktoken

    alphabet = byte_alphabet()
    ranks = {bytes(map(alphabet.__getitem__, p)): k for p, k in vocabulary.items() if p not in added}
    return tiktoken.Encoding("plain", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


#: Marks that end many words; none of them joins letters, and no added token ends in one.
TAIL = ".,;:!?*#%&$|-"
#: Below this code point two libraries' letter classes are taken to agree.
SETTLED = "\u0250"


class IdTable(ChunkTable):
    """Token ids of chunks as little-endian unsigned 32-bit bytes, for the vocabulary in ``path``.

    A word with marks behind it is the word and the marks. Plain chunks are merged by tiktoken's faster
    core where ``plain_core`` proves that it gives the same ids; all others, and those with strings of added
    tokens, go through the tokenizers library itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__(self._compute)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tails: dict[str, bytes] = {}
        core = None if any(t[-1] in TAIL for t in self.special) else plain_core(spec, self.library)
        self.fast = core and core.encode_ordinary

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        if self.fast:
            for c in chunks:
                if (c.isascii() or max(c) < SETTLED) and not any(s in c for s in self.special):
                    out[c] = array("I", self.fast(c)).tobytes()
        rest = [c for c in chunks if c not in out]
        found = self.library.encode_batch_fast(rest, add_special_tokens=False)
        out.update(zip(rest, [np.array(x.ids, "<u4").tobytes() for x in found], strict=True))
        return list(map(out.__getitem__, chunks))

    def _compute(self, chunks: list[str]) -> list[bytes]:
        stems = []
        for c in chunks:
            stem = c.rstrip(TAIL)
            stems.append(stem if len(stem) < len(c) and stem[-1:].isalpha() else c)
        wanted = set(stems)
        known = {x: self.new[x] for x in wanted & self.new.keys()} | {x: self.old[x] for x in wanted & self.old.keys()}
        missing = list(wanted.difference(known))
        known.update(zip(missing, self._encoded(missing), strict=True))
        tails = {c[len(s) :] for c, s in zip(chunks, stems, strict=True)} - self.tails.keys() - {""}
        self.tails.update(zip(list(tails), self._encoded(list(tails)), strict=True))
        if len(self.tails) > self.half:
            self.tails = {t: b for t, b in self.tails.items() if t in tails}
        self.new.update((s, known[s]) for s in missing)
        return [known[s] + self.tails[c[len(s) :]] if len(s) < len(c) else known[s] for c, s in zip(chunks, stems, strict=True)]


def id_table(path: str) -> IdTable:
    """This process's table for ``path``."""
    return resident(("ids", path), lambda: IdTable(path))


def encode_ids(texts: list[str], path: str) -> list[bytes]:
    """Each text's token ids as little-endian unsigned 32-bit bytes, as the library gives them."""
    out = []
    for part in parts_of(texts):
        lists = [chunks_of(t) for t in part]
        get = id_table(path).look_up(lists).__getitem__
        out += [b"".join(map(get, x)) for x in lists]
    return out

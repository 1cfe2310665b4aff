"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; its normaliser, white-space marker, scores (unigram) or merges
(BPE) and byte fallback are rebuilt as a ``tokenizers.Tokenizer``. Texts are encoded in batches on
several threads. If no piece has the marker behind another character, words are independent, and each
distinct word of a batch is encoded once.

Defined results: a null text is an empty one, with no ids; rows are encoded one by one, so ties and
repeated rows are kept; decoding gives back the normalised text (the marker U+2581 itself reads as a
space, as the model defines); other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from telemetrica.llm.bytebpe import ChunkTable, parts_of
from telemetrica.llm.common import map_batches, resident, table, texts_of

MARKER = "▁"
WORD = re.compile(f"(?<=[^{MARKER}])(?={MARKER})")
THREADS = 2
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value, at


def wire_fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    out, at = [], 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind} isn't known")
            value, at = data[at : at + size], at + size
        out.append((key >> 3, value))
    return out


@dataclass
class Model:
    """What encoding needs of a model file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    byte_fallback: bool = False
    suffix: bool = False


def parse_model(data: bytes) -> Model:
    """The model in ``data``; fields that encoding doesn't need are passed over."""
    model = Model()
    for number, value in wire_fields(data):
        if number == 1:
            piece = dict(wire_fields(value))
            model.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(wire_fields(value))
            model.kind = spec.get(3, UNIGRAM)
            model.byte_fallback = bool(spec.get(35, 0))
            model.suffix = bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(wire_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    if model.suffix or model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models with the marker before words are supported")
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """The merges of a BPE model, best score first; pieces that text can't make take no part."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER, UNUSED)}
    place = {p: k for k, (p, _, _) in enumerate(model.pieces)}
    found = []
    for piece, s in score.items():
        splits = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in score and piece[i:] in score]
        found += [(-s, place[piece], place[a], place[b], a, b) for a, b in splits]
    return [x[-2:] for x in sorted(found)]


class PieceCodec:
    """Encoder and decoder of one model."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        with open(path, "rb") as f:
            self.model = model = parse_model(f.read())
        unknown = next((k for k, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
        if model.kind == BPE:
            core = models.BPE(
                vocab={p: k for k, (p, _, _) in enumerate(model.pieces)},
                merges=merges_of(model),
                unk_token=None if unknown is None else model.pieces[unknown][0],
                fuse_unk=True,
                byte_fallback=model.byte_fallback,
            )
        else:
            core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
        self.library = Tokenizer(core)
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self.normalizer = normalizers.Sequence(steps) if steps else None
        parts = [decoders.Replace(MARKER, " ")] + [decoders.ByteFallback()] * model.byte_fallback + [decoders.Fuse()]
        self.library.decoder = decoders.Sequence(parts)
        self.words = not any(MARKER in p.lstrip(MARKER) for p, _, kind in model.pieces if kind in (NORMAL, USER))
        self.table = ChunkTable(lambda words: self._encode([MARKER + w for w in words]))
        self.odd = ChunkTable(self._encode)
        #: What the library's decoder makes of each piece, and which of them it decodes one by one: bytes of
        #: ASCII characters too, as long as no other bytes stand beside them.
        byte = [int(p[3:5], 16) if kind == BYTE else 256 for p, _, kind in model.pieces]
        self.said = np.array([chr(b) if b < 128 else p.replace(MARKER, " ") for b, (p, _, _) in zip(byte, model.pieces, strict=True)], object)
        self.alone = np.array([b < 128 or kind in (NORMAL, USER) for b, (_, _, kind) in zip(byte, model.pieces, strict=True)], bool)

    def _encode(self, words: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _words(self, text: str) -> list[str] | None:
        """The words of a normalised text without their markers; None if they aren't marked one by one."""
        if text[:1] != MARKER or text[-1:] == MARKER or MARKER * 2 in text:
            return None
        return text[1:].split(MARKER)

    def normalised(self, text: str) -> str:
        """``text`` as the model's normaliser leaves it, with the marker for spaces."""
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        if text and self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARKER) if self.model.escape else text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        out = []
        for part in parts_of(texts):
            own = [self.normalised(t) for t in part]
            lists = [self._words(n) if self.words else None for n in own]
            get = self.table.look_up([x for x in lists if x is not None]).__getitem__
            found = [None if x is None else b"".join(map(get, x)) for x in lists]
            rest = [k for k, f in enumerate(found) if f is None]
            if rest:
                lists = [WORD.split(own[k]) if self.words else [own[k]] for k in rest]
                get = self.odd.look_up(lists).__getitem__
                for k, x in zip(rest, lists, strict=True):
                    found[k] = b"".join(map(get, x))
            out += found
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        """The normalised texts behind ids, without the prefix that encoding added.

        Texts of ordinary pieces alone are what the library's decoder makes of each; those with bytes or unknown
        pieces go through it as they are.
        """
        lists = [np.frombuffer(x, "<u4") for x in ids]
        texts: list[str | None] = ["".join(self.said[x].tolist()) if self.alone[x].all() else None for x in lists]
        rest = [k for k, t in enumerate(texts) if t is None]
        for k, t in zip(rest, self.library.decode_batch([lists[k].tolist() for k in rest], skip_special_tokens=False), strict=True):
            texts[k] = t
        return [t[1:] if self.model.dummy_prefix and t[:1] == " " else t for t in texts]


def codec(path: str, threads: int = THREADS) -> PieceCodec:
    """This process's codec for ``path``."""
    return resident(("pieces", path, threads), lambda: PieceCodec(path, threads))


def peer(path: str):
    """The sentencepiece library's own processor, for parity."""
    import sentencepiece

    return resident(("pieces", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", threads: int = THREADS, with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_crc32, parity (the ids equal the sentencepiece library's), round_trip
    (decoding gives back the text) and, if asked for, ids as little-endian unsigned 32-bit bytes.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids binary" * with_ids

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, own = texts_of(batch, text_column), codec(path, threads)
        ids = own.encode(texts)
        parity, back = [], []
        at = 0
        for part in parts_of(texts):
            found, at = ids[at : at + len(part)], at + len(part)
            theirs = peer(path).encode(part, num_threads=threads)
            parity += [x == np.array(y, "<u4").tobytes() for x, y in zip(found, theirs, strict=True)]
            back += [x == y for x, y in zip(own.decode(found), part, strict=True)]
        columns = [
            batch.column(id_column),
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            pa.array(parity, pa.bool_()),
            pa.array(back, pa.bool_()),
        ]
        names = [id_column, "n_tokens", "ids_crc32", "parity", "round_trip"]
        if with_ids:
            columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs.select(id_column, text_column), rows, schema)


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op2_sentence_pieces": op2_sentence_pieces}
ORACLES: dict[str, str] = {}

"""Secret scanning: patterns by kind, and candidates confirmed by the structure they decode to.

Assignments, access ids and hexadecimal runs are reported as matched. Besides, base64 and hexadecimal
candidates are decoded and reported only if the bytes parse as a key: nested DER lengths that fill their
parents exactly with the integers or object ids of a key encoding, an OpenSSH key's length-prefixed
fields, or a signed token whose header is JSON with an algorithm. A key may begin at any character of a
run: the outer length in its first bytes says where it has to end, so neither what is glued to it, nor
line breaks inside, nor the alignment of the run matter. Armoured keys may have headers; encrypted ones
are confirmed by their outer structure or, where nothing but cipher blocks is left, by header and length.
Long runs are decoded once more (base64 at its four alignments, hexadecimal at both) and what they hold
is searched the same way.

Defined results: a null text is an empty one, without spans; overlapping spans of different kinds
are all reported; repeated rows are scanned row by row; other columns are ignored by the scan and
kept by the redaction.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from telemetrica.llm.common import in_arrow, map_batches, table, texts_of

#: What is matched as an assignment, an access id and a hexadecimal run.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Kinds in the order of the report; the first three are the base.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key", "hexkey", "nested")
TOKEN = re.compile(r"(?=(e[yw][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{16,}))e")
ARMOR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
#: Where base64 and hexadecimal forms of a key can begin: a DER sequence, or OpenSSH's magic.
BLOB = re.compile(r"M[A-I](?=[A-Za-z0-9+/_-])|b3BlbnNzaC1rZXktdjEA")
HEX_BLOB = re.compile(r"30(?:8[1-3]|[0-7][0-9a-fA-F])|6[fF]70656[eE]7373682[dD]6[bB]65792[dD]763100")
RUN64, RUN16 = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9a-fA-F]+")
WRAP = re.compile(r"(?:\\r)?\\n|[ \t]*[\r\n]+[ \t]*")
PAD = re.compile("={0,2}")
NESTED = re.compile(r"[A-Za-z0-9+/_-]{64,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*")
LEAST_BYTES = 36
MAGIC = b"openssh-key-v1\x00"
REDACTED = "[REDACTED]"

Span = tuple[str, int, int]


def decoded(text: str) -> bytes | None:
    """The bytes of a base64 text in either alphabet, padded or not; None if it is no base64."""
    body = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and values of DER elements that fill ``data`` exactly; None if they don't."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            size, at = int.from_bytes(data[at : at + k], "big"), at + k
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """True for the DER forms of private keys: a list of integers, PKCS #8, or a curve's key."""
    outer = der_fields(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_fields(outer[0][1])
    if not inner or len(inner) < 3 or inner[0][0] != 0x02:
        return False
    tags = [t for t, _ in inner]
    if len(tags) >= 6 and set(tags[:6]) == {0x02}:
        return True
    if tags[1] == 0x30 and tags[2] == 0x04:
        named = der_fields(inner[1][1])
        return bool(named) and named[0][0] == 0x06
    return inner[0][1] == b"\x01" and tags[1] == 0x04 and len(inner[1][1]) >= 20 and tags[2] in (0xA0, 0xA1)


def is_encrypted_key(data: bytes) -> bool:
    """True for an encrypted private key's DER: the cipher, named by an object id, and what it made."""
    outer = der_fields(data)
    inner = der_fields(outer[0][1]) if outer and len(outer) == 1 and outer[0][0] == 0x30 else None
    if not inner or [t for t, _ in inner] != [0x30, 0x04]:
        return False
    named = der_fields(inner[0][1])
    return bool(named) and named[0][0] == 0x06


def openssh_size(data: bytes) -> int | None:
    """How many of the bytes are an OpenSSH private key: magic, three names, a count, so many keys, and the private part."""
    if not data.startswith(MAGIC):
        return None
    at, left = len(MAGIC), 3
    counted = False
    while left:
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        left -= 1
        if not left and not counted:
            if at + 4 > len(data):
                return None
            counted, left = True, int.from_bytes(data[at : at + 4], "big") + 1
            at += 4
    return at if at <= len(data) else None


def is_key(data: bytes | None) -> bool:
    """True if the bytes parse whole as a private key."""
    return bool(data) and (is_der_key(data) or is_encrypted_key(data) or openssh_size(data) == len(data))


def der_size(head: bytes) -> int | None:
    """Bytes of the DER sequence that begins with ``head``, if a key can begin so."""
    if len(head) < 8 or head[0] != 0x30:
        return None
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    if k > 3 or head[1] == 0x80:
        return None
    size = 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])
    return size if size >= LEAST_BYTES and head[2 + k] in (0x02, 0x30) else None


def gathered(text: str, at: int, count: int, run: re.Pattern) -> tuple[str, int]:
    """Up to ``count`` characters of ``run`` from ``at`` on, line breaks left out, and where they end."""
    parts, end = [], at
    while count and (m := run.match(text, at, at + count)):
        parts.append(m[0])
        count -= len(m[0])
        end = m.end()
        wrap = WRAP.match(text, end) if count else None
        if not wrap:
            break
        at = wrap.end()
    return "".join(parts), end


def key_at(text: str, at: int, base: int) -> int | None:
    """Where the key ends that begins at ``at`` in base 64 or 16; None if none does."""
    run, bits = (RUN64, 6) if base == 64 else (RUN16, 4)
    read = (lambda t: decoded(t)) if base == 64 else (lambda t: bytes.fromhex(t[: len(t) & ~1]))
    size = der_size(read(gathered(text, at, 16, run)[0]) or b"")
    if size is None:
        body, _ = gathered(text, at, len(text), run)
        size = openssh_size(read(body[: len(body) - (len(body) % 4 == 1)]) or b"") if text.startswith(("b3Bl", "6f70", "6F70"), at) else None
    if size is None:
        return None
    need = (8 * size + bits - 1) // bits
    body, end = gathered(text, at, need, run)
    if len(body) < need or not is_key((read(body) or b"")[:size]):
        return None
    return PAD.match(text, end).end() if base == 64 else end


def is_armoured(label: str, body: str) -> bool:
    """True if the lines between a key's armour parse as that key."""
    body = body.replace("\\r", "").replace("\\n", "\n")
    head, blank, rest = body.partition("\n\n")
    if not blank or ":" not in head:
        head, rest = "", body
    data = decoded(rest)
    if is_key(data):
        return True
    return "ENCRYPTED" in head and "DEK-Info" in head and data is not None and len(data) >= LEAST_BYTES and len(data) % 8 == 0


def is_signed_token(header: str, body: str) -> bool:
    """True if the header decodes to a JSON object that names an algorithm and the body to JSON."""
    try:
        head = json.loads(decoded(header) or b"")
        json.loads(decoded(body) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def base_spans(text: str) -> list[Span]:
    """Assignments, access ids and hexadecimal runs, leftmost and without overlap within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return ordered(out)


def confirmed_spans(text: str, deeper: bool = True) -> list[Span]:
    """Signed tokens and keys whose decoded structure parses; with ``deeper`` also long runs that decode to a text with some."""
    out: list[Span] = []
    if "." in text:
        at = 0
        for m in TOKEN.finditer(text):
            if m.start() >= at and is_signed_token(m[1], m[2]):
                at = m.end(3)
                out.append(("jwt", m.start(), at))
    if "-----BEGIN " in text:
        at = 0
        for m in ARMOR.finditer(text):
            mark = f"-----END {m[1]}-----"
            end = text.find(mark, m.end()) if m.start() >= at else -1
            if end >= 0 and is_armoured(m[1], text[m.end() : end]):
                at = end + len(mark)
                out.append(("pem", m.start(), at))
    armoured = list(out)
    for kind, pattern, base in (("key", BLOB, 64), ("hexkey", HEX_BLOB, 16)):
        at = 0
        for m in pattern.finditer(text):
            if m.start() >= at and (end := key_at(text, m.start(), base)) and not any(a <= m.start() < b for _, a, b in armoured):
                at = end
                out.append((kind, m.start(), end))
    if deeper:
        taken = [(a, b) for _, a, b in out]
        for m in NESTED.finditer(text):
            if not any(a < m.end() and m.start() < b for a, b in taken) and holds_secret(m[0]):
                out.append(("nested", *m.span()))
    return ordered(out)


def holds_secret(run: str) -> bool:
    """True if a run decodes, at some alignment, to a text with a confirmed secret."""
    plain = re.sub(r"\s+", "", run)
    bodies = [decoded(plain[k : k + (len(plain) - k) // 4 * 4]) for k in range(4)]
    if RUN16.fullmatch(plain):
        bodies += [bytes.fromhex(plain[k : k + (len(plain) - k) // 2 * 2]) for k in range(2)]
    return any(confirmed_spans(b.decode("latin-1"), False) for b in bodies if b)


def ordered(spans: list[Span]) -> list[Span]:
    """By start, then by kind as listed."""
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each maximal run of overlapping spans replaced by one mark."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], REDACTED]
        at = end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {"assign": [], "access": [], "hex": []}
        digests, spans = [], []
        for text in texts_of(batch, text_column):
            base = base_spans(text)
            for k, n in counts.items():
                n.append(sum(s[0] == k for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(ordered(base + confirmed_spans(text))))
        columns = [batch.column(id_column), *[pa.array(n, pa.int64()) for n in counts.values()], pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        return pa.RecordBatch.from_arrays(columns, [id_column, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_batches(docs.select(id_column, text_column), rows, schema)


def redact(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span that ``scan`` reports replaced by a mark, and the length brought up to date."""
    names = docs.columns
    schema = StructType(list(docs.schema))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = names.index(text_column)
        new = [t and redacted(t, base_spans(t) + confirmed_spans(t)) for t in batch.column(at).to_pylist()]
        columns = [*batch.columns]
        columns[at] = pa.array(new, pa.string())
        return pa.RecordBatch.from_arrays(columns, names)

    done = in_arrow(docs, lambda batches: map(rows, batches), schema)
    if length_column and length_column in names:
        done = done.withColumn(length_column, F.length(text_column).cast(docs.schema[length_column].dataType))
    return done


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLES: dict[str, str] = {}

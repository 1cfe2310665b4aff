"""Operators on texts against brute force: tokens, pieces, secrets, quality, near-duplicates, packing."""

import base64
import bisect
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from telemetrica.llm import near_duplicates, packing, quality_rules, secrets, sentence_pieces, token_counts
from telemetrica.llm.bytebpe import encode_ids
from telemetrica.llm.common import words_of

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(BYTES)
BITS = st.lists(st.sampled_from([" ", "  ", "\n", "the", "ing", "b'", "'re", "'s", "<|endoftext|>", "<|end", "é", "\t", "1", "!", "東", "😀", ".", "\x85", "▁"]), max_size=10).map("".join)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens string"


def docs_of(spark, texts):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x") for i, t in enumerate(texts)], DOCS)


def rows_by(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@settings(max_examples=200, deadline=None)
@given(BITS)
def test_prefix_counts_are_those_of_encoding_each_prefix(text):
    found = token_counts.counter(BYTES).tables([text])[0]
    wanted = [len(e.ids) for e in LIBRARY.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]
    assert list(found) == wanted


@settings(max_examples=200, deadline=None)
@given(BITS)
def test_chunked_ids_are_the_library_s(text):
    assert np.frombuffer(encode_ids([text], BYTES)[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(BITS)
def test_pieces_have_parity(text):
    codec = sentence_pieces.codec(PIECES)
    ids = codec.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == sentence_pieces.peer(PIECES).encode(text)
    assert codec.decode([ids])[0] == codec.library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False).removeprefix(" ")
    if "▁" not in text:
        assert codec.decode([ids])[0] == text


def test_longest_fitting_prefix():
    counts = token_counts.counter(BYTES).tables(["the theatre, the the"])[0]
    k = token_counts.fitting_prefix(counts, 3)
    assert counts[k] <= 3 and all(c > 3 for c in counts[k + 1 :])
    assert token_counts.fitting_prefix(counts, -1) == 0


def test_token_counts_of_odd_rows(spark):
    long = "word " * 30_000
    texts = [None, "", "same", "same", long, "<|endoftext|>"]
    found = rows_by(token_counts.count_tokens(docs_of(spark, texts), BYTES))
    for i, t in enumerate(texts):
        assert found[i]["n_tokens"] == len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
        assert found[i]["n_bytes"] == len((t or "").encode()) and found[i]["over_limit"] == (found[i]["n_tokens"] > 1024)
    assert token_counts.count_tokens(docs_of(spark, []), BYTES).count() == 0


def test_unigram_models_are_rebuilt(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, True
    model.normalizer_spec.name = "identity"
    for piece, score, kind in [("<unk>", 0, 2), *[(f"<0x{b:02X}>", -20, 6) for b in range(256)], ("▁", -2, 1), ("▁a", -1, 1), ("a", -2, 1), ("b", -2.5, 1), ("ab", -2.2, 1), ("▁b", -3, 1)]:
        model.pieces.add(piece=piece, score=score, type=kind)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    own, theirs = sentence_pieces.PieceCodec(str(path), 1), sentencepiece.SentencePieceProcessor(model_file=str(path))
    for text in ("ab ab", " a  b ", "abba", "", "a é b"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == theirs.encode(text), text


def test_piece_rows(spark):
    found = rows_by(sentence_pieces.encode(docs_of(spark, [None, "", "a b", "a b", "x" * 5000]), PIECES))
    assert all(r["parity"] and r["round_trip"] for r in found.values()) and found[0]["n_tokens"] == 0
    assert sentence_pieces.encode(docs_of(spark, []), PIECES).count() == 0


# --- secrets ---------------------------------------------------------------------------------------


def der(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | ((size.bit_length() + 7) // 8)]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


RSA = der(0x30, b"".join(der(2, bytes([1] * n)) for n in (1, 64, 3, 64, 32, 32, 32, 32, 32)))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, bytes(32))))


def test_structures_are_confirmed_and_lookalikes_are_not():
    key = base64.b64encode(RSA).decode()
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', b'{"sub":1}', bytes(32)))
    text = f"{key} {token} {PKCS8.hex()} {base64.b64encode(bytes(range(90))).decode()}"
    kinds = Counter(k for k, _, _ in secrets.confirmed_spans(text))
    assert kinds["key"] == 1 and kinds["jwt"] == 1 and kinds["hexkey"] == 1
    assert secrets.is_key(PKCS8) and not secrets.is_key(RSA[:-1]) and not secrets.is_key(b"\x30\x03\x02\x01\x01")
    assert secrets.confirmed_spans(token.replace(token[:8], "AAAAAAAA")) == []


def openssh():
    field = lambda b: len(b).to_bytes(4, "big") + b
    return secrets.MAGIC + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"ssh-ed25519" * 4) + field(bytes(range(100)))


def plain_keys(text):
    """Shortest key in base64 at each position, leftmost first, by trying every end."""
    out, at = [], 0
    while at < len(text):
        m = re.compile("[A-Za-z0-9+/_-]*").match(text, at)
        for end in range(at + 48, m.end() + 1):
            data = secrets.decoded(text[at:end])
            # the last character may hold spare bits only
            if data and secrets.is_key(data) and (len(data) * 8 + 5) // 6 == end - at:
                while end < len(text) and text[end] == "=":
                    end += 1
                out.append(("key", at, end))
                at = end - 1
                break
        at += 1
    return out


def test_keys_at_any_place_of_a_run_against_trying_all():
    rng = random.Random(11)
    bodies = [base64.b64encode(x).decode() for x in (RSA, PKCS8, openssh(), RSA[:-1], bytes(range(90)))]
    glue = ["x", "/", "ab+", " ", "\n", "MII", "Mab", "'", "=", "word. "]
    for _ in range(60):
        text = "".join(rng.choice(glue) for _ in range(rng.randint(0, 4))) + rng.choice(bodies) + rng.choice(glue) + rng.choice(bodies).rstrip("=") + rng.choice(["", "Z", " end"])
        assert [s for s in secrets.confirmed_spans(text, False) if s[0] == "key"] == plain_keys(text), text


def test_wrapped_armoured_and_nested_forms():
    key = base64.b64encode(RSA).decode()
    lines = "\n".join(key[k : k + 64] for k in range(0, len(key), 64))
    kinds = lambda t: [k for k, _, _ in secrets.confirmed_spans(t)]
    assert secrets.confirmed_spans(f"a {lines} b") == [("key", 2, 2 + len(lines))]
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----"
    assert kinds(pem) == ["pem"] and kinds(pem.replace("\n", "\\n")) == ["pem"] and kinds(pem.replace(lines, "A" * 64)) == []
    locked = "\n".join(["-----BEGIN RSA PRIVATE KEY-----", "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,00FF", "", base64.b64encode(bytes(64)).decode(), "-----END RSA PRIVATE KEY-----"])
    assert kinds(locked) == ["pem"]
    assert "nested" in kinds("data: " + base64.b64encode(pem.encode()).decode()) and "nested" in kinds("x" + base64.b64encode(b"k: " + pem.encode()).decode().rstrip("="))
    assert kinds("f" + RSA.hex()) == ["hexkey"] and kinds(RSA.hex().upper() + "0") == ["hexkey"] and kinds(RSA.hex()[:-2]) == []
    sealed = der(0x30, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d")) + der(4, bytes(64)))
    assert kinds("k=" + base64.b64encode(sealed).decode()) == ["key"]
    assert kinds("MIIMIIMII" * 2000 + " e" * 1000 + "ey" * 20_000) == []


def test_base_spans_against_plain_scanning():
    rng = random.Random(4)
    bits = ["password", "API_key", "apikey", "Token", " ", ":", "=", '"', "'", "abcdefgh", "short", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "0f", "\n", "ſecret"]
    for _ in range(500):
        text = "".join(rng.choice(bits) for _ in range(12))
        wanted = []
        for kind, pattern, size in (("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 8), ("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)):
            for m in re.finditer(pattern, text):
                if len(m[2] if kind == "assign" else m[0]) >= size:
                    wanted.append((kind, *m.span()))
        assert secrets.base_spans(text) == secrets.ordered(wanted)


def test_secret_rows_and_redaction(spark):
    texts = [None, "", 'token = "abcdefgh12" and ' + "ab" * 20, "clean text", "clean text"]
    found = rows_by(secrets.scan(docs_of(spark, texts)))
    assert (found[2]["n_assign"], found[2]["n_hex"], found[2]["spans"]) == (1, 1, "assign:0:19,hex:25:65")
    assert found[2]["base_sha256"] == hashlib.sha256(b"assign:0:19,hex:25:65").hexdigest() and found[0]["spans"] == ""
    clean = rows_by(secrets.redact(docs_of(spark, texts)))
    assert clean[2]["text"] == '[REDACTED]" and [REDACTED]' and clean[2]["n_chars"] == len(clean[2]["text"])
    assert clean[3]["text"] == "clean text" and clean[0]["text"] is None
    assert secrets.scan(docs_of(spark, [])).count() == 0 and secrets.redact(docs_of(spark, [])).count() == 0
    long = "word " * 200_000 + "AKIA" + "B" * 16
    assert rows_by(secrets.scan(docs_of(spark, [long])))[0]["spans"] == "access:1000000:1000020"


# --- quality ---------------------------------------------------------------------------------------


def plain_repeats(words):
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    return len({k + j for k, w in enumerate(windows) if w in often for j in range(5)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeated_words(words):
    assert quality_rules.n_repeat_words(words) == plain_repeats(words)


def test_words_split_at_ascii_space_only():
    assert words_of("a b c\x85d\x1ce\x0bf") == ["a b", "c\x85d\x1ce", "f"]


def test_chi_square():
    assert quality_rules.chi_square_quantile(0.95, 3) == pytest.approx(7.8147, abs=1e-4)


def test_outliers_go_and_clean_rows_stay(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    clean = [" ".join(word() for _ in range(80)) for _ in range(400)]
    junk = [" ".join(word() + "###" for _ in range(80)) for _ in range(30)] + [" ".join(word().upper() + "!!" for _ in range(80)) for _ in range(30)]
    odd = [None, "", "a b c", "same words " * 60]
    texts = clean + junk + odd
    found = rows_by(quality_rules.assess(docs_of(spark, texts)))
    assert all(found[i]["kept"] for i in range(400)) and not any(found[i]["kept"] for i in range(400, len(texts)))
    assert [found[i]["base_failed"] for i in range(460, 464)] == [True] * 4 and found[463]["n_repeat_words"] == 120
    kept = quality_rules.keep(docs_of(spark, texts))
    assert kept.columns == docs_of(spark, []).columns and kept.count() == 400
    assert quality_rules.assess(docs_of(spark, [])).count() == 0


def test_small_groups_are_judged_by_all_documents(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    clean = [" ".join(word() for _ in range(80)) for _ in range(260)]
    junk = [" ".join(word() + "###" for _ in range(80)) for _ in range(6)]
    rows = [(i, t, "en" if i < 240 else None if i % 2 else "xx", "s") for i, t in enumerate(clean + junk)]
    found = rows_by(quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert all(r["distance"] is not None and r["kept"] == (i < 260) for i, r in found.items()) and len(found) == 266
    tiny = spark.createDataFrame(rows[-26:], "doc_id long, text string, lang string, source string")
    assert {i for i, r in rows_by(quality_rules.assess(tiny)).items() if r["kept"]} == set(range(240, 260))


def test_estimates_have_the_least_determinant(spark):
    """The distributed steps against plain concentration of exact shares from many random starts."""
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(0.3, 0.15, (500, quality_rules.D)))
    x[:, 1] = np.abs(x[:, 0] + rng.normal(0, 0.02, 500))
    x[:110] += 1
    rows = spark.createDataFrame([("g", [float(v) for v in r]) for r in x], "g string, x array<double>")
    fit = quality_rules.estimates(rows, True).first()
    h, best = int(quality_rules.SHARE * 500), None
    for _ in range(60):
        near = x[rng.choice(500, quality_rules.D + 1, replace=False)]
        for _ in range(40):
            mean, cov = near.mean(0), quality_rules.CONSISTENT * np.cov(near.T, bias=True) + np.diag(np.square(quality_rules.FLOOR))
            near = x[np.argsort(np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean), kind="stable")[:h]]
        if best is None or np.linalg.slogdet(cov)[1] < best[0]:
            best = np.linalg.slogdet(cov)[1], mean, np.linalg.inv(cov)
    inverse = np.zeros((quality_rules.D, quality_rules.D))
    for (i, j), v in zip(quality_rules.PAIRS, fit["p"], strict=True):
        inverse[i, j] = inverse[j, i] = v
    far = [np.einsum("ni,ij,nj->n", x - m, p, x - m) > quality_rules.CUT for m, p in ((np.array(fit["m"]), inverse), best[1:])]
    assert abs(fit["d"] - best[0]) < 0.1 and np.allclose(fit["m"], best[1], atol=0.02) and np.allclose(np.diag(inverse), np.diag(best[2]), rtol=0.15)
    assert (far[0] == far[1]).all() and far[0][:110].all() and not far[0][110:].any()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b!", "#", "$x", "\n", " ", "\t", "\x0b", "é", "\x85", "||", "A"]), max_size=60).map("".join))
def test_base_counts_against_plain_ones(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wanted = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), plain_repeats(words))
    assert quality_rules.statistics(text)[:5] == wanted


# --- near-duplicates -------------------------------------------------------------------------------


def plain_sets(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def plain_components(sets):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def test_components_are_those_of_all_pairs(spark):
    rng = random.Random(9)
    words = ["w%d" % k for k in range(500)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 90))] for _ in range(40)]
    texts = [None, "", " ", "Two words", "two WORDS", "one"]
    for b in base:
        for _ in range(rng.randint(1, 6)):
            w = list(b)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    # a crowd around one text, of which some are far from all others
    crowd = [rng.choice(words) for _ in range(150)]
    for k in range(200):
        w = list(crowd)
        for _ in range(k % 12):
            w[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(w))
    for n in (4, 5):
        sets = plain_sets(texts, n)
        found = rows_by(near_duplicates.cluster(docs_of(spark, texts), words=n))
        assert [found[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
        assert [found[i]["component_id"] for i in range(len(texts))] == plain_components(sets)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.values())
    assert near_duplicates.cluster(docs_of(spark, [])).count() == 0


def test_crowds_are_whole_however_small_the_blocks(spark, monkeypatch):
    """A crowd at the edge of the similarity, its region dealt into many blocks, against all pairs."""
    rng = random.Random(12)
    words = ["w%d" % k for k in range(3000)]
    crowd = [rng.choice(words) for _ in range(200)]
    texts = ["other text of six words here"]
    for k in range(500):
        w = list(crowd)
        for _ in range(k % 14):
            w[rng.randrange(200)] = rng.choice(words)
        texts.append(" ".join(w))
    wanted = plain_components(plain_sets(texts, 5))
    assert len(set(wanted)) > 20
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", 3000)
    found = rows_by(near_duplicates.cluster(docs_of(spark, texts)))
    assert [found[i]["component_id"] for i in range(len(texts))] == wanted


def test_every_divided_pair_meets_in_one_block(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    rows = spark.createDataFrame([(t, 5, n) for t in (0, 1) for n in range(40)] + [(0, 6, 50), (0, 6, 51)], "tree int, near long, node long")
    classes = spark.createDataFrame([(n, 100) for n in range(60)], "node long, size long")
    labels = spark.createDataFrame([(n, 0) for n in range(22)] + [(50, 7), (51, 7)], "node long, label long")
    blocks = {}
    for r in near_duplicates.divided_blocks(rows, classes, labels).collect():
        blocks.setdefault((r["tree"], r["near"], r["i"], r["j"]), {True: [], False: []})[r["probed"]].append((r["node"], r["label"], r["other"]))
    assert all(near == 5 for _, near, _, _ in blocks)
    for tree in (0, 1):
        met = Counter()
        for key, sides in blocks.items():
            if key[0] == tree:
                met.update((min(a, b), max(a, b)) for a, la, _ in sides[False] for b, lb, other in sides[True] if la != lb and (a < b or not other))
        assert met == Counter((a, b) for a in range(40) for b in range(a + 1, 40) if b >= 22)


def test_ranges_lose_no_region(spark):
    """Rows at the ends of ranges are kept, so that a region cut by a range's end stays whole."""
    rng = random.Random(2)
    rows = [(0, 1, rng.randrange(100), n) for n in range(300)] + [(1, 100 + n, 0, n) for n in range(50)]
    df = spark.createDataFrame(rows, "tree int, near long, far long, node long")
    found = near_duplicates.neighbours(df).collect()
    assert {r["node"] for r in found if r["tree"] == 0} == set(range(300)) and sum(r["tree"] == 0 for r in found) == 300
    assert sum(r["tree"] == 1 for r in found) <= 2 * spark.sparkContext.defaultParallelism


def test_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = spark.createDataFrame([(None, a), (1, a), (1, b), (2, b), (3, "c d e f g")], "doc_id long, text string")
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near_duplicates.cluster(rows).collect()}
    assert found[(None, 26)] is None and found[(2, 26)] == 1 and found[(3, 1)] == 3
    long = " ".join(f"v{k}" for k in range(200_000))
    clash = spark.createDataFrame([(1, long, 0, "x"), (2, long + " end", 1, "y")], "doc_id long, text string, label long, _kept string")
    assert [r["component_id"] for r in near_duplicates.cluster(clash).collect()] == [1, 1]
    assert near_duplicates.keep(clash).collect()[0]["_kept"] == "x"


# --- packing ---------------------------------------------------------------------------------------


def test_histogram_plan_places_every_piece_once():
    rng = random.Random(2)
    counts = Counter(rng.randint(1, 64) for _ in range(3000))
    bins = packing.best_two_fit(counts, 64)
    used = Counter()
    for lengths, times in bins:
        assert sum(lengths) <= 64 and times > 0
        used.update({n: k * times for n, k in Counter(lengths).items()})
    assert used == counts
    # no worse than best-fit decreasing, piece by piece
    gaps = []
    for n in sorted(counts.elements(), reverse=True):
        k = bisect.bisect_left(gaps, n)
        bisect.insort(gaps, (gaps.pop(k) if k < len(gaps) else 64) - n)
    assert sum(t for _, t in bins) <= len(gaps)


def test_two_smaller_pieces_replace_the_smallest():
    left = np.zeros(101, np.int64)
    left[60] = left[30] = left[20] = left[19] = 1
    assert packing._two_for_smallest([60, 30], left, 100) == [60, 20, 19]


def test_packed_rows(spark):
    texts = [None, "", "same text", "same text", "word " * 3000, "<|endoftext|> x"] + ["a b c " * k for k in range(1, 60)]
    parts = packing.pieces(docs_of(spark, texts), BYTES, 128)
    got = packing.pack(parts.cache(), 128).collect()
    ids = {i: [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    bins = {}
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, x in ids.items():
        cuts = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == i)
        assert [c[0] for c in cuts] == list(range(len(cuts))) and sum(c[2] for c in cuts) == len(x)
        assert all(c[2] == 128 for c in cuts[1:]) and (len(x) > 128 or len(cuts) == 1)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(packing.pieces(docs_of(spark, []), BYTES)).count() == 0

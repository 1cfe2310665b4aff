"""Chats, pages, vectors, toxicity and the pipeline against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telemetrica.llm import additive_search, chat_format, html_extract, toxicity

EVENTS = "conv_id long, seq long, kind string, message long, role string, text string, turns string"


def log_of(spark, events):
    return spark.createDataFrame([(*e, "clash") for e in events], EVENTS)


def plain_fold(events):
    """One conversation's events in order of sequence, one by one."""
    kept = {}
    for _, _, kind, message, role, text in sorted(events, key=lambda e: (e[1], e[2] == "delta")):
        if kind in ("edit", "regenerate"):
            kept = {m: v for m, v in kept.items() if m <= message}
        if kind == "delta" and message in kept:
            kept[message] = (kept[message][0], kept[message][1] + (text or ""))
        else:
            kept[message] = (role or "", text or "")
    return [kept[m] for m in sorted(kept)]


def test_fold_matches_replay(spark):
    rng = random.Random(5)
    events = []
    for conv in range(40):
        for seq in range(rng.randint(1, 14)):
            events.append((conv, seq, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.randint(0, 3), rng.choice(["user", "assistant", None]), rng.choice(["a", "b&", "<|im_end|>", None, ""])))
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.render(chat_format.fold(log_of(spark, events)))).collect()}
    for conv in range(40):
        wanted = plain_fold([e for e in events if e[0] == conv])
        row = back[conv]
        assert [(t["role"], t["text"]) for t in row["turns"]] == wanted
        spoken = [row["formatted"][s["start"] : s["start"] + s["length"]] for s in row["loss_spans"]]
        assert [x.replace("&lt;|", "<|").replace("&amp;", "&") for x in spoken] == [t for r, t in wanted if r == "assistant"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="<|&;ltamp\nx>nl", max_size=12), min_size=1, max_size=6))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    row = df.select(chat_format.plain(chat_format.escaped(F.col("t"))).alias("a"), chat_format.plain_role(chat_format.escaped_role(F.col("t"))).alias("b"), chat_format.escaped(F.col("t")).alias("e")).collect()
    assert [r["a"] for r in row] == texts and [r["b"] for r in row] == texts and not any("<|" in r["e"] for r in row)


def test_query_with_nulls_ties_and_probe(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "hi <|im_start|>"), (1, 1, "assistant", "hi"), (None, 0, "user", "lost"), (2, None, "system", "s")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: r for r in chat_format.op6_chat_format(spark, str(tmp_path)).collect()}
    spoken = "user\n\nassistant\nhi\nassistant\nhi <|im_start|>\n"
    assert found[1]["turns_sha256"] == hashlib.sha256(spoken.encode()).hexdigest() and found[1]["n_turns"] == 3
    assert found[1]["loss_sha256"] == hashlib.sha256(b"hihi <|im_start|>").hexdigest()
    log = chat_format.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["kind"] for r in log.collect()} == {"message", "delta", "edit", "regenerate"} and chat_format.render(chat_format.fold(log.limit(0))).count() == 0
    long = [(7, k, "assistant" if k % 2 else "user", "é<|im_end|>" * 20_000) for k in range(6)]
    whole = chat_format.read_back(chat_format.render(chat_format.fold(chat_format.conversation_events(spark.createDataFrame(long, "conv_id long, turn long, role string, text string"))))).first()
    assert [t["text"] for t in whole["turns"]] == [r[3] for r in long]
    assert found[-1]["n_turns"] == 2 and found[-1]["loss_chars"] == len(chat_format.PROBE) and None in found and found[2]["loss_chars"] == 0


# --- pages -----------------------------------------------------------------------------------------

PAGE = (
    "<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header>top</header><nav><ul><li>menu</ul></nav>"
    "<div class='cookie-notice'>ok?</div><div class=ad>buy</div><article><h1>Head &amp; tail</h1><p>One  <b>bold</b>\n two&nbsp;{n}.<p>Open <i>para<br>next"
    "<section class=comments>rude</section></article><aside>side</aside><form>f<input></form><footer>foot</footer></body></html>"
)


def test_article_without_the_rest():
    assert html_extract.extract(PAGE.format(n=7)) == "Head & tail\nOne bold two 7.\nOpen para\nnext"
    for odd in ("", "<", "<p", "<p class=\"x>open quote", "<!-- never closed", "</p></p>", "a<b>" * 3000, "&#x41;&bogus;"):
        html_extract.extract(odd)
    assert html_extract.extract("&#x41;&bogus; <3") == "A&bogus; <3"


def test_tree_leaves_out_what_all_pages_share(spark):
    pages = [(k, "http://h.example/%d" % k, f"<body><div id=top>Same line</div><div id=text><p>own words {k} {k * k}</p></div><div id=end>Fixed</div></body>") for k in range(20)]
    pages += [(99, "http://h.example/art", "<body><article><p>Same line</p><p>own</p></article></body>"), (100, None, None), (101, "nonsense", "<p>alone</p>"), (101, "nonsense", "<p>alone</p>")]
    df = spark.createDataFrame([(*p, 5) for p in pages], "page_id long, url string, html string, n_chars int")
    found = html_extract.main_text(df).collect()
    by = {r["page_id"]: r for r in found}
    assert all(by[k]["text"] == f"own words {k} {k * k}" for k in range(20)) and len(found) == len(pages)
    assert by[99]["text"] == "Same line\nown" and by[100]["text"] == "" and by[101]["text"] == "alone" and by[101]["n_chars"] == 5
    assert html_extract.main_text(df.limit(0)).count() == 0
    deep = "<div>" * 20_000 + "core" + "</div>" * 20_000 + "<p>long " + "word " * 100_000
    clash = spark.createDataFrame([(1, "u", deep, "x", 3)], "page_id long, url string, html string, host string, low int")
    assert html_extract.main_text(clash).collect()[0]["text"] == "core\nlong " + ("word " * 100_000).strip()


def plain_ratings(pages):
    """A host's ratings from its pages, path by path, without any of the distributed sums."""
    seen: dict = {}
    for page in pages:
        for path, above, within, shown, said in html_extract.variants(page):
            seen.setdefault(path, []).append((above, within, shown, said))

    def entropy(values):
        n = len(values)
        return -sum(values.count(v) / n * np.log(values.count(v) / n) for v in set(values)) / np.log(n) if n > 1 else 1.0

    def importance(path):
        rows = seen[path]
        inner = [c for c, r in seen.items() if r[0][0] == path]
        content = entropy([r[3] for r in rows])
        if inner:
            content = max(content, sum(importance(c) * len(seen[c]) for c in inner) / sum(len(seen[c]) for c in inner))
        own = (1 - html_extract.BELOW) * entropy([r[2] for r in rows]) + html_extract.BELOW * content
        return (len(rows) * own + html_extract.DOUBT) / (len(rows) + html_extract.DOUBT)

    def most(path):
        heard = [c for c, r in seen.items() if r[0][0] == path and len(r) >= html_extract.HEARD * len(seen[path])]
        return max([importance(path), *map(most, heard)])

    low = {p for p in seen if most(p) < html_extract.LEAST_IMPORTANCE}
    high = {p for p, r in seen.items() if not r[0][1] and importance(p) - html_extract.DOUBT / (len(r) + html_extract.DOUBT) >= html_extract.HIGH_IMPORTANCE}
    return {p for p in low if seen[p][0][0] not in low}, high


def test_tree_against_plain_ratings(spark):
    rng = random.Random(3)
    block = lambda k: rng.choice(["<div id=a>Same</div>", f"<div class=b><p>own {k}</p></div>", "<ul><li>x<li>y</ul>", "<section><b>s</b></section>", f"<i>{k % 3}</i>"])
    pages = []
    for host, n in (("one.example", 30), ("two.example", 7), ("few.example", 2)):
        for k in range(n):
            inner = "".join(block(k) for _ in range(rng.randint(1, 5)))
            pages.append((f"https://{host}/{k}", f"<body><header>H</header>{inner}<article><p>text {k}</p><div class=t>Team</div></article>{'<div>' * 80}deep{'</div>' * 80}</body>"))
    df = spark.createDataFrame(pages, "url string, html string")
    found = {r["host"]: (set(r["low"]), set(r["high"])) for r in html_extract.tree(df).collect()}
    for host in ("one.example", "two.example", "few.example"):
        assert found[host] == plain_ratings([h for u, h in pages if host in u]), host
    assert found["one.example"][0] and not found["few.example"][0]


def test_tree_decides_inside_and_beside_articles(spark):
    page = "<body><div id=lead>Lead of {k}</div><div id=end>Fixed</div><article><p>own words {k}</p><p>Shared passage</p><div class=team><b>Our</b> team</div></article></body>"
    pages = [(k, f"http://h.example/{k}", page.format(k=k)) for k in range(20)]
    pages += [(50 + k, f"http://same.example/{k}", "<article><p>All alike</p></article>") for k in range(20)]
    found = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(found[k] == f"Lead of {k}\nown words {k}\nShared passage" and found[50 + k] == "All alike" for k in range(20))


# --- vectors ---------------------------------------------------------------------------------------


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[200:260] = x[3]
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)]
    odd = [(1000, None, "c"), (1001, [0.0] * 16, "c"), (1002, [float("nan")] + [1.0] * 15, "c"), (1003, [None] + [1.0] * 15, "c"), (1004, [1.0], "c"), (None, [1.0] * 16, "c"), rows[5]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string")
    found = additive_search.search(df, F.col("id") % 100 == 0).collect()
    hit = total = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        wanted = [i for _, i in sorted(zip(d, range(600), strict=True)) if i != q][:10]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in got)
        hit, total = hit + len(set(wanted) & {g[1] for g in got}), total + 10
        if q == 200:
            assert [g[1] for g in got] == [3, *range(201, 210)]
    assert hit / total >= 0.9
    assert additive_search.search(df.limit(0), F.col("id") % 100 == 0).count() == 0
    assert additive_search.search(df.where("vec_id in (0, 1)"), F.col("id") % 100 == 0).count() == 1


def test_short_lists_find_the_nearest_of_many(spark, monkeypatch):
    """A list of one in forty of the rows, from several blocks, against brute force; lengths are searched apart."""
    monkeypatch.setattr(additive_search, "BLOCK_CODES", 1000)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    x = (centres[rng.integers(0, 60, 4000)] + 0.5 * rng.normal(size=(4000, 24))).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000 + i, [float(i), 1.0]) for i in range(0, 300, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found: dict = {}
    for r in additive_search.search(df, F.col("id") % 100 == 0, shortlist=100).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 4000, 100):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        hit += len(set(np.argsort(d, kind="stable")[:10].tolist()) & found[q])
    assert hit / 400 >= 0.9
    assert found[5100] == {5000 + i for i in (0, 20, 40, 60, 80, 120, 140, 160, 180, 200)} and len(found) == 40 + 3
    assert additive_search.block_list(1024, 1) == 1024 and additive_search.block_list(1024, 100) < 50


# --- toxicity --------------------------------------------------------------------------------------


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    word, grams = rng.integers(0, 50, (3, 6)), rng.integers(-1, 60, (3, 6, 4))
    odds, mask = rng.normal(size=(3, 6, 2)), np.ones((3, 6))
    mask[1, 4:] = 0
    target, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.3, 0.2])
    _, grads = net.gradients(word, grams, odds, mask, target, weight)
    for name in ("Wf", "Ub", "A", "v", "o", "cf", "q"):
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        values = []
        for sign in (1, -1):
            kept = net.p[name][at]
            net.p[name][at] = kept + sign * 1e-2
            values.append(net.gradients(word, grams, odds, mask, target, weight)[0])
            net.p[name][at] = kept
        assert grads[name][at] == pytest.approx((values[0] - values[1]) / 2e-2, rel=0.05, abs=2e-4)


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 47, 48, 49, 500):
        covered = {k for a in toxicity.starts(n) for k in range(a, a + toxicity.WINDOW) if k < n}
        assert covered == set(range(n))


def test_ends_of_long_words_are_read():
    rng = random.Random(8)
    docs = [[" ".join([f"w{rng.randrange(200)}" for _ in range(20)] + ["worthlessidiot"] * (k % 2))] for k in range(200)]
    scorer = toxicity.Scorer(toxicity.fit(docs, [k % 2 for k in range(200)]))
    front = "w1 w2 w3 perfectlynormalprefixof"
    clean, glued = scorer.scores([front + "everydaywriting", front + "worthlessidiot"])
    strongest = [scorer.model.gram_odds[toxicity.word_row(f"perfectlynormalprefixof{end}")[2]].max() for end in ("everydaywriting", "worthlessidiot")]
    assert glued > clean and strongest[0] < 1 < 3 < strongest[1]
    row = toxicity.word_row("東" * 40 + "idiot")[2]
    assert zlib.crc32(b"diot") % toxicity.GRAM_ODDS in row and len(row) == 2 * 125


def test_scores_are_those_of_each_window_alone():
    """Batched scoring of whole texts against every window by itself, with grams padded row by row."""
    rng = random.Random(8)
    word = lambda: rng.choice(["vile", "fine", "東京", "a", "x" * 40]) + str(rng.randrange(30))
    docs = [[" ".join(word() for _ in range(rng.randint(1, toxicity.WINDOW))) for _ in range(3)] for _ in range(60)]
    model = toxicity.fit(docs, [int("vile1 " in " ".join(d)) for d in docs])
    texts = ["", "!?", *[" ".join(word() for _ in range(n)) for n in (1, 31, 32, 33, 70, 500)]]
    found = toxicity.Scorer(model).scores(texts)
    for text, score in zip(texts, found, strict=True):
        words, logits = toxicity.tokens(text), []
        for a in toxicity.starts(len(words)):
            rows = [toxicity.word_row(w) for w in words[a : a + toxicity.WINDOW]]
            grams = np.full((1, len(rows), max(len(r[2]) for r in rows)), -1)
            for k, r in enumerate(rows):
                grams[0, k, : len(r[2])] = r[2]
            odds = np.array([[[model.odds[r[0]], max(model.gram_odds[g] for g in r[2])] for r in rows]], np.float32)
            x = model.net.inputs(np.array([[r[1] for r in rows]]), grams, odds)
            logits.append(model.net.logits({d: x @ model.net.p[f"W{d}"] + model.net.p[f"c{d}"] for d in "fb"}, np.ones((1, len(rows)), np.float32))[0])
        assert score == pytest.approx(model.calibrated(np.array(logits)), abs=1e-5)


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(3)
    bad, fine = [f"vile{k}" for k in range(6)], [f"w{k}" for k in range(300)]
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(fine) for _ in range(rng.randint(20, 150))]
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        texts.append(" ".join(words))
        labels.append((i, int(i % 4 == 0)))
    texts += [None, "", "x" * 50_000]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    table = spark.createDataFrame([*labels, (1, None), (2, 7), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, table)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    out = [i for i, _ in labels if found[i]["held_out"]]
    assert sum(found[i]["predicted"] == labels[i][1] for i in out) / len(out) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert found[400]["score"] == found[401]["score"] and found[400]["predicted"] == 0
    assert toxicity.keep(docs, model).columns == docs.columns
    again = docs.unionByName(docs.where("doc_id < 40"))
    assert toxicity.score(again, toxicity.train(again, table)).count() == again.count()
    none = toxicity.train(docs, table.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[0] + " tail", "en", "s", 1), (101, clean[1], "en", "s", 1), (102, "short", "en", "s", 5), (103, None, None, None, None)]
    rows += [(104, " ".join(word() for _ in range(30)) + ' token = "abcdefgh1234" end', "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept) == {*range(60), 104} and "abcdefgh1234" not in kept[104]
    assert {r["doc_id"] for r in out.collect()} == set(kept)

"""Decontamination, language identification, secrets and HTML."""

from __future__ import annotations

import random
import time

import numpy as np
from brute import contamination, secrets as slow_secrets
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import decontamination, html_text, language, registry, secrets
from folioscope.llm.fm_index import FMIndex, suffix_order


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=4), min_size=1, max_size=6))
def test_index_finds_all_occurrences(text, phrases):
    text = np.array(text, np.int64)
    assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = FMIndex(text, sample=3)
    rows = np.zeros((len(phrases), 4), np.int64)
    for i, p in enumerate(phrases):
        rows[i, : len(p)] = p
    low, high = index.search(rows, np.array([len(p) for p in phrases]))
    for p, lo, hi in zip(phrases, low, high, strict=True):
        expected = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(lo, hi)).tolist()) == expected


def test_contamination(spark, docs, corpus, nothing, monkeypatch):
    long = [t for _, t in corpus if t and len(t.split()) > 40]
    items = [(1, " ".join(long[3].split()[5:30])), (2, "Word"), (3, None), (4, ""), (10, " ".join(long[3].split()[5:30])), (10, "a b c"), (5, "never seen here at all")]
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(contamination(corpus, items))
    asked = lambda: sorted(tuple(r) for r in decontamination.judged(decontamination.find_contamination(docs, table)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert asked() == expected and sum(r[5] for r in expected) >= 2
    unnamed = spark.createDataFrame([*items[1:], (None, items[0][1]), (None, "Word")], "item_id long, text string")
    found = decontamination.judged(decontamination.find_contamination(docs, unnamed)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, found)) == expected_of(corpus, items)
    monkeypatch.setattr(decontamination, "BLOCK", 60)
    monkeypatch.setattr(decontamination, "SHARD", 500)
    assert asked() == expected
    assert decontamination.find_contamination(nothing, table).count() == 0
    assert all(not r["spans"] and not r["items"] for r in decontamination.find_contamination(docs, table.limit(0)).collect())
    carried = decontamination.find_contamination(docs, table, keep=("text", "key")).collect()
    assert {r["doc_id"]: r["text"] for r in carried} == dict(corpus)
    assert decontamination.cut_spans("One, two; three four.", [(1, 3)]) == "One,  four."


def expected_of(corpus, items):
    """Item 10 repeats item 1's text, and the unnamed items repeat those of 1 and 2: only item 1 is not named any more."""
    return sorted(contamination(corpus, items[1:]))


def test_language(spark, nothing):
    rng = random.Random(1)
    words = {"en": "the of and house river", "fr": "le de et maison rivière", "de": "der und das Haus Fluß"}
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randint(3, 60))), lang) for i in range(240) for lang in [("en", "fr", "de")[i % 3]]]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 34!", "fr"), (903, "the house", None), (None, "the river", "en"), (904, "½ ² ① Ⅳ", "en")]
    docs = spark.createDataFrame([(*r, 1, "k", 0.5) for r in rows], "doc_id long, text string, lang string, spot long, key string, score double")
    network = language.learn(docs.where(~language.held_out()), hidden=6)
    found = {r["doc_id"]: r for r in language.identify(docs, network, keep=("lang",)).withColumn("held", language.held_out()).collect()}
    held = [r for r in found.values() if r["held"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(held) > 40 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(found[k]["lang_pred"] == "und" and found[k]["score"] == 0 for k in (900, 901, 902, 904))
    assert found[903]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in found.values())
    assert language.learn(nothing) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(nothing, network).count() == 0


def test_every_language_is_learned(spark):
    words = "aa bb cc dd ee ff gg hh".split()
    rows = [(i, f"{words[i % 8]}{words[i // 8 % 9 % 8]} " * 30, f"l{i % 72:02}") for i in range(720)]
    network = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), hidden=4)
    assert network.names == sorted({r[2] for r in rows})


def slow_pooled(network, text):
    """The mean probabilities of one text, byte by byte, from the networks' plain states of each part with what leads up to it."""
    step, total = language.WINDOW - language.LEAD, 0
    for a in range(0, len(text), step):
        b = min(a + step, len(text))
        low, high = max(0, a - language.LEAD), min(len(text), b + language.LEAD)
        ahead = np.frombuffer(text[low:b], np.uint8)[:, None]
        back = np.frombuffer(text[a:high], np.uint8)[::-1][:, None]
        f = network.forward.states(ahead)[0][:, 0] @ network.forward.output
        g = (network.backward.states(back)[0][:, 0] @ network.backward.output)[::-1]
        scores = np.exp(f[a - low :] + g[: b - a] + network.bias)
        total = total + (scores / scores.sum(axis=1, keepdims=True)).sum(axis=0)
    return total / len(text)


def test_fast_reading_gives_the_states_probabilities():
    rng = np.random.default_rng(8)
    network = language.Network(["a", "b", "c"], 5, rng)
    network.bias[:] = rng.normal(size=3)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (1, 2, 31, 32, 33, 223, 224, 225, 255, 256, 257, 448, 449, 1000, 3001)]
    found = network.pooled(texts)
    assert np.allclose(found, [slow_pooled(network, t) for t in texts], atol=1e-5)
    assert np.allclose(network.pooled(texts[::-1])[::-1], found, atol=1e-6) and network.pooled([b""]).tolist() == [[0, 0, 0]]


def test_reading_takes_little_more_than_its_gates():
    """Time for a text against that of the tanh alone, of 36 values a byte and direction: about 20 times as long with gates in strided columns, 8 in planes."""
    rng = np.random.default_rng(9)
    network = language.Network(["a", "b", "c", "d"], 12, rng)
    text = bytes(rng.integers(0, 256, 224 * 4096).astype(np.uint8))
    values, room = rng.normal(size=(3, 1024, 12)).astype(np.float32), np.empty((3, 1024, 12), np.float32)

    def seconds(work):
        began = time.thread_time()
        work()
        return time.thread_time() - began

    gates = lambda: [np.tanh(values, out=room) for _ in range(2 * len(text) // 1024)]
    read, alone = (min(times) for times in zip(*((seconds(lambda: network.pooled([text])), seconds(gates)) for _ in range(5)), strict=True))
    assert read < 12 * alone, (read, alone)


def test_window_gradients():
    rng = np.random.default_rng(0)
    own = language.Direction.new(rng, 3, 2)
    symbols = rng.integers(0, 4, (5, 2))
    given = rng.normal(size=(5, 2, 3))
    value = lambda: float((own.states(symbols)[0] * given).sum())
    inputs, recurrent = own.gradients(symbols, own.states(symbols)[1], given)
    for array, gradient in ((own.inputs, inputs), (own.recurrent, recurrent)):
        for at in ((0, 1), (1, 4), (2, 7)):
            kept, step = array[at], 1e-2
            array[at] = kept + step
            up = value()
            array[at] = kept - step
            down = value()
            array[at] = kept
            assert abs((up - down) / (2 * step) - gradient[at]) < 2e-2


def test_secrets(spark, docs, corpus, nothing):
    ratios = secrets.train(secrets.samples(docs))
    many = spark.createDataFrame([(1, "token=abcdef " * 300), (2, "𝒳 secret: 'aaaaaaa' 😀 " + "0123456789abcdef" * 2), (3, "qX7f9Lk2pZ0vRt8sWy3bNm5c river-stone-house-light-model-data")], "doc_id long, text string")
    for table, rows in ((docs, dict(corpus)), (many, {r["doc_id"]: r["text"] for r in many.collect()})):
        for r in secrets.digests(secrets.scan(table, ratios)).collect():
            assert tuple(r)[1:5] == slow_secrets(rows[r["doc_id"]])
    spans = {r["doc_id"]: r["spans"] for r in secrets.digests(secrets.scan(many, ratios)).collect()}
    assert spans[3] == "random:0:24" and spans[1].startswith("assign:0:12,assign:13:25")
    cleaned = {r["doc_id"]: r["t"] for r in secrets.scan(many, ratios).select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert cleaned[3] == "[SECRET] river-stone-house-light-model-data" and cleaned[1] == "[SECRET] " * 300 and cleaned[2].startswith("𝒳 [SECRET]' 😀 [SECRET]")
    assert secrets.scan(nothing, ratios).count() == 0
    assert set(secrets.train(docs.selectExpr("key as token", "cast(null as boolean) as random"))) == {0.0}
    named = docs.limit(5).selectExpr("*", "'keep' as found_0", "'keep' as found", "'keep' as spans_3", "'keep' as TEXT_to_scan")
    assert {tuple(r) for r in secrets.scan(named, ratios).select("found_0", "found", "spans_3", "TEXT_to_scan").collect()} == {("keep",) * 4}
    plan = secrets.scan(docs, ratios)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def random_models(spark):
    """Models that hold tokens of digits for random."""
    rows = [("0123456789" * 3, True), ("abcdefghij" * 3, False)]
    return secrets.train(spark.createDataFrame(rows, "token string, random boolean"))


def test_scores_are_those_of_the_transitions(spark):
    ratios = random_models(spark)
    n = len(secrets.ALPHABET) + 1
    spot = lambda c: secrets.ALPHABET.find(c) + 1
    tokens = ["a1b2", "0123456789abcdefABC+/_=-", "9", "é1", "x" * 300]
    slow = {t: sum(float(f"{ratios[(spot(t[i - 1]) if i else 0) * n + spot(c)]:.6g}") for i, c in enumerate(t)) / len(t) for t in tokens}
    found = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.score(F.col("t"), ratios).alias("s")).collect()
    assert all(abs(slow[r["t"]] - r["s"]) < 1e-9 for r in found) and len(found) == len(tokens)


def test_redaction(spark):
    rng = random.Random(3)
    signs = "aé𝒳\ufeff\ufffe \n"
    rows = []
    for i in range(60):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        spans = sorted((a := rng.randint(0, len(text)), 0, rng.randint(a, len(text))) for _ in range(rng.randint(0, 6)))
        rows.append((i, text, spans))
    table = spark.createDataFrame(rows, "i int, text string, spans array<struct<start: int, kind: int, end: int>>")
    for r in table.withColumn("out", secrets.redact(F.col("text"), F.col("spans"), "#")).collect():
        at, out = 0, ""
        for a, _, b in r["spans"]:
            if a >= at:
                out += r["text"][at:a] + "#"
            at = max(at, b)
        assert r["out"] == out + r["text"][at:]


def test_time_grows_with_the_text(spark):
    """Eight times the token or the secrets take far less than the 64 times of quadratic work."""
    ratios = random_models(spark)

    def took(text: str) -> float:
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        found = secrets.scan(df, ratios).select(F.length(secrets.redact(F.col("text"), F.col("spans"))).alias("n"), F.size("spans"))
        began = time.perf_counter()
        found.collect()
        return time.perf_counter() - began

    for piece in ("0123456789", "é token=abcdef "):
        took(piece * 20)
        assert took(piece * 40_000) < 24 * max(took(piece * 5000), 0.25)


def test_html(spark):
    model = html_text.train()
    rng = np.random.default_rng(77)
    pages = [html_text.parse(html_text.Writer(rng).page()) for _ in range(120)]
    x, parent, depth = html_text.features(pages)
    kept = html_text.decode(model.predict(x), parent, depth)
    labels = np.array([v for p in pages for v in p.labels])
    assert (kept == labels)[depth > 0].mean() > 0.985
    assert not (kept & ~kept[parent]).any()
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=/a>Menu</a></ul></nav><div class=ad>Buy now, it is cheap and good.</div><article><h1>Title &amp; more</h1><p>First  one\n goes on.<p><b>Second</b> one.<script>var a='<p>no</p>';</script></article><div class=comments><div class=comment><p>I like it, really.</p></div></div><footer>&copy; me</footer></body></html>"
    odd = [None, "", "plain text &lt; that", page, page[: page.index("Second") + 3], "<", "<a <b <c", "</p></div>" * 50, "<div>" * 3000 + "deep"]
    found = html_text.extract(spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate(odd)], "page_id long, url string, html string, text string"), model)
    texts = {r["page_id"]: r["text"] for r in found.collect()}
    assert texts[0] == texts[1] == "" and texts[2] == "plain text < that"
    assert texts[3] == "Title & more\nFirst one goes on.\nSecond one."
    assert texts[4] == "Title & more\nFirst one goes on.\nSec" and len(texts) == len(odd)
    assert all(r["n_chars"] == len(r["text"]) for r in found.collect())


def test_decoder_never_contradicts_itself():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = 30
        parent = np.array([0, *(int(rng.integers(0, i)) for i in range(1, n))])
        depth = np.zeros(n, np.int64)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        odds = rng.normal(size=n) * 2
        kept = html_text.decode(odds, parent, depth)
        assert kept[0] and not (kept & ~kept[parent]).any()
        best = max(sum(odds[i] for i in range(1, n) if kept[i]), 0)
        for i in range(1, n):  # no subtree would do better the other way
            below = [j for j in range(n) if j == i or any(a == i for a in ancestors(parent, j))]
            if kept[i]:
                assert sum(odds[j] for j in below if kept[j]) >= 0
        assert best >= 0


def ancestors(parent, i):
    while i:
        i = parent[i]
        yield i


def test_queries_are_registered():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]

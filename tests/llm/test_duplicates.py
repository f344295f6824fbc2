"""Near duplicates, repeated strings, neighbours and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest
from brute import components as slow_components
from brute import contamination, repeats, secrets as slow_secrets
from pyspark.sql import functions as F

from folioscope.llm import common, graph, near_duplicates, neighbours, repeats as dedup
from folioscope.llm.graph import components
from folioscope.llm.neighbours import nearest
from folioscope.llm.suffix_sort import Suffixes


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame([*links, (None, 1), (5, None), (3, 3)], "a long, b long")).collect()}
    label = {x: x for link in links for x in link}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    own = {x for a, b in links if a != b for x in (a, b)}
    assert found == {k: v for k, v in label.items() if k in own}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def rows_of(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_near_duplicates(docs, corpus, nothing):
    assert rows_of(near_duplicates.near_duplicates(docs)) == slow_components(corpus)
    assert near_duplicates.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("hot", [1000, 2])
def test_families_are_joined_in_blocks(spark, monkeypatch, hot):
    """Groups of thousands of near copies, at small settings: every value of the group is frequent, and keys are hot."""
    monkeypatch.setattr(near_duplicates, "FREQUENT", 4)
    monkeypatch.setattr(near_duplicates, "LEAST_MEMBERS", 8)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(graph, "HOT_ROWS", hot)
    if hot == 2:
        monkeypatch.setattr(near_duplicates, "MOST_BYTES", 2000)
        monkeypatch.setattr(near_duplicates, "BUCKET_BYTES", 1)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        w = list(base)
        for i in rng.sample(range(80), rng.choice([0, 1, 1, 2, 3, 4])):
            w[i] = f"x{rng.randint(0, 999)}"
        texts.append(" ".join(w))
    texts += [f"license line shared by very many documents of the corpus {i}" for i in range(40)]
    corpus = list(enumerate(texts))
    found = rows_of(near_duplicates.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string")))
    assert found == slow_components(corpus)


def test_repeated_keys_and_keyless_rows(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long), (1, long), (2, long + " more"), (2, "something else entirely that is not like it"), (None, long), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, near_duplicates.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()), key=repr)
    assert found == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (None, None, False), (3, 3, True), (4, 4, True)], key=repr)
    kept = sorted((r["doc_id"] for r in near_duplicates.representatives(docs).collect()), key=repr)
    assert kept == sorted([1, None, 3, 4], key=repr)


def test_joins_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    left = spark.createDataFrame([(i, i % 4 if i < 40 else i, 7) for i in range(60)] + [(99, None, 7)], "i long, k long, c long")
    right = spark.createDataFrame([(k, f"r{k}") for k in (0, 1, 2, 45, 46, 77)], "k long, v string")
    for how in ("inner", "left"):
        found = common.spread(left, right, ["k"], how)
        assert sorted(map(repr, found.select("i", "k", "c", "v").collect())) == sorted(map(repr, left.join(right, "k", how).select("i", "k", "c", "v").collect()))


def test_sieve(spark, monkeypatch):
    monkeypatch.setattr(common, "SIEVE_BITS", 20)
    rows = spark.createDataFrame([(i,) for i in range(3000)] + [(None,)], "k long")
    wanted = spark.createDataFrame([(i,) for i in range(0, 3000, 7)], "key long")
    found = {r["k"]: r["hit"] for r in common.sieved(rows, F.col("k"), wanted, "hit").collect()}
    assert all(found[i] for i in range(0, 3000, 7)) and sum(found.values()) < 3000 // 7 + 60 and found[None] is False
    assert not any(r["hit"] for r in common.sieved(rows, F.col("k"), wanted.limit(0), "hit").collect())


def test_signature_numbers(spark):
    marks = [bytes(range(k, k + 16)) for k in (0, 100, 200, 240)]
    found = spark.createDataFrame([(bytearray(m),) for m in marks], "m binary").select(near_duplicates.numbered(F.col("m")).alias("n")).collect()
    assert [r["n"] for r in found] == [near_duplicates.identity(m) for m in marks]


def test_suffix_order_and_repeats():
    rng = np.random.default_rng(3)
    for _ in range(40):
        m = int(rng.integers(1, 20))
        rows = rng.integers(97, 99, (m, 24)).astype(np.uint8)
        own = Suffixes(rows, 6)
        row, at = np.repeat(np.arange(m), 19), np.tile(np.arange(19), m)
        bucket = rng.integers(0, 2, m)[row] * 19 + at
        text = lambda i: rows[row[i], at[i] : at[i] + 6].tobytes()  # noqa: E731, B023
        order = [(bucket[i], text(i)) for i in own.sort(row, at, bucket)]
        assert order == sorted(order)
        found = own.repeated(row, at, bucket)
        all_ = [(bucket[i], text(i)) for i in range(len(row))]
        assert found.tolist() == [all_.count(x) > 1 for x in all_]


def test_collisions_are_verified(monkeypatch):
    own = Suffixes(np.array([[97, 98, 99], [97, 98, 100], [97, 98, 99]], np.uint8), 3)
    own.hashes[:] = 0  # every hash collides
    assert own.repeated(np.arange(3), np.zeros(3, np.int64), np.zeros(3, np.int64)).tolist() == [True, False, True]


def test_least_of_windows():
    rng = np.random.default_rng(1)
    for n in (7, 8, 20, 61):
        for window in (1, 3, 7):
            value = rng.integers(0, 4, n).astype(np.uint64)  # many ties
            expected = [i + int(np.argmin(value[i : i + window])) for i in range(n - window + 1)]
            assert dedup.leftmost_least(value, window).tolist() == expected


def test_colliding_hashes_are_compared_by_bytes():
    held = np.frombuffer(b"abcdabceabcdabcf", np.uint8).reshape(4, 4)
    same = np.zeros(4, np.uint64)
    assert dedup.equal_strings(held, np.arange(4), same.astype(np.int64), same, same, 4).tolist() == [True, False, True, False]
    assert dedup.equal_strings(held[[1, 0, 2, 3]], np.arange(4), same.astype(np.int64), same, same, 4).tolist() == [False, True, True, False]


def test_odd_tables(spark):
    long = "x" * 150 + "y" * 100
    rows = [(1, long, "a", 1), (1, long, "b", 1), (None, long, "c", 1), (2, None, "d", 1), (None, "", "e", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls string, parts int")
    found = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in dedup.removed(dedup.repeated_spans(docs)).collect())
    assert found == [(0, 0, 0, 0), (0, 250, 250, 1), (1, 250, 250, 1), (1, 250, 250, 1), (2, 0, 0, 0)]


@pytest.mark.parametrize(("crowd", "group", "unit"), [(64, 2048, 1 << 19), (1, 2048, 40), (2, 3, 40), (1, 1, 1)])
def test_repeated_strings(docs, corpus, nothing, monkeypatch, crowd, group, unit):
    monkeypatch.setattr(dedup, "CROWD", crowd)
    monkeypatch.setattr(dedup, "GROUP", group)
    monkeypatch.setattr(dedup, "UNIT", unit)
    monkeypatch.setattr(dedup, "BUCKETS", 8)
    monkeypatch.setattr(dedup, "HOT", 1)
    monkeypatch.setattr(dedup, "PIVOTS", 1 if unit == 1 else 4)
    found = dedup.removed(dedup.repeated_spans(docs, length=200)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(repeats(corpus, 200))
    assert dedup.removed(dedup.repeated_spans(nothing)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 8)) * rng.uniform(0.5, 2, (400, 1)))]
    rows += [(400 + i, rows[7][1]) for i in range(30)] + [(500, None), (501, [0.0] * 8), (502, [1.0, None] * 4), (503, [float("nan")] * 8), (504, [1.0, 2.0]), (None, rows[3][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fine = {i: np.array(v) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    found: dict[int, list] = {}
    for r in nearest(table, table.where("vec_id % 20 = 0"), k=20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in fine if i % 20 == 0}
    recall = []
    for q, own in found.items():
        own.sort()
        assert [x[0] for x in own] == list(range(1, 21))
        assert own == sorted(own, key=lambda x: (-x[2], x[1])) and all(abs(x[2] - fine[x[1]] @ fine[q]) < 1e-12 for x in own)
        best = sorted(((-(v * fine[q]).sum(), i) for i, v in fine.items() if i != q))[:20]
        recall.append(len({i for _, i in best} & {x[1] for x in own}) / 20)
    assert np.mean(recall) >= 0.9
    again = nearest(table.union(table), table.where("vec_id % 20 = 0")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in again) == sorted((q, *x) for q, own in found.items() for x in own)
    sizes = spark.createDataFrame([(0, [1.0, 2.0], "r"), (1, [2.0, 1.0], "r"), (2, [1.0, 1.0, 1.0], "r"), (3, [0.0, 0.0, 3.0], "r"), (4, [5.0, 5.0], "r")], "vec_id long, embedding array<double>, rank string")
    assert sorted(map(tuple, nearest(sizes, sizes).collect())) == [(0, 1, 4, 15.0), (0, 2, 1, 4.0), (1, 1, 4, 15.0), (1, 2, 0, 4.0), (2, 1, 3, 3.0), (3, 1, 2, 3.0), (4, 1, 0, 15.0), (4, 2, 1, 15.0)]
    assert nearest(table.limit(0), table.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert nearest(few, few.where("vec_id = 0")).count() == 2


@pytest.mark.parametrize(("spread", "most"), [(0.05, 0.12), (10.0, 1.0)])
def test_share_of_rows_that_a_recall_takes(spark, monkeypatch, spread, most):
    """Clustered vectors need few rows, uniform ones many; either way the recall is met, also with leaves in several groups."""
    monkeypatch.setattr(neighbours, "GROUP", 50)
    monkeypatch.setattr(neighbours, "LEAF", 32)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    rows = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * spread
    rows = (rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.float32)
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")
    asked = table.where("vec_id % 20 = 0")
    usable = [neighbours.usable(x, "vec_id", "embedding") for x in (table, asked)]
    share = neighbours.index_of(*usable, 20, 8, 0.95, 11, "<f4").forests[16].share
    found: dict[int, set[int]] = {}
    for r in nearest(table, asked).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q, own in found.items():
        exact = rows.astype(float) @ rows[q].astype(float)
        exact[q] = -9
        recall.append(len(own & set(np.argsort(-exact)[:20].tolist())) / 20)
    print(f"spread {spread}: recall {np.mean(recall):.3f} at a share of {share:.3f}")
    assert len(found) == 200 and np.mean(recall) >= 0.9 and share <= most


def test_pipeline(spark, corpus, tmp_path):
    import corpus_pipeline

    rows = [(k, t, "en", "src", len(t or "")) for k, t in corpus]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(corpus[3][1].split()[:30])), (2, "nothing like this stands anywhere in there")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    left = {k: t for k, t in corpus}
    stages = dict(corpus_pipeline.STAGES)
    assert [n.split(" ")[0] for n in stages] == ["language", "near-deduplication", "benchmark", "secret", "best-fit"]

    docs = stages["language identification"](spark, docs, str(tmp_path))
    left = {k: t for k, t in left.items() if t and any(c.isalpha() for c in t)}
    assert docs.columns == names and {r["doc_id"] for r in docs.collect()} == set(left)
    docs = stages["near-deduplication"](spark, docs, str(tmp_path))
    label = slow_components(list(left.items()))
    left = {k: t for k, t in left.items() if label[k][1] == k}
    assert docs.columns == names and {r["doc_id"] for r in docs.collect()} == set(left)
    docs = stages["benchmark decontamination"](spark, docs, str(tmp_path))
    bad = {r[0] for r in contamination(list(left.items()), items) if r[5]}
    left = {k: t for k, t in left.items() if k not in bad}
    assert bad and docs.columns == names and {r["doc_id"]: r["text"] for r in docs.collect()} == left
    docs = stages["secret scan"](spark, docs, str(tmp_path))
    rows = docs.collect()
    assert docs.columns == names and {r["doc_id"] for r in rows} == set(left)
    assert all(slow_secrets(r["text"])[:3] == (0, 0, 0) and r["n_chars"] == len(r["text"]) for r in rows)
    marked = {r["doc_id"] for r in rows if "[SECRET]" in r["text"]}
    assert marked >= {k for k, t in left.items() if sum(slow_secrets(t)[:3]) > 0} and marked
    assert {r["doc_id"]: r["text"] for r in rows if r["doc_id"] not in marked} == {k: t for k, t in left.items() if k not in marked}
    packed = stages["best-fit packing"](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == set(left)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == packed.columns and {r["doc_id"] for r in whole.select("doc_id").collect()} == set(left)
    assert packed.agg(F.sum("length")).first()[0] == whole.agg(F.sum("length")).first()[0]

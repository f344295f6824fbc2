"""Styles of many documents, of deep chains and of chains in a ring, against plain walks; queries that call Python once a block."""

from __future__ import annotations

import random

import pytest

from folioscope.operators import styles
from folioscope.plans import texts

COLUMNS = "doc long, style string, based_on string, value string, enabled boolean"


def walk(above: dict, style: str) -> list[str]:
    out, at = [], style
    while at is not None:
        out.append(at)
        if at in out[:-1]:
            break
        at = above.get(at)
    return out


@pytest.fixture(scope="module")
def rows():
    """Trees, rings, styles that build on themselves or on none that is there, a null document, and 9000 documents in all."""
    draw = random.Random(7)
    out = []
    for doc in [None, *range(9000)]:
        n = draw.randint(1, 7)
        for i in range(n):
            base = draw.choice([None, "gone", *(f"s{j}" for j in range(n))])
            out.append((doc, f"s{i}", base, draw.choice([None, f"v{i}"]), draw.choice([None, False, True])))
    return out


@pytest.fixture(scope="module")
def plain(rows):
    """Of each document: what each style builds on, what it sets, whether it switches hiding on."""
    out: dict = {}
    for doc, style, base, value, on in rows:
        above, values, enabled = out.setdefault(doc, ({}, {}, {}))
        above[style], values[style], enabled[style] = base, value, bool(on)
    return out


def test_chains_of_blocks(spark, rows, plain):
    found = styles.chains(spark.createDataFrame(rows, COLUMNS), "doc").collect()
    expected = {(doc, s, a, n) for doc, (above, _, _) in plain.items() for s in above for n, a in enumerate(walk(above, s))}
    assert len(found) == len(expected) and set(map(tuple, found)) == expected


def test_inherited(spark, rows, plain):
    found = styles.inherited(spark.createDataFrame(rows, COLUMNS), "doc", ["value", "enabled"]).collect()
    first = lambda seen: next((x for x in seen if x is not None), None)
    switch = {(r[0], r[1]): r[4] for r in rows}
    expected = {(doc, s, first(values.get(a) for a in walk(above, s)), first(switch.get((doc, a)) for a in walk(above, s))) for doc, (above, values, _) in plain.items() for s in above}
    assert len(found) == len(rows) and set(map(tuple, found)) == expected


def test_inherited_by_a_deep_chain(spark):
    """A chain of 40,000 styles in one document has 800 million pairs."""
    deep = spark.range(1, 40_001).selectExpr("'d' AS doc", "id AS style", "CASE WHEN id > 1 THEN id - 1 END AS based_on", "CASE WHEN id IN (1, 30000) THEN id END AS value")
    found = styles.inherited(deep, "doc", ["value"]).groupBy("value").count().collect()
    assert {(r["value"], r["count"]) for r in found} == {(1, 29_999), (30_000, 10_001)}


def groups(df) -> bool:
    """Whether Python is called for each group."""
    return "FlatMapGroups" in df._jdf.queryExecution().toString()


def test_con_pagination_has_no_call_a_page(spark):
    assert not groups(texts.con_pagination(spark, "/root/testdata/sf0.001"))


def test_font_closure_of_blocks(spark):
    """Many documents against a plain search, with fonts of no document, null names and a chain of 3000 alternate names."""
    draw = random.Random(8)
    pairs = [(doc, draw.choice([None, "f0", "f1", "f2", "f3", "f4"]), draw.choice([None, "f0", "f1", "f2", "f3", "f4"])) for doc in [None, *range(9000)] for _ in range(draw.randint(0, 5))]
    order = draw.sample(range(3001), 3001)
    pairs += [(9000, f"c{a}", f"c{b}") for a, b in zip(order, order[1:], strict=False)]
    seeds = [(doc, "f0") for doc in [None, *range(9000)] if draw.random() < 0.7] + [(1, "f0"), (9000, f"c{order[0]}"), (9001, "lone")]
    linked: dict = {}
    for doc, a, b in pairs:
        if a is not None and b is not None:
            linked.setdefault((doc, a), []).append((doc, b))
            linked.setdefault((doc, b), []).append((doc, a))
    expected, left = set(seeds), list(set(seeds))
    while left:
        fresh = set(linked.get(left.pop(), [])) - expected
        expected |= fresh
        left += fresh
    found = styles.font_closure(spark.createDataFrame(seeds, "doc long, font string"), spark.createDataFrame(pairs, "doc long, font string, other string"), "doc").collect()
    assert len(found) == len(expected) and set(map(tuple, found)) == expected


def test_vis_font_closure_has_no_call_a_page(spark):
    assert not groups(texts.vis_font_closure(spark, "/root/testdata/sf0.001"))


def test_hidden(spark, rows, plain):
    own = spark.createDataFrame(rows, COLUMNS)
    found = styles.hidden(own, "doc").collect()
    expected = {(doc, s, sum(on.get(a, False) for a in walk(above, s)) % 2 == 1) for doc, (above, _, on) in plain.items() for s in above}
    assert len(found) == len(rows) and set(map(tuple, found)) == expected
    known = own.where("doc is not null")
    assert set(map(tuple, styles.hidden_styles(styles.chains(known, "doc"), known, "doc").collect())) == {x for x in expected if x[0] is not None}


def test_hidden_by_a_deep_chain(spark):
    """A chain of 40,000 styles in one document; every third switches hiding on."""
    deep = spark.range(1, 40_001).selectExpr("'d' AS doc", "id AS style", "CASE WHEN id > 1 THEN id - 1 END AS based_on", "id % 3 = 0 AS enabled")
    found = styles.hidden(deep, "doc")
    assert found.count() == 40_000 and found.where("hidden <> (div(style, 3) % 2 = 1)").count() == 0


def test_vis_run_hidden_has_no_call_a_page(spark):
    assert not groups(texts.vis_run_hidden(spark, "/root/testdata/sf0.001"))

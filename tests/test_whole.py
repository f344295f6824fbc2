"""Queries that once were cut to a part of their rows or texts give those of the whole job: of SQL without the cut, or of brute force."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from test_oracles import DATA, duck, pytestmark, rows  # noqa: F401

from folioscope.plans import registry


def uncut(name: str, cut: str, instead: str = "") -> str:
    """The registered SQL of a query without a cut, if it has it."""
    return registry.oracle_sql()[name].replace(cut, instead)


def whole(spark, duck, name: str, sql: str) -> list[tuple]:  # noqa: F811
    """The query's rows, columns in order of their names, once they are those of the SQL."""
    df = registry.queries()[name](spark, str(DATA))
    expected = duck.execute(sql)
    found = rows(df.collect(), df.columns)
    assert found == rows(expected.fetchall(), [c[0] for c in expected.description])
    return found[1]


def test_row_spans_of_all_pages(spark, duck):  # noqa: F811
    found = whole(spark, duck, "con_spans", uncut("con_spans", "page_id < 300 AND "))
    assert max(r[1] for r in found) >= 300


def test_windows_over_all_lines(spark, duck):  # noqa: F811
    found = whole(spark, duck, "win_sliding_text", uncut("win_sliding_text", " WHERE ord <= 6"))
    assert max(r[3] for r in found) >= 6


def written(spark, folder, name: str, rows: list[tuple], schema: str) -> str:  # noqa: F811
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def slow_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j - 1] + (x != y), above[j] + 1, row[-1] + 1))
    return row[-1]


@pytest.fixture(scope="module")
def pairs():
    """Two texts each: short and long, in ASCII or not, alike up to a late place, and empty."""
    rng = random.Random(4)
    some = lambda n, signs: "".join(rng.choice(signs) for _ in range(n))
    head = some(350, "abc de")
    found = [("", ""), ("", "abc"), ("café 日本", "cafe 日本語"), (head + "xyz", head), (head + some(90, "abé"), head + some(70, "abé"))]
    return found + [(some(rng.randint(1, 420), "abcé 日"), some(rng.randint(1, 420), "abcé 日")) for _ in range(6)]


def test_distances_of_whole_lines(spark, tmp_path, pairs):
    d = written(spark, tmp_path, "documents", [(i, f"{a}\n{b}\nmore") for i, (a, b) in enumerate(pairs)] + [(99, "one line")], "doc_id long, text string")
    expected = {i: slow_distance(a, b) for i, (a, b) in enumerate(pairs)}
    assert {r["doc_id"]: r["d"] for r in registry.queries()["txt_cer"](spark, d).collect()} == expected
    found = registry.queries()["txt_cer_sdi"](spark, d).collect()
    assert {r["doc_id"]: r["distance"] for r in found} == expected
    for r in found:
        a, b = pairs[r["doc_id"]]
        assert r["substitutions"] + r["deletions"] + r["insertions"] == r["distance"] and r["insertions"] - r["deletions"] == len(b) - len(a)


def test_similarity_of_whole_turns(spark, tmp_path, pairs):
    turns = [(i, n, text) for i, pair in enumerate(pairs) for n, text in enumerate(pair)]
    d = written(spark, tmp_path, "conversations", turns, "conv_id long, turn long, text string")
    found = {r["conv_id"]: r["ratio"] for r in registry.queries()["txt_similarity"](spark, d).collect()}
    assert found == {i: SequenceMatcher(None, a, b).ratio() for i, (a, b) in enumerate(pairs)} and found[3] < 1


def test_ledgers_of_whole_documents(spark, duck):  # noqa: F811
    sql = uncut("rev_apply", "[1:4]").replace("substr(t, 1, 60) AS t", "t")
    found = whole(spark, duck, "rev_apply", sql)
    assert max(r[3] for r in found) > 4 and max(len(r[5]) for r in found) > 120


def test_tags_in_all_lines(spark, duck):  # noqa: F811
    found = whole(spark, duck, "txt_img_tag", uncut("txt_img_tag", " WHERE ord <= 3"))
    assert max(r[1] for r in found) > 3


def test_items_of_any_words_are_found(spark, tmp_path):
    docs = [(1, "so (a b c d e f g) it is"), (2, "a b\nc d e f g"), (3, "say «kurz und gut»."), (4, "one two three four. Five six, seven"), (5, "")]
    items = [(1, "a b c d e f g"), (2, "kurz und gut"), (3, "gut"), (4, "two three four. Five six"), (5, "one two three four"), (6, "ne two three four. Five si"), (7, "b c d e"), (8, "not here at all, not once")]
    d = written(spark, tmp_path, "documents", docs, "doc_id long, text string")
    written(spark, tmp_path, "benchmark", items, "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"]) for r in registry.queries()["txt_presence"](spark, d).collect())
    assert found == sorted((k, i) for k, text in docs for i, item in items if item in text)

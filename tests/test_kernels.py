"""Kernels against hand-written rows and brute force."""

from __future__ import annotations

import random
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.operators import formulas, kernels, revision


def slow_closure(boxes, gap):
    boxes = [tuple(b) for b in boxes]
    while True:
        for i, a in enumerate(boxes):
            for j, b in enumerate(boxes):
                grown = (a[0] - gap, a[1] - gap, a[2] + gap, a[3] + gap)
                if i != j and min(grown[2], b[2]) > max(grown[0], b[0]) and min(grown[3], b[3]) > max(grown[1], b[1]):
                    boxes = [x for k, x in enumerate(boxes) if k not in (i, j)] + [(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))]
                    break
            else:
                continue
            break
        else:
            return sorted(boxes)


def test_closure_is_the_fixpoint():
    rng = random.Random(3)
    for _ in range(120):
        boxes = [(x := rng.randint(0, 60), y := rng.randint(0, 60), x + rng.randint(1, 20), y + rng.randint(1, 20)) for _ in range(rng.randint(1, 9))]
        gap = rng.choice([0, 5])
        found, counts = kernels.closure(np.array(boxes, float), gap)
        assert sorted(map(tuple, found.tolist())) == slow_closure(boxes, gap)
        assert counts.sum() == len(boxes)


def test_touching_boxes_stay_apart_and_empty_pages_are_empty():
    assert len(kernels.closure(np.array([[0, 0, 1, 1], [1, 0, 2, 1]], float))[0]) == 2
    assert len(kernels.closure(np.empty((0, 4)))[0]) == 0
    assert kernels.row_numbers(np.empty((0, 4))).tolist() == []


def test_grown_over_holds_what_it_touches():
    assert kernels.grown_over(np.array([0, 0, 2, 2.0]), np.array([[1, 1, 5, 5.0], [4, 4, 9, 9.0], [20, 20, 21, 21.0]])).tolist() == [0, 0, 9, 9]


def test_rows():
    boxes = np.array([[0, 0, 5, 10], [6, 1, 9, 11], [0, 20, 5, 30], [7, 8, 9, 18]], float)
    assert kernels.row_numbers(boxes).tolist() == [0, 0, 2, 1]
    assert kernels.line_numbers(np.array([10, 10.5, 30.0]), np.array([10, 10, 10.0])).tolist() == [0, 0, 1]


def test_greedy_takes_the_best_first_and_maximum_takes_most():
    edges = [(0.9, "a", "x"), (0.8, "a", "y"), (0.8, "b", "x")]
    assert kernels.greedy_matches(edges) == [("a", "x", 0.9)]
    assert kernels.greedy_matches([(0.5, "b", "x"), (0.5, "a", "x")]) == [("a", "x", 0.5)]
    assert kernels.maximum_matching({"a": ["x", "y"], "b": ["x"]}) == {"a": "y", "b": "x"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 4)), min_size=1, max_size=5))
def test_maximum_matching_is_maximum(sets):
    edges = {f"l{i}": [f"r{j}" for j in sorted(s)] for i, s in enumerate(sets)}
    found = kernels.maximum_matching(edges)
    assert len(set(found.values())) == len(found) and all(b in edges[a] for a, b in found.items())
    best = max(sum(j in sets[i] for i, j in zip(range(len(sets)), p, strict=False)) for p in permutations(range(5), len(sets)))
    assert len(found) == best


@settings(max_examples=80, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_edits_add_up(a, b):
    s, d, i = kernels.edit_counts(a, b)
    table = [[max(x, y) if not x or not y else 0 for y in range(len(b) + 1)] for x in range(len(a) + 1)]
    for x in range(1, len(a) + 1):
        for y in range(1, len(b) + 1):
            table[x][y] = min(table[x - 1][y - 1] + (a[x - 1] != b[y - 1]), table[x - 1][y] + 1, table[x][y - 1] + 1)
    assert s + d + i == table[-1][-1] and len(a) - d + i == len(b)


def test_edit_examples():
    assert kernels.edit_counts("abc", "") == (0, 3, 0)
    assert kernels.edit_counts("", "é日") == (0, 0, 2)
    assert kernels.edit_counts("日本", "日x") == (1, 0, 0)


def test_texts():
    assert kernels.abnormal("a�") and kernels.abnormal("") and kernels.abnormal("\x07") and not kernels.abnormal("a\t\n日")
    assert kernels.column_widths([["a", "b"]], 200) == [100, 100]
    assert kernels.column_widths([["日" * 10, "b"]], 200)[0] == pytest.approx(122)
    assert kernels.best_window("one two three", ["one two", "three four", "x"])[1] == "one two three four"
    assert kernels.best_window("one", ["one"]) is None and kernels.best_window("one", []) is None


def test_wire_values():
    assert kernels.literal_blocks('[{"a": 1}]') == ("json", [{"a": 1}])
    assert kernels.literal_blocks("[{'a': None}]") == ("python_literal_list", [{"a": None}])
    assert kernels.literal_blocks("__import__('os')") == ("unknown", None) and kernels.literal_blocks(None) == ("unknown", None)
    assert kernels.shape([1, 2, "x"]) == {"type": "array", "count": 3, "items": [{"type": "integer"}, {"type": "string"}]}
    assert kernels.without_media({"Image": "x", "a": ["https://x", "t ![p](u)"]}) == {"a": ["[MEDIA_REMOVED]", "t [IMAGE_REFERENCE_REMOVED]"]}


def test_table_grids():
    assert kernels.html_grid("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c<br>d</td></tr></table>") == [(0, 0, 2, 1, "a"), (0, 1, 1, 1, "b"), (1, 1, 1, 1, "c\nd")]
    assert kernels.html_grid("<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>") is None
    assert kernels.html_grid("<table><tr><th>a</th></tr></table>") is None


def test_formulas():
    assert formulas.tree("x^2") == ["row", ["scripted", ["text", "x"], {"sup": ["text", "2"]}]]
    assert formulas.canonical(r"\frac{a}{b}") == formulas.canonical(r"\frac a b").replace('["text","a"]', '["row",["text","a"]]', 1).replace('["text","b"]', '["row",["text","b"]]', 1)
    assert "<m:sSubSup>" in formulas.omml("x_1^2") and "degHide" in formulas.omml(r"\sqrt{\alpha}") and "≤" in formulas.omml(r"a \leq b")
    for bad, code in ((r"\foo", "COMMAND"), ("{a", "UNBALANCED"), ("a}", "UNBALANCED"), ("x^1^2", "DUPLICATE"), ("{}", "EMPTY"), (r"\sqrt[3]{x}", "INDEXED"), ("", "UNBALANCED"), ("a" * 1025, "COMPLEX"), ("{" * 40 + "a" + "}" * 40, "UNSUPPORTED"), ("a&b", "TOKEN")):
        with pytest.raises(formulas.FormulaError, match=code):
            formulas.tree(bad)


def test_ledger():
    base = [{"id": "a", "text": "one", "policy": None}, {"id": "b", "text": "two", "policy": None}]
    edits = [{"action": "split", "block_id": "a", "offset": 1, "reason": "r"}, {"action": "move", "block_id": "b", "delta": -1, "reason": "r"}, {"action": "merge", "block_id": "a", "reason": "r"}]
    assert [(x["id"], x["text"]) for x in revision.apply(base, edits)] == [("a", "otwo"), ("a-split0", "ne")]
    assert [b["text"] for b in base] == ["one", "two"]
    for op, code in (({"action": "text", "block_id": "a"}, "REASON"), ({"action": "text", "block_id": "z", "reason": "r"}, "NOT_FOUND"), ({"action": "move", "block_id": "a", "delta": -1, "reason": "r"}, "MOVE"), ({"action": "fly", "block_id": "a", "reason": "r"}, "UNKNOWN")):
        with pytest.raises(revision.LedgerError, match=code):
            revision.apply(base, [op])

"""Markdown blocks, routing, classification and styles on hand-written rows."""

from __future__ import annotations

import numpy as np

from folioscope.operators import association, markdown, pages, routing, styles


def test_math_and_money():
    spans = lambda t: [t[a:b] for a, b in markdown.math_spans(t)]
    assert spans("a $x+1$ b $$y$$") == ["$x+1$", "$$y$$"]
    assert spans("costs $5, or $6.50 more") == [] and spans("US$5 and $z_1$") == ["$z_1$"]
    assert spans("$2^n$ holds") == ["$2^n$"]
    assert markdown.residual_math(r"\(x\)") and markdown.residual_math(r"\frac{1}{2}") and markdown.residual_math("$x") and not markdown.residual_math(r"pay $5 \today")


def test_blocks():
    text = "## Head\n\n1. Ask $A. x$ this\nA. one  B. two\n\n<img src=\"a\">\n\n第 3 题\n\n7页\n\nplain 1.5 text"
    assert list(markdown.pieces(text)) == [("heading", "Head"), ("question", "1. Ask $A. x$ this"), ("option", "A. one"), ("option", "B. two"), ("caption", "第 3 题"), ("footer", "7页"), ("paragraph", "plain 1.5 text")]
    assert not list(markdown.pieces("  \n\n "))
    assert markdown.unsupported("- item") and markdown.unsupported("**b**") and markdown.unsupported("<div>x</div>") and not markdown.unsupported("fill ____ in, $x*y*z$")
    assert markdown.visible_text("a<br>b<script>no</script>&amp;<td>c") == "a\nb&c"


def test_regions():
    boxes = np.array([[0, 0, 80, 80], [10, 10, 20, 14], [10, 30, 20, 34], [40, 40, 50, 50], [55, 40, 60, 50], [12, 31, 30, 33]], float)
    kind = np.array([2, 1, 1, 3, 3, 2])
    found, reason = routing.page_regions(kind, np.array([1, 0, 1, 1, 1, 1], bool), 80, 80, boxes)
    assert [(tuple(b), routing.REASONS[r]) for b, r in zip(found.tolist(), reason, strict=True)] == [
        ((10, 10, 20, 14), "UNTRUSTED_NATIVE_RUN"), ((10, 30, 30, 34), "VECTOR_TEXT_REVIEW"), ((40, 40, 60, 50), "IMAGE_PURPOSE_UNKNOWN")
    ]
    assert len(routing.page_regions(np.array([1]), np.array([True]), 80, 80, boxes[1:2])[0]) == 0


def test_page_classes(spark):
    known = spark.createDataFrame([(i, "FAILED" if i == 0 else "OK", 10.0, 10.0) for i in range(8)], "page_id long, status string, width double, height double")
    run = lambda i, t="a", ok=True: (i, t, ok, 0.0, 0.0, 1.0, 1.0)
    runs = spark.createDataFrame([run(0), run(3, "�"), run(4), run(5), run(6, ok=False), run(7), run(7)], "page_id long, text string, geometry_verified boolean, x0 double, y0 double, x1 double, y1 double")
    thing = lambda i, t, v="painted", level=0: (i, t, v, level, 0.0, 0.0, 5.0, 10.0)
    objects = spark.createDataFrame([thing(2, 3), thing(4, 1, "invisible"), thing(4, 3), thing(5, 1, "white_paint"), thing(7, 1, level=2), thing(7, 3), thing(7, 3)], "page_id long, type int, visibility string, level int, x0 double, y0 double, x1 double, y1 double")
    found = {r["page_id"]: (r["page_type"], r["content_state"], r["reason_codes"], r["image_coverage"]) for r in pages.classified(known, runs, objects).collect()}
    assert found == {
        0: ("unknown", "native", ["NATIVE_EXTRACTION_FAILED"], 0.0), 1: ("native", "blank", [], 0.0), 2: ("scanned", "image_only", ["NO_NATIVE_TEXT"], 0.5), 3: ("broken_encoding", "native", ["ABNORMAL_UNICODE"], 0.0),
        4: ("hidden_text_scan", "native", ["INVISIBLE_TEXT_WITH_IMAGE"], 0.5), 5: ("unknown", "native", ["WHITE_PAINT_VISIBILITY_REVIEW"], 0.0), 6: ("unknown", "native", ["UNVERIFIED_NATIVE_GEOMETRY"], 0.0),
        7: ("mixed", "native", ["IMAGE_PURPOSE_UNCONFIRMED", "NESTED_FORM_GEOMETRY_REVIEW", "DUPLICATE_NATIVE_RUNS"], 0.5),
    }


def test_styles(spark):
    parents = spark.createDataFrame([(1, "a", None), (1, "b", "a"), (1, "c", "b"), (2, "x", "y"), (2, "y", "x")], "doc long, style string, based_on string")
    chain = styles.chains(parents.where("doc = 1"), "doc")
    assert {(r["style"], r["ancestor"], r["distance"]) for r in chain.collect()} == {("a", "a", 0), ("b", "b", 0), ("b", "a", 1), ("c", "c", 0), ("c", "b", 1), ("c", "a", 2)}
    assert {r["style"] for r in styles.cycles(parents, "doc").collect()} == {"x", "y"}
    toggles = spark.createDataFrame([(1, "a", True), (1, "c", True)], "doc long, style string, enabled boolean")
    assert {r["style"]: r["hidden"] for r in styles.hidden_styles(chain, toggles, "doc").collect()} == {"a": True, "b": True, "c": False}
    values = spark.createDataFrame([(1, "a", "size", "10"), (1, "b", "size", "12")], "doc long, style string, property string, value string")
    assert {r["style"]: r["value"] for r in styles.nearest_property(chain, values, "doc").collect()} == {"a": "10", "b": "12", "c": "12"}
    fonts = spark.createDataFrame([(1, "Sym")], "doc long, font string")
    aliases = spark.createDataFrame([(1, "B", "Sym"), (1, "C", "B"), (1, "D", "E"), *((1, f"L{i}", f"L{i + 1}") for i in range(40)), (1, "C", "L0")], "doc long, font string, other string")
    assert {r["font"] for r in styles.font_closure(fonts, aliases, "doc").collect()} == {"Sym", "B", "C"} | {f"L{i}" for i in range(41)}


def test_lookups(spark):
    names = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 2, 21)], "page long, number long, target long")
    asked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "page long, number long, who string")
    assert {r["who"]: (r["state"], r["target"]) for r in association.looked_up(asked, names, "number", "target", "page").collect()} == {"a": ("unique", 10), "b": ("ambiguous", None), "c": ("missing", None)}

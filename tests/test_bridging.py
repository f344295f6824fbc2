"""Reviewed formulas, service descriptions, grids, packages: hand-written rows with nulls, ties and empty tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from test_sources import package, png

from folioscope.operators import bridging as ops
from folioscope.plans import bridging as plans
from folioscope.sources import docx, files


def test_replanned():
    assert ops.replanned("plain, $5.") == {"policy": "editable", "reason": None, "parts": []}
    assert ops.replanned("a\x00", invalid=True)["reason"] == "INVALID_XML_TEXT_FALLBACK"
    assert ops.replanned("so $x^2$ and $$y$$.")["parts"] == [{"text": "so "}, {"math": "x^2"}, {"text": " and "}, {"math": "y"}, {"text": "."}]
    assert ops.replanned(r"$\foo{x}$", [r"\foo {x}"])["parts"] == [{"text": ""}, {"image": r"\foo{x}"}, {"text": ""}]
    for previous in ([], [r"\foo{x}", r"\foo {x}"]):  # none, or more than one
        assert ops.replanned(r"$\foo{x}$", previous)["policy"] == "preserve_image"
    assert ops.replanned(r"$x$ \alpha")["policy"] == "preserve_image"


def test_replanned_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, "$x$", None), (3, "", ["y"])], "k long, text string, previous array<string>")
    rows = df.select("k", ops.replanned_text(F.col("text"), F.coalesce("previous", F.array()), F.lit(False)).alias("p")).collect()
    assert {r["k"]: r["p"] and json.loads(r["p"])["policy"] for r in rows} == {1: None, 2: "hybrid", 3: "editable"}


def test_uploads():
    a, b, c, d = ([(u["path"], u["file_field"], u["required"], u["deprecated"]) for u in ops.uploads(json.dumps(x))] for x in plans.DESCRIPTIONS)
    assert (a, b, c, d) == ([("/a", "data", ["data"], False)], [("/b", "Image", ["x", "Image"], True)], [], [])
    both = {"paths": plans.DESCRIPTIONS[1]["paths"] | plans.DESCRIPTIONS[0]["paths"], "s": plans.DESCRIPTIONS[0]["s"]}
    assert [u["path"] for u in ops.uploads(json.dumps(both))] == ["/a", "/b"]  # old ones last
    circle = {"anyOf": [{"$ref": "#/s"}]}
    for text in ("{", "[]", "null", '{"paths": {"/x": null}}', json.dumps(plans._description("/x", "application/json", {"properties": {"v": circle}}) | {"s": circle}), json.dumps(plans._description("/x", "application/json", {"$ref": "http://x"}))):
        assert ops.uploads(text) == []


def test_layout_grids(spark):
    tables = spark.createDataFrame([("d", t, 2, 2, t != 3, "layout" if t in (5, 6) else "data" if t == 7 else None) for t in range(1, 8)], "key string, t int, rows int, cols int, borderless boolean, role string")
    grid = [(0, 0), (0, 1), (1, 0), (1, 1)]
    full = lambda t, filled=4: [("d", t, r, c, 1, 1, i < filled) for i, (r, c) in enumerate(grid)]
    cells = full(1, 3) + full(2, 2) + full(3) + full(4)[:3] + full(4)[2:3] + full(5) + full(6)[:3]
    schema = "key string, t int, row int, col int, rowspan int, colspan int, filled boolean"
    cells, references = (spark.createDataFrame(x, schema) for x in (cells, full(5) + full(6)))
    found = ops.layout_grid_faults(tables, cells, references, "key", "t")
    assert sorted(r["t"] for r in found.collect()) == [2, 3, 4, 6]  # half empty, with borders, a place twice, a cell less; 7 is judged elsewhere
    assert ops.layout_grid_faults(tables.limit(0), cells, references, "key", "t").count() == 0


def test_bridge(spark):
    blocks = spark.createDataFrame([(1, 1, 7, None), (1, 2, 8, "p"), (2, 1, 7, None), (2, 2, 7, None), (3, 1, 5, None), (4, 1, 5, "q")], "doc long, page long, id long, asset string")
    order = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (2, 1, 7), (2, 2, 7), (3, 1, 5), (3, 1, 6), (4, 1, 5)], "doc long, page long, id long")
    assets = spark.createDataFrame([(1, "p")], "doc long, asset string")
    found = {r["doc"]: r["fault"] for r in ops.bridge_faults(blocks, order, assets, "doc", "page", "id").collect()}
    assert found == {2: "BRIDGE_DUPLICATE_SOURCE_ID", 3: "BRIDGE_INCOMPLETE_READING_ORDER", 4: "BRIDGE_ASSET_MISSING"}


def test_packages(spark, tmp_path):
    rel = '<Relationships><Relationship Id="r" Type="t/image" Target="{}"{}/></Relationships>'
    rels = "word/_rels/document.xml.rels"
    made = {
        "good": package("<w:p><w:r><w:t>Hi</w:t></w:r></w:p>", **{rels: rel.format("media/a.png", ""), "word/media/a.png": png(3, 2)}),
        "bare": package("<w:p/>"),
        "away": package("<w:p/>", **{rels: rel.format("http://x", ' TargetMode="External"')}),
        "lost": package("<w:p/>", **{rels: rel.format("media/b.png", "")}),
        "torn": package("<w:p/>", **{"word/media/a.png": "x"}),
        "flat": package('<w:p><d:extent xmlns:d="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" cx="5" cy="0"/></w:p>'),
        "none": b"no package",
    }
    for name, data in made.items():
        (tmp_path / f"{name}.docx").write_bytes(data)
    found = {r["path"].rsplit("/", 1)[1][:4]: (r["status"], r["editable"], r["n_chars"]) for r in docx.packages(files.listed(spark, str(tmp_path), "*.docx")).collect()}
    codes = {"away": "EXTERNAL_RELATIONSHIP", "lost": "OOXML_TARGET_MISSING", "torn": "IMAGE_DECODE_ERROR", "flat": "INVALID_IMAGE_EXTENT", "none": "DOCX_PACKAGE_INVALID"}
    assert found == {"good": ("OK", True, 2), "bare": ("OK", False, 0)} | {k: (v, None, None) for k, v in codes.items()}

"""Identifiers, text trees and widths that no SQL states, on hand-written rows."""

from __future__ import annotations

import io
import json
import uuid
import zipfile

from pyspark.sql import functions as F

from folioscope.operators import projection, scores
from folioscope.plans import texts
from folioscope.sources import docx


def test_identifiers_by_name(spark):
    names = ["a/1/x", "é/2", ""]
    found = spark.createDataFrame([(n,) for n in names], "n string").select("n", projection.uuid5(texts_namespace(), F.col("n")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])) for r in found) and len(found) == 3


def texts_namespace() -> str:
    return uuid.NAMESPACE_URL.hex


def test_saved_once(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "a int")
    scores.saved_once(rows, f"{tmp_path}/out")
    try:
        scores.saved_once(rows, f"{tmp_path}/out")
        raise AssertionError("overwritten")
    except Exception as e:  # noqa: BLE001
        assert "PATH_ALREADY_EXISTS" in str(e)
    assert spark.read.json(f"{tmp_path}/out").count() == 1


def test_snapshots_and_hints(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, version long")
    new = spark.createDataFrame([(2, "c", 0), (3, "d", 0)], "id long, v string, version long")
    assert sorted(map(tuple, scores.integrated(old, new, "id", "version").collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
    assert sorted(map(tuple, scores.integrated(old.limit(0), new, "id", "version").collect())) == [(2, "c", 1), (3, "d", 1)]


def test_bad_numbers_in_documents_are_a_status(spark):
    def package(body: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("[Content_Types].xml", "<Types/>")
            z.writestr("word/document.xml", f'<w:document xmlns:w="{docx.W[1:-1]}"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    files = [("a", package('<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="x"/></w:tcPr></w:tc></w:tr></w:tbl>')), ("b", package("<w:p><w:cellIns/></w:p>")), ("c", package("<w:p/>"))]
    found = {r["path"]: r["status"] for r in docx.documents(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")).collect()}
    assert found == {"a": "DOCX_CONTENT_INVALID", "b": "DOCX_REVISIONS_UNSUPPORTED", "c": "OK"}


def test_texts_without_sql(spark, tmp_path):
    spark.createDataFrame([(0, 1, "a\nb"), (1, 2, "one two")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [(r["ord"], r["kind"], r["text"]) for r in texts.txt_split_markers(spark, str(tmp_path)).where("id = 1").orderBy("ord").collect()] == [(1, "question", "1. a"), (2, "question", "2. b")]
    widths = {r["conv_id"]: json.loads(r["widths"]) for r in texts.geo_col_widths(spark, str(tmp_path)).collect()}
    assert len(widths[1]) == 2 and abs(sum(widths[1]) - 400) < 1e-6

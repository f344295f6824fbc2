"""Readers on hand-made files."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from folioscope.sources import docx, files
from folioscope.streaming import ledger

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(body: str, **more: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, text in more.items():
            z.writestr(name, text)
    return out.getvalue()


def png(w: int, h: int) -> bytes:
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def test_documents(spark, tmp_path):
    run = "<w:r><w:t>{}</w:t></w:r>"
    body = f"<w:p>{run.format('Hello')}<w:r><w:rPr><w:vanish/></w:rPr><w:t>hid</w:t></w:r><w:bookmarkStart w:id='1' w:name='m1'/></w:p>"
    cell = "<w:tc><w:tcPr>{}</w:tcPr><w:p>{}</w:p></w:tc>"
    body += "<w:tbl><w:tr>" + cell.format("<w:vMerge w:val='restart'/>", run.format("a")) + cell.format("", run.format("b")) + "</w:tr><w:tr>" + cell.format("<w:vMerge/>", "") + cell.format("", run.format("c")) + "</w:tr></w:tbl>"
    (tmp_path / "good.docx").write_bytes(package(body))
    (tmp_path / "bad.docx").write_bytes(b"not a package")
    (tmp_path / "changed.docx").write_bytes(package(f"<w:p><w:ins>{run.format('x')}</w:ins></w:p>"))
    rows = docx.documents(files.listed(spark, str(tmp_path), "*.docx")).collect()
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in rows}
    assert status == {"good.docx": "OK", "bad.docx": "DOCX_PACKAGE_INVALID", "changed.docx": "DOCX_REVISIONS_UNSUPPORTED"}
    good = [r for r in rows if r["status"] == "OK"]
    assert [(r["kind"], r["text"], r["markers"]) for r in good if r["kind"] == "paragraph"] == [("paragraph", "Hello", ["m1"])]
    assert sorted((r["row"], r["col"], r["rowspan"], r["colspan"], r["text"]) for r in good if r["kind"] == "cell") == [(0, 0, 2, 1, "a"), (0, 1, 1, 1, "b"), (1, 1, 1, 1, "c")]


def test_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(30, 20))
    (tmp_path / "b.png").write_bytes(png(5000, 20))
    (tmp_path / "c.txt").write_bytes(b"x")
    listed = files.listed(spark, str(tmp_path))
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in files.admitted(listed).select("path", "error").collect()}
    assert errors == {"a.png": None, "b.png": None, "c.txt": "UNSUPPORTED_FORMAT"}
    sizes = spark.createDataFrame([("/x/a.PDF", 5), ("/x/b.pdf", 0), ("/x/c.pdf", (25 << 20) + 1)], "path string, length long")
    assert [r["error"] for r in files.admitted(sizes).orderBy("path").collect()] == [None, "INPUT_SIZE_LIMIT", "INPUT_SIZE_LIMIT"]
    pictures = {r["path"].rsplit("/", 1)[1]: (r["format"], r["width"], r["height"], r["error"]) for r in files.images(listed.where(F.col("path").endswith(".png"))).collect()}
    assert pictures == {"a.png": ("PNG", 30, 20, None), "b.png": ("PNG", 5000, 20, "IMAGE_RESOURCE_LIMIT")}
    assert {r["sha256"] for r in files.seal(listed.where("length = 1")).collect()} == {hashlib.sha256(b"x").hexdigest()}


def test_catalogues(spark, tmp_path):
    (tmp_path / "t.md").write_text("# x\n## T-1: First\n- Goal: go\n- Size: 3\n## T-2 Second\n- goal: stay\n")
    (tmp_path / "t.csv").write_text("﻿id,deps\nT-1,\nT-2,T-1; T-3\n", encoding="utf-8")
    (tmp_path / "S").write_text("a" * 64 + "  one.txt\nnonsense\n")
    assert sorted((r["id"], r["title"], r["fields"]["goal"]) for r in files.markdown_catalog(spark, str(tmp_path / "t.md")).collect()) == [("T-1", "First", "go"), ("T-2", "Second", "stay")]
    assert sorted((r["id"], r["deps"]) for r in files.csv_catalog(spark, str(tmp_path / "t.csv"), ["deps"]).collect() if r["deps"]) == [("T-2", ["T-1", "T-3"])]
    assert [tuple(r) for r in files.sums(spark, str(tmp_path / "S")).collect()] == [("one.txt", "a" * 64)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(400).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), (F.col("id") % 3).alias("provider"), F.when(F.col("id") % 7 == 0, "FAILED").otherwise("COMPLETE").alias("status"), F.col("id").cast("double").alias("duration_ms"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    batch = ledger.windowed_durations(rows, "ts", "1 day", "1 day", "provider")
    stream = ledger.windowed_durations(ledger.stream_of(spark, str(tmp_path / "in"), rows.schema, files=2), "ts", "30 days", "1 day", "provider")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("ledger_out").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("ledger_out").collect())) == sorted(map(tuple, batch.collect()))
    once = ledger.admitted(ledger.stream_of(spark, str(tmp_path / "in"), rows.schema), "ts", "1 day", "provider")
    query = once.writeStream.format("memory").queryName("once_out").option("checkpointLocation", str(tmp_path / "state2")).start()
    query.processAllAvailable()
    query.stop()
    assert {r["provider"] for r in spark.table("once_out").collect()} == {0, 1, 2}

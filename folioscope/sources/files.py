"""Files as tables: admission, hashes, images, catalogues, sums. Bytes come from Spark's own readers, so any store will do."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What may come in.
MOST_BYTES, FORMATS, MOST_SIDE = 25 << 20, ["pdf", "jpg", "jpeg", "png"], 4000


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths, sizes and times of files; contents aren't read unless they are selected. Spark leaves out empty files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def admission(path: Column, length: Column) -> Column:
    """Why a file may not come in, or null."""
    return F.when((length <= 0) | (length > MOST_BYTES), "INPUT_SIZE_LIMIT").when(~F.lower(F.substring_index(path, ".", -1)).isin(FORMATS), "UNSUPPORTED_FORMAT")


def admitted(files: DataFrame) -> DataFrame:
    """The files with the code that keeps them out, or null; only path and size are looked at."""
    return files.withColumn("error", admission(F.col("path"), F.col("length")))


def seal(files: DataFrame) -> DataFrame:
    """Paths and the hashes of their contents."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def picture(data: bytes) -> tuple[str | None, int, int, str | None]:
    """Format, width, height and error code of a PNG or JPEG, from its headers."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            kind, (w, h) = "PNG", struct.unpack(">II", data[16:24])
        elif data[:2] == b"\xff\xd8":
            kind, at = "JPEG", 2
            while not (0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC)):
                if data[at] != 0xFF:
                    return kind, 0, 0, "IMAGE_DECODE_ERROR"
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
        else:
            return None, 0, 0, "IMAGE_RESOURCE_LIMIT"
    except (struct.error, IndexError):
        return None, 0, 0, "IMAGE_DECODE_ERROR"
    return kind, w, h, "IMAGE_RESOURCE_LIMIT" if max(w, h) > MOST_SIDE or min(w, h) < 1 else None


def images(files: DataFrame) -> DataFrame:
    """path, format, width, height and error of image files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *picture(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "format", "width", "height", "error"])

    return files.select("path", "content").mapInPandas(read, "path string, format string, width long, height long, error string")


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files that hold one object each; a file that isn't one has it in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", "true").json(path)


def csv_catalog(spark: SparkSession, path: str, lists: list[str]) -> DataFrame:
    """A catalogue in CSV whose list columns hold items between semicolons."""
    rows = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    return rows.withColumns({c: F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "") for c in lists})


def markdown_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Tickets in Markdown: a level-two heading with an id and a title, then bullets ``name: value``."""
    whole = spark.read.text(path, wholetext=True)
    blocks = whole.select(F.explode(F.split("value", r"(?m)^(?=## )")).alias("block")).where(F.col("block").startswith("## "))
    head = lambda group: F.regexp_extract("block", r"^## +([A-Za-z0-9_-]+)[ :]+(.*)", group)
    keys, values = (F.regexp_extract_all("block", F.lit(r"(?m)^[-*] +([^:\n]+): *(.*)$"), F.lit(g)) for g in (1, 2))
    return blocks.select(head(1).alias("id"), F.trim(head(2)).alias("title"), F.map_from_arrays(F.transform(keys, F.lower), values).alias("fields"))


def sums(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a SHA256SUMS file as name and digest."""
    line = F.regexp_extract("value", r"^([0-9a-f]{64}) [ *](.+)$", 0)
    rows = spark.read.text(path).where(line != "")
    return rows.select(F.regexp_extract("value", r"^([0-9a-f]{64}) [ *](.+)$", 2).alias("name"), F.substring("value", 1, 64).alias("sha256"))

"""Where the regions of a page go: to recognition, to inspection, or as they are."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SIDES, by_page, closure, grown_over, overlaps

REASONS = ["UNTRUSTED_NATIVE_RUN", "IMAGE_PURPOSE_UNKNOWN", "VECTOR_TEXT_REVIEW", "VECTOR_FIGURE", "OVERLAPPING_SOURCE_REVIEW"]
ROUTES = ["ocr", "inspect", "inspect", "preserve", "inspect"]


def page_regions(kind: np.ndarray, trusted: np.ndarray, width: float, height: float, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regions of a page and their reasons, from boxes of text runs (1), paths (2) and images (3).

    Untrusted runs are regions, as are clusters of images, and of paths that meet no image; a frame around the page is no figure. A region
    grows over every run that it touches, and regions that then overlap become one.
    """
    text = boxes[kind == 1]
    frame = (boxes[:, :2] <= np.array([width, height]) * 0.03).all(axis=1) & (boxes[:, 2:] >= np.array([width, height]) * 0.97).all(axis=1)
    images, paths = closure(boxes[kind == 3], 10.0)[0], closure(boxes[(kind == 2) & ~frame], 10.0)[0]
    if len(paths) and len(boxes[kind == 3]):
        paths = paths[~overlaps(paths, boxes[kind == 3]).any(axis=1)]
    meets = overlaps(paths, text).any(axis=1) if len(paths) and len(text) else np.zeros(len(paths), bool)
    untrusted = boxes[(kind == 1) & ~trusted]
    found = np.concatenate([untrusted, images, paths]).reshape(-1, 4)
    reason = np.concatenate([np.zeros(len(untrusted)), np.ones(len(images)), np.where(meets, 2, 3)]).astype(np.int64)
    grown = np.array([grown_over(b, text) for b in found]).reshape(-1, 4)
    merged, counts = closure(grown, 0.0)
    own = np.array([reason[(grown == m).all(axis=1)][0] if n == 1 else 4 for m, n in zip(merged, counts, strict=True)], np.int64)
    return merged, own


def regions(objects: DataFrame, key: str) -> DataFrame:
    """The regions of each page: key, ordinal, sides, route, reason and budget, from rows (key, type, trusted, width, height, sides)."""

    def run(kind: np.ndarray, trusted: np.ndarray, width: np.ndarray, height: np.ndarray, *sides: np.ndarray) -> list[np.ndarray]:
        found, reason = page_regions(kind, trusted.astype(bool), width[0], height[0], np.stack(sides, axis=1))
        return [np.arange(1, len(found) + 1), *found.T, reason]

    own = objects.withColumn("trusted", F.col("trusted").cast("int"))
    found = by_page(own, key, ["type", "trusted", "width", "height", *SIDES], "ordinal long, x0 double, y0 double, x1 double, y1 double, code long", run)
    pick = lambda names: F.get(F.array(*map(F.lit, names)), F.col("code").cast("int"))
    return found.withColumns({"route": pick(ROUTES), "reason": pick(REASONS)}).withColumn("budget", F.when(F.col("route") == "preserve", 0).otherwise(2)).drop("code")

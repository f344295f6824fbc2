"""What a page shows, from tables of its runs and objects: frames, boxes in page space, and single pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def page_geometry(visible: g.Box, rotation: Column) -> tuple[Column, Column, Column]:
    """Width and height of a page as it is shown, and INVALID_PAGE_SIZE where they aren't positive and finite."""
    w, h = visible.x1 - visible.x0, visible.y1 - visible.y0
    turned = F.pmod(rotation, F.lit(180)) == 90
    width, height = F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)
    fine = F.coalesce(g.finite(w) & g.finite(h) & (w > 0) & (h > 0), F.lit(False))
    return width, height, F.when(~fine, F.lit("INVALID_PAGE_SIZE"))


def observed_runs(runs: DataFrame, visible: g.Box, rotation: Column) -> DataFrame:
    """Runs (x, y, width, height, frame_rotation, advance_known) with their box in the page's frame and whether it is verified.

    A run that was read in a turned frame is turned back first; a box is verified if the advance is known and it lies in the page, one point over at most.
    """
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    ccw, cw = F.col("frame_rotation") == "ccw", F.col("frame_rotation") == "cw"
    left = F.when(ccw, -y - h).when(cw, y).otherwise(x)
    low = F.when(ccw, x).when(cw, -x - w).otherwise(y)
    wide, high = F.when(ccw | cw, h).otherwise(w), F.when(ccw | cw, w).otherwise(h)
    raw = g.Box(visible.x0 + left, visible.y0 + low, visible.x0 + left + wide, visible.y0 + low + high)
    b = g.rotated(raw, rotation, visible)
    width, height, _ = page_geometry(visible, rotation)
    inside = (b.x0 >= 0) & (b.x0 < b.x1) & (b.x1 <= width + 1) & (b.y0 >= 0) & (b.y0 < b.y1) & (b.y1 <= height + 1)
    return runs.withColumns({"x0": b.x0, "y0": b.y0, "x1": b.x1, "y1": b.y1, "geometry_verified": F.col("advance_known") & inside})


def single_page(pages: DataFrame, wanted: DataFrame, key: str, index: str) -> DataFrame:
    """For each wanted page whether its document has it: key, index, and PAGE_OUT_OF_RANGE or null."""
    counts = pages.groupBy(key).agg(F.count("*").alias("page_count"))
    outside = (F.col(index) < 0) | (F.col(index) >= F.coalesce("page_count", F.lit(0)))
    return wanted.join(counts, key, "left").select(key, index, F.when(outside, F.lit("PAGE_OUT_OF_RANGE")).alias("error"))


def single_input(files: DataFrame, key: str, name: str) -> DataFrame:
    """The one staged input of each folder; folders with none or several have AMBIGUOUS_INPUT."""
    staged = F.when(F.col(name).startswith("input."), F.col(name))
    found = files.groupBy(key).agg(F.count(staged).alias("n"), F.min(staged).alias("file"))
    return found.select(key, F.when(F.col("n") == 1, F.col("file")).alias("file"), F.when(F.col("n") != 1, F.lit("AMBIGUOUS_INPUT")).alias("error"))

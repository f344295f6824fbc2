"""Set operators on the boxes of a page: envelopes, union areas, cells, matching edges, layout checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def envelope(boxes: DataFrame, *keys: str) -> DataFrame:
    """The box around all boxes of each group."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def union_area(boxes: DataFrame, *keys: str) -> DataFrame:
    """The area that a group's boxes cover, overlaps counted once: vertical strips between all distinct sides.

    In a strip the boxes that span it are merged along y by a running maximum of their lower ends. Groups are partitioned once, by
    their keys; within a page the work is boxes times strips.
    """
    edges = boxes.select(*keys, F.explode(F.array("x0", "x1")).alias("left")).distinct()
    strips = edges.withColumn("right", F.lead("left").over(Window.partitionBy(*keys).orderBy("left"))).where(F.col("right").isNotNull())
    spans = strips.join(boxes.select(*keys, "x0", "y0", "x1", "y1"), list(keys)).where((F.col("x0") < F.col("right")) & (F.col("x1") > F.col("left")))
    above = Window.partitionBy(*keys, "left").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("y0"), F.coalesce(F.max("y1").over(above), F.col("y0")))
    parts = spans.withColumn("piece", (F.col("right") - F.col("left")) * F.greatest(F.lit(0.0), F.col("y1") - reached))
    return parts.groupBy(*keys).agg(F.sum("piece").alias("union_area"))


def fallback_ratio(boxes: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """The share of each page that its boxes cover after clamping to the page; pages hold width and height."""
    on = boxes.join(pages, key)
    inside = g.clamped(g.Box.of(), F.col("width"), F.col("height"))
    clamped = on.select(key, "width", "height", *inside.named("c"))
    clamped = clamped.select(key, *(F.col(f"c{s}").alias(s) for s in ("x0", "y0", "x1", "y1"))).where("x1 > x0 and y1 > y0")
    covered = union_area(clamped, key)
    return pages.join(covered, key).select(key, (F.col("union_area") / (F.col("width") * F.col("height"))).alias("ratio"))


def cells(boxes: DataFrame, gap: float, *keys: str) -> DataFrame:
    """Boxes merged along x where the gap to what lies left of them is at most ``gap``: cell number from 1, x0, x1 and n."""
    order = Window.partitionBy(*keys).orderBy("x0", "x1", "y0", "y1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = boxes.withColumn("start", F.when(F.col("x0") - F.coalesce(reach, F.col("x0") - gap - 1) > gap, 1).otherwise(0))
    numbered = starts.withColumn("cell", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return numbered.groupBy(*keys, "cell").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n"))


def line_tolerances(boxes: DataFrame, *keys: str) -> DataFrame:
    """The median height of line-like boxes, 16 without any, and the tolerances that follow from it."""
    height = F.col("y1") - F.col("y0")
    line = F.coalesce(F.median(F.when(height.between(6, 30), height)), F.lit(16.0))
    found = boxes.groupBy(*keys).agg(line.alias("line"))
    within = lambda c, low, high: F.least(F.lit(high), F.greatest(F.lit(low), c))
    return found.select(*keys, "line", within(F.col("line") * 0.5, 6.0, 10.0).alias("cell_gap"), within(F.col("line") * 0.375, 4.0, 8.0).alias("stem_tolerance"))


def pairs(left: DataFrame, right: DataFrame, key: str, condition) -> DataFrame:
    """Pairs of a page's boxes, with sides and ids prefixed a_ and b_, that meet a condition on the two boxes: an equi-join on the page."""
    a = left.select(F.col(key), *(F.col(c).alias(f"a_{c}") for c in left.columns if c != key))
    b = right.select(F.col(key), *(F.col(c).alias(f"b_{c}") for c in right.columns if c != key))
    return a.join(b, key).where(condition(g.Box.of("a_"), g.Box.of("b_")))


def iou_edges(truth: DataFrame, found: DataFrame, key: str, threshold: float) -> DataFrame:
    """Pairs of one class whose intersection over union reaches a threshold."""
    edges = pairs(truth, found, key, lambda a, b: (F.col("a_label") == F.col("b_label")) & (g.iou(a, b) >= threshold))
    return edges.withColumn("iou", g.iou(g.Box.of("a_"), g.Box.of("b_")))


def merged_or_split(truth: DataFrame, found: DataFrame, key: str, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Found boxes that hold at least a share of several true ones, and true boxes that several found ones lie in to that share."""
    holds = lambda whole: pairs(truth, found, key, lambda a, b: g.overlap(a, b) / g.area(a if whole == "a" else b) >= share)
    merges = holds("a").groupBy(key, F.col("b_box_id").alias("box_id")).agg(F.count("*").alias("n")).where("n > 1")
    splits = holds("b").groupBy(key, F.col("a_box_id").alias("box_id")).agg(F.count("*").alias("n")).where("n > 1")
    return merges, splits


def preflight(boxes: DataFrame, pages: DataFrame, key: str, text_label: str = "text") -> DataFrame:
    """The first layout fault of each page that has one: a box off the page, doubled boxes of one label, text side by side."""
    on = boxes.join(pages, key)
    b = g.Box.of()
    outside = on.where(~((b.x0 >= 0) & (b.x0 < b.x1) & (b.x1 <= F.col("width")) & (b.y0 >= 0) & (b.y0 < b.y1) & (b.y1 <= F.col("height")))).select(key, F.lit(1).alias("rank"))

    def fault(a: g.Box, b: g.Box) -> Column:
        shared = g.overlap(a, b)
        doubled = shared / (g.area(a) + g.area(b) - shared) > 0.9
        wide = F.least(a.x1 - a.x0, b.x1 - b.x0) >= F.col("a_width") * 0.25
        level = (F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)) / F.least(a.y1 - a.y0, b.y1 - b.y0) > 0.5
        apart = F.greatest(a.x0, b.x0) - F.least(a.x1, b.x1) > F.col("a_width") * 0.02
        beside = (F.col("a_label") == text_label) & wide & level & apart
        return F.when(F.col("a_label") != F.col("b_label"), F.lit(None)).when(doubled, 2).when(beside, 3)

    found = pairs(on, boxes, key, lambda a, b: (F.col("a_box_id") < F.col("b_box_id")) & fault(a, b).isNotNull())
    faults = outside.union(found.select(key, fault(g.Box.of("a_"), g.Box.of("b_")).alias("rank")))
    codes = F.when(F.col("rank") == 1, "PP_REGION_OUT_OF_PAGE").when(F.col("rank") == 2, "DUPLICATE_PP_REGION").otherwise("MULTICOLUMN_LAYOUT_REVIEW")
    return faults.groupBy(key).agg(F.min("rank").alias("rank")).select(key, codes.alias("code"))


def owned(parts: DataFrame, wholes: DataFrame, key: str, share: float, of: str = "part") -> DataFrame:
    """Which whole a part lies in by more than a share of its area (or, for ``smaller``, at least a share of the smaller area): all pairs, with
    whether the part has just one."""
    def inside(a: g.Box, b: g.Box) -> Column:
        shared = g.overlap(a, b)
        return shared / g.area(a) > share if of == "part" else shared / F.least(g.area(a), g.area(b)) >= share

    found = pairs(parts, wholes, key, inside)
    return found.withColumn("unique", F.count("*").over(Window.partitionBy(key, "a_box_id")) == 1)


def reading_order(boxes: DataFrame, *keys: str) -> DataFrame:
    """Numbers boxes from 1 from top to bottom, then left to right, then by id."""
    return boxes.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy("y0", "x0", "box_id")).cast("long"))


def falls(boxes: DataFrame, *keys: str) -> DataFrame:
    """Groups whose boxes, by id, don't go strictly down, and how often they don't."""
    before = F.lag("y0").over(Window.partitionBy(*keys).orderBy("box_id"))
    return boxes.withColumn("up", F.col("y0") <= before).where("up").groupBy(*keys).agg(F.count("*").alias("n"))


def frame_like(b: g.Box, width: Column, height: Column) -> Column:
    """Whether a box spans nearly the whole page, as a frame does."""
    return (b.x0 <= width * 0.03) & (b.y0 <= height * 0.03) & (b.x1 >= width * 0.97) & (b.y1 >= height * 0.97)


def column_gaps(boxes: DataFrame, size: float, *keys: str) -> DataFrame:
    """Gaps between neighbours along x that are wide enough to part columns."""
    after = F.lead("x0").over(Window.partitionBy(*keys).orderBy("x0", "x1", "y0", "y1", "box_id"))
    return boxes.withColumn("gap", after - F.col("x1")).where(F.col("gap") > F.greatest(F.lit(40.0), F.lit(4.0 * size)))

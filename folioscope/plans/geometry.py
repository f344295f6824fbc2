"""Queries on boxes, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import boxes as ops
from .views import BOXES, PRED, boxes, predicted

WIDTH = HEIGHT = 50.0

UNION_AREA = """edges AS (SELECT DISTINCT page_id, x AS xl FROM (SELECT page_id, x0 AS x FROM src UNION ALL SELECT page_id, x1 FROM src)),
strips AS (SELECT page_id, xl, lead(xl) OVER (PARTITION BY page_id ORDER BY xl) AS xr FROM edges),
spans AS (SELECT s.page_id, s.xl, s.xr, b.y0, b.y1, max(b.y1) OVER (PARTITION BY s.page_id, s.xl ORDER BY b.y0, b.y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
  FROM strips s JOIN src b ON b.page_id = s.page_id AND b.x0 < s.xr AND b.x1 > s.xl WHERE s.xr IS NOT NULL),
covered AS (SELECT page_id, sum((xr - xl) * greatest(0.0, y1 - greatest(y0, coalesce(reached, y0)))) AS union_area FROM spans GROUP BY page_id)"""
IOU = """(CASE WHEN {u} > 0 THEN {o} / {u} ELSE 0.0 END)"""
OVERLAP = "(greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"
AREA = "(greatest(0.0, {t}.x1 - {t}.x0) * greatest(0.0, {t}.y1 - {t}.y0))"
UNION = f"({AREA.format(t='a')} + {AREA.format(t='b')} - {OVERLAP})"
PAIR_IOU = IOU.format(u=UNION, o=OVERLAP)


def pages(df: DataFrame) -> DataFrame:
    return df.select("page_id").distinct().select("page_id", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def geo_union(spark: SparkSession, d: str) -> DataFrame:
    return ops.envelope(boxes(spark, d), "page_id")


def geo_union_area(spark: SparkSession, d: str) -> DataFrame:
    return ops.union_area(boxes(spark, d), "page_id")


def agg_fallback_ratio(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    return ops.fallback_ratio(b, pages(b), "page_id")


def geo_box_valid(spark: SparkSession, d: str) -> DataFrame:
    odd = boxes(spark, d).withColumn("x1", F.when(F.col("box_id") % 5 == 0, F.col("x0")).when(F.col("box_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("x1")))
    return odd.select("page_id", "box_id", g.valid(g.Box.of()).alias("valid"))


def geo_bbox_error(spark: SparkSession, d: str) -> DataFrame:
    odd = boxes(spark, d).withColumn("x1", F.when(F.col("box_id") % 5 == 0, F.col("x0")).when(F.col("box_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("x1")))
    return odd.select("page_id", "box_id", g.error_code(g.Box.of(), F.lit(WIDTH), F.lit(HEIGHT)).alias("error"))


def geo_transform(spark: SparkSession, d: str) -> DataFrame:
    sx = F.when(F.col("box_id") % 6 == 0, 0.0).otherwise(0.5)
    return boxes(spark, d).select("page_id", "box_id", *g.scaled(g.Box.of(), sx, F.lit(2.0)).named())


def geo_area(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("page_id", "box_id", g.area(g.Box.of()).alias("area"))


def geo_intersection(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    found = ops.pairs(b, b, "page_id", lambda x, y: (F.col("a_box_id") < F.col("b_box_id")) & (g.overlap(x, y) > 0))
    return found.select("page_id", F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"), g.overlap(g.Box.of("a_"), g.Box.of("b_")).alias("overlap"))


def geo_iou(spark: SparkSession, d: str) -> DataFrame:
    b, p = boxes(spark, d), predicted(spark, d)
    found = ops.pairs(b, p, "page_id", lambda x, y: g.iou(x, y) >= 0.5)
    return found.select("page_id", F.col("a_box_id").alias("g"), F.col("b_box_id").alias("p"), g.iou(g.Box.of("a_"), g.Box.of("b_")).alias("iou"))


def geo_rotate(spark: SparkSession, d: str) -> DataFrame:
    turned = boxes(spark, d).withColumn("rotation", F.explode(F.array(*(F.lit(r).cast("long") for r in (0, 90, 180, 270)))))
    visible = g.Box(F.lit(0.0), F.lit(0.0), F.lit(60.0), F.lit(80.0))
    return turned.select("page_id", "box_id", "rotation", *g.rotated(g.Box.of(), F.col("rotation"), visible).named())


def geo_quad_envelope(spark: SparkSession, d: str) -> DataFrame:
    turned = boxes(spark, d).withColumn("rotation", (F.col("box_id") % 4) * 90)
    visible = g.Box(F.lit(0.0), F.lit(0.0), F.lit(60.0), F.lit(80.0))
    inner = turned.select("page_id", "box_id", "rotation", *g.rotated(g.Box.of(), F.col("rotation"), visible).named())
    return inner.select("page_id", "box_id", *g.unrotated(g.Box.of(), F.col("rotation"), visible).named())


def geo_normalize01(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("page_id", "box_id", *g.normalized(g.Box.of(), F.lit(64.0), F.lit(32.0)).named())


def geo_clamp(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("page_id", "box_id", *g.clamped(g.Box.of(), F.lit(WIDTH), F.lit(HEIGHT)).named())


def sink_crop(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("page_id", "box_id", *g.crop_pixels(g.Box.of(), 1.5, 4, F.lit(80.0), F.lit(90.0)).named())


def geo_cells_of(spark: SparkSession, d: str) -> DataFrame:
    return ops.cells(boxes(spark, d), 8.0, "page_id")


def geo_line_tolerance(spark: SparkSession, d: str) -> DataFrame:
    return ops.line_tolerances(boxes(spark, d), "page_id")


def join_merge_split(spark: SparkSession, d: str) -> DataFrame:
    merges, splits = ops.merged_or_split(boxes(spark, d), predicted(spark, d), "page_id")
    return merges.withColumn("kind", F.lit("merge")).union(splits.withColumn("kind", F.lit("split")))


def layout_preflight(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    return ops.preflight(b, pages(b).withColumns({"width": F.lit(70.0), "height": F.lit(62.0)}), "page_id", text_label="N")


def join_anchor_block(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    found = ops.owned(b.where("label = 'R'"), b.where("label = 'A'"), "page_id", 0.5, of="smaller")
    return found.select("page_id", F.col("a_box_id").alias("block"), F.col("b_box_id").alias("anchor"), "unique")


def join_line_owner(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    found = ops.owned(b.where("label = 'R'"), b.where("label = 'N'"), "page_id", 0.75)
    return found.select("page_id", F.col("a_box_id").alias("line"), F.col("b_box_id").alias("owner"))


def join_fine_region(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    found = ops.owned(b.where("label = 'A'"), b.where("label = 'N'"), "page_id", 0.5)
    return found.select("page_id", F.col("a_box_id").alias("fine"), F.col("b_box_id").alias("region"))


def win_reading_order(spark: SparkSession, d: str) -> DataFrame:
    return ops.reading_order(boxes(spark, d), "page_id").select("page_id", "box_id", "ordinal")


def win_monotone(spark: SparkSession, d: str) -> DataFrame:
    return ops.falls(boxes(spark, d), "page_id")


def win_column_gap(spark: SparkSession, d: str) -> DataFrame:
    found = ops.column_gaps(boxes(spark, d).withColumns({"x0": F.col("x0") * 4, "x1": F.col("x1") * 2}), 3.0, "page_id")
    return found.select("page_id", "box_id", "gap")


def route_frame_filter(spark: SparkSession, d: str) -> DataFrame:
    b = g.Box.of()
    return boxes(spark, d).where(~ops.frame_like(b, F.lit(20.0), F.lit(10.0)) & ~ops.frame_like(b, F.lit(600.0), F.lit(800.0))).select("page_id", "box_id")


QUERIES = [
    geo_union, geo_union_area, agg_fallback_ratio, geo_box_valid, geo_bbox_error, geo_transform, geo_area, geo_intersection, geo_iou, geo_rotate, geo_quad_envelope, geo_normalize01, geo_clamp, sink_crop,
    geo_cells_of, geo_line_tolerance, join_merge_split, layout_preflight, join_anchor_block, join_line_owner, join_fine_region, win_reading_order, win_monotone, win_column_gap, route_frame_filter,
]

_TURN = """CASE r WHEN 0 THEN [x0, 80 - y1, x1, 80 - y0] WHEN 90 THEN [y0, x0, y1, x1] WHEN 180 THEN [60 - x1, y0, 60 - x0, y1] ELSE [80 - y1, 60 - x1, 80 - y0, 60 - x0] END"""
_OWNED = f"""SELECT a.page_id, a.box_id AS {{one}}, b.box_id AS {{two}}{{more}} FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.label = '{{la}}' AND b.label = '{{lb}}' AND {OVERLAP} / {{of}} {{than}}"""

ORACLES = {
    "geo_union": f"WITH {BOXES} SELECT page_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY page_id",
    "geo_union_area": f"WITH {BOXES}, src AS (SELECT * FROM boxes), {UNION_AREA} SELECT page_id, union_area FROM covered",
    "agg_fallback_ratio": f"WITH {BOXES}, src AS (SELECT * FROM (SELECT page_id, greatest(0.0, least(x0, 50.0)) AS x0, greatest(0.0, least(y0, 50.0)) AS y0, greatest(0.0, least(x1, 50.0)) AS x1, greatest(0.0, least(y1, 50.0)) AS y1 FROM boxes) WHERE x1 > x0 AND y1 > y0), {UNION_AREA} SELECT page_id, union_area / 2500.0 AS ratio FROM covered",
    "geo_box_valid": f"WITH {BOXES} SELECT page_id, box_id, (box_id % 5 <> 0 AND box_id % 7 <> 0 AND y1 > y0 AND x1 > x0) AS valid FROM boxes",
    "geo_bbox_error": f"WITH {BOXES} SELECT page_id, box_id, CASE WHEN box_id % 5 = 0 THEN 'NONPOSITIVE_BBOX' WHEN box_id % 7 = 0 THEN 'NONFINITE_BBOX' WHEN x0 < 0 OR y0 < 0 OR x1 > 50 OR y1 > 50 THEN 'OUT_OF_BOUNDS_BBOX' END AS error FROM boxes",
    "geo_transform": f"WITH {BOXES} SELECT page_id, box_id, CASE WHEN box_id % 6 <> 0 THEN x0 * 0.5 END AS x0, CASE WHEN box_id % 6 <> 0 THEN y0 * 2 END AS y0, CASE WHEN box_id % 6 <> 0 THEN x1 * 0.5 END AS x1, CASE WHEN box_id % 6 <> 0 THEN y1 * 2 END AS y1 FROM boxes",
    "geo_area": f"WITH {BOXES} SELECT page_id, box_id, (x1 - x0) * (y1 - y0) AS area FROM boxes",
    "geo_intersection": f"WITH {BOXES} SELECT a.page_id, a.box_id AS a, b.box_id AS b, {OVERLAP} AS overlap FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_id < b.box_id AND {OVERLAP} > 0",
    "geo_iou": f"WITH {BOXES}, {PRED} SELECT a.page_id, a.box_id AS g, b.box_id AS p, {PAIR_IOU} AS iou FROM boxes a JOIN pred b ON a.page_id = b.page_id AND {PAIR_IOU} >= CAST(0.5 AS DOUBLE)",
    "geo_rotate": f"WITH {BOXES}, t AS (SELECT page_id, box_id, r, {_TURN} AS q FROM boxes CROSS JOIN (SELECT unnest([0, 90, 180, 270]) AS r)) SELECT page_id, box_id, CAST(r AS BIGINT) AS rotation, CAST(q[1] AS DOUBLE) AS x0, CAST(q[2] AS DOUBLE) AS y0, CAST(q[3] AS DOUBLE) AS x1, CAST(q[4] AS DOUBLE) AS y1 FROM t",
    "geo_quad_envelope": f"WITH {BOXES} SELECT page_id, box_id, x0, y0, x1, y1 FROM boxes",
    "geo_normalize01": f"WITH {BOXES}, t AS (SELECT *, x0 >= 0 AND y0 >= 0 AND x1 <= 64 AND y1 <= 32 AS ok FROM boxes) SELECT page_id, box_id, CASE WHEN ok THEN x0 / 64 END AS x0, CASE WHEN ok THEN y0 / 32 END AS y0, CASE WHEN ok THEN x1 / 64 END AS x1, CASE WHEN ok THEN y1 / 32 END AS y1 FROM t",
    "geo_clamp": f"WITH {BOXES} SELECT page_id, box_id, greatest(0.0, least(x0, 50.0)) AS x0, greatest(0.0, least(y0, 50.0)) AS y0, greatest(0.0, least(x1, 50.0)) AS x1, greatest(0.0, least(y1, 50.0)) AS y1 FROM boxes",
    "sink_crop": f"WITH {BOXES} SELECT page_id, box_id, greatest(0.0, floor(x0 * CAST(1.5 AS DOUBLE)) - 4) AS x0, greatest(0.0, floor(y0 * CAST(1.5 AS DOUBLE)) - 4) AS y0, least(80.0, ceil(x1 * CAST(1.5 AS DOUBLE)) + 4) AS x1, least(90.0, ceil(y1 * CAST(1.5 AS DOUBLE)) + 4) AS y1 FROM boxes",
    "geo_cells_of": f"""WITH {BOXES}, r AS (SELECT *, max(x1) OVER (PARTITION BY page_id ORDER BY x0, x1, y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM boxes),
s AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 - reach > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY x0, x1, y0, y1 ROWS UNBOUNDED PRECEDING) AS c FROM r)
SELECT page_id, CAST(c AS BIGINT) AS cell, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM s GROUP BY page_id, c""",
    "geo_line_tolerance": f"WITH {BOXES}, t AS (SELECT page_id, coalesce(median(y1 - y0) FILTER (WHERE y1 - y0 BETWEEN 6 AND 30), CAST(16 AS DOUBLE)) AS line FROM boxes GROUP BY page_id) SELECT page_id, line, least(CAST(10 AS DOUBLE), greatest(CAST(6 AS DOUBLE), line * CAST(0.5 AS DOUBLE))) AS cell_gap, least(CAST(8 AS DOUBLE), greatest(CAST(4 AS DOUBLE), line * CAST(0.375 AS DOUBLE))) AS stem_tolerance FROM t",
    "join_merge_split": f"""WITH {BOXES}, {PRED} SELECT a.page_id, b.box_id, count(*) AS n, 'merge' AS kind FROM boxes a JOIN pred b ON a.page_id = b.page_id AND {OVERLAP} / {AREA.format(t='a')} >= 0.5 GROUP BY a.page_id, b.box_id HAVING count(*) > 1
UNION ALL SELECT a.page_id, a.box_id, count(*), 'split' FROM boxes a JOIN pred b ON a.page_id = b.page_id AND {OVERLAP} / {AREA.format(t='b')} >= 0.5 GROUP BY a.page_id, a.box_id HAVING count(*) > 1""",
    "layout_preflight": f"""WITH {BOXES}, f AS (SELECT page_id, 1 AS r FROM boxes WHERE NOT (x0 >= 0 AND x0 < x1 AND x1 <= 70 AND y0 >= 0 AND y0 < y1 AND y1 <= 62)
UNION ALL SELECT a.page_id, CASE WHEN {OVERLAP} / {UNION} > 0.9 THEN 2 ELSE 3 END FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_id < b.box_id AND a.label = b.label AND ({OVERLAP} / {UNION} > 0.9 OR
(a.label = 'N' AND least(a.x1 - a.x0, b.x1 - b.x0) >= 17.5 AND (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) > 0.5 AND greatest(a.x0, b.x0) - least(a.x1, b.x1) > 1.4)))
SELECT page_id, CASE min(r) WHEN 1 THEN 'PP_REGION_OUT_OF_PAGE' WHEN 2 THEN 'DUPLICATE_PP_REGION' ELSE 'MULTICOLUMN_LAYOUT_REVIEW' END AS code FROM f GROUP BY page_id""",
    "join_anchor_block": f"WITH {BOXES} " + _OWNED.format(one="block", two="anchor", la="R", lb="A", of=f"least({AREA.format(t='a')}, {AREA.format(t='b')})", than=">= 0.5", more=", count(*) OVER (PARTITION BY a.page_id, a.box_id) = 1 AS \"unique\""),
    "join_line_owner": f"WITH {BOXES} " + _OWNED.format(one="line", two="owner", la="R", lb="N", of=AREA.format(t="a"), than="> 0.75", more=""),
    "join_fine_region": f"WITH {BOXES} " + _OWNED.format(one="fine", two="region", la="A", lb="N", of=AREA.format(t="a"), than="> 0.5", more=""),
    "win_reading_order": f"WITH {BOXES} SELECT page_id, box_id, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, box_id) AS ordinal FROM boxes",
    "win_monotone": f"WITH {BOXES}, t AS (SELECT page_id, y0 <= lag(y0) OVER (PARTITION BY page_id ORDER BY box_id) AS up FROM boxes) SELECT page_id, count(*) AS n FROM t WHERE up GROUP BY page_id",
    "win_column_gap": f"WITH {BOXES}, t AS (SELECT page_id, box_id, lead(x0 * 4) OVER (PARTITION BY page_id ORDER BY x0 * 4, x1 * 2, y0, y1, box_id) - x1 * 2 AS gap FROM boxes) SELECT page_id, box_id, gap FROM t WHERE gap > 40",
    "route_frame_filter": f"WITH {BOXES} SELECT page_id, box_id FROM boxes WHERE NOT (x0 <= 0.6 AND y0 <= 0.3 AND x1 >= 19.4 AND y1 >= 9.7) AND NOT (x0 <= 18 AND y0 <= 24 AND x1 >= 582 AND y1 >= 776)",
}

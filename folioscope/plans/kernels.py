"""Queries that need kernels; those without an oracle are compared with hand-written rows in the tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boxes as box_ops
from ..operators import kernels as k
from ..operators import pages as page_ops
from ..operators import markdown, revision, routing, styles
from .geometry import UNION_AREA
from .views import BOXES, boxes, predicted, runs, table, turns


def geo_cluster_regions(spark: SparkSession, d: str) -> DataFrame:
    return k.clustered(boxes(spark, d), "page_id", gap=10.0)


def geo_merge_requests(spark: SparkSession, d: str) -> DataFrame:
    merged = k.clustered(boxes(spark, d), "page_id", gap=0.0)
    return merged.withColumn("reason", F.when(F.col("n") > 1, "OVERLAPPING_SOURCE_REVIEW"))


def geo_rows_of(spark: SparkSession, d: str) -> DataFrame:
    return k.in_rows(boxes(spark, d), "page_id")


def join_greedy_iou(spark: SparkSession, d: str) -> DataFrame:
    edges = box_ops.iou_edges(boxes(spark, d), predicted(spark, d), "page_id", 0.3)
    return k.matched(edges.select("page_id", F.col("a_box_id").cast("string").alias("gt_id"), F.col("b_box_id").cast("string").alias("prediction_id"), "iou"), "page_id")


def txt_abnormal(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("�"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", k.abnormal_text(odd).alias("abnormal"))


def txt_cer_sdi(spark: SparkSession, d: str) -> DataFrame:
    lines = runs(spark, d)
    a, b = (lines.where(F.col("ord") == i).select("doc_id", F.col("text").alias(f"t{i}")) for i in (1, 2))
    return a.join(b, "doc_id").select("doc_id", k.edit_struct(F.col("t1"), F.col("t2")).alias("e")).select("doc_id", "e.substitutions", "e.deletions", "e.insertions", "e.distance")


def txt_similarity(spark: SparkSession, d: str) -> DataFrame:
    own = turns(spark, d)
    after = own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return own.join(after, ["conv_id", "turn"]).select("conv_id", "turn", k.similarity(F.col("text"), F.col("next")).alias("ratio"))


def prj_wire_shape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", k.json_shape(F.col("props")).alias("shape"))


def prj_strip_media(spark: SparkSession, d: str) -> DataFrame:
    nested = F.to_json(F.struct(F.col("url").alias("link"), F.lit("x").alias("image"), F.struct(F.length("html").alias("n")).alias("page")))
    return table(spark, d, "pages").select("page_id", k.json_without_media(nested).alias("value"))


def cls_page(spark: SparkSession, d: str) -> DataFrame:
    """Pages of boxes: N boxes are text, A boxes images, R boxes runs."""
    own = boxes(spark, d)
    pages = own.select("page_id").distinct().select("page_id", F.when(F.col("page_id") % 10 == 0, "FAILED").otherwise("OK").alias("status"), F.lit(80.0).alias("width"), F.lit(80.0).alias("height"))
    found = own.where("label = 'R'").withColumns({"text": F.when(F.col("page_id") % 7 == 0, F.lit("�")).otherwise(F.lit("a")), "geometry_verified": F.col("box_id") % 3 > 0})
    seen = page_ops.visibility(F.when(F.col("box_id") % 2 == 0, 3).otherwise(0), F.lit(255), F.col("x0") * 5)
    objects = own.where("label <> 'R'").withColumns({"type": F.when(F.col("label") == "N", 1).otherwise(3), "visibility": seen, "level": (F.col("box_id") % 5 == 0).cast("int")})
    return page_ops.classified(pages, found, objects).withColumn("reason_codes", F.array_join("reason_codes", ","))


def rev_apply(spark: SparkSession, d: str) -> DataFrame:
    lines = runs(spark, d).select(F.col("doc_id").alias("document_id"), "ord", F.concat(F.lit("b"), "ord").alias("id"), "text", F.lit("flow").alias("policy"))
    docs = lines.select("document_id").distinct()
    edit = lambda n, **op: docs.select("document_id", F.lit(n).alias("ord"), F.to_json(F.struct(*(F.lit(v).alias(c) for c, v in op.items()))).alias("operation"))
    edits = edit(1, action="text", block_id="b1", reason="typo", text="fixed").union(edit(2, action="merge", block_id="b1", reason="one line"))
    return revision.applied(lines, edits)


QUERIES = [geo_cluster_regions, geo_merge_requests, geo_rows_of, join_greedy_iou, txt_abnormal, txt_cer_sdi, txt_similarity, prj_wire_shape, prj_strip_media, cls_page, rev_apply]

ORACLES = {
    "txt_abnormal": r"SELECT doc_id, doc_id % 9 = 0 OR regexp_matches(text, '[\x{FFFD}\x{E000}-\x{F8FF}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{00A0}\x{00AD}\x{200B}\x{200E}\x{200F}\x{2028}\x{2029}\x{FEFF}]') AS abnormal FROM documents",
    "prj_strip_media": """SELECT page_id, '{"link": "' || CASE WHEN regexp_matches(url, '^(https?://|data:)') THEN '[MEDIA_REMOVED]' ELSE url END || '", "page": {"n": ' || length(html) || '}}' AS value FROM pages""",
    "rev_apply": """WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM (SELECT doc_id, CAST(ord AS BIGINT) AS ord, t FROM r))
SELECT doc_id AS document_id, CASE WHEN k = 1 THEN ord WHEN ord = 1 THEN ord ELSE ord - 1 END AS ord, 'b' || ord AS id, CASE WHEN k > 1 AND ord = 1 THEN 'fixed' || (SELECT t FROM n m WHERE m.doc_id = n.doc_id AND m.ord = 2) ELSE t END AS text, 'flow' AS policy, CASE WHEN k = 1 THEN 'INVALID_MERGE' END AS error FROM n WHERE k = 1 OR ord <> 2""",
}


def route_page(spark: SparkSession, d: str) -> DataFrame:
    """Pages of boxes: N boxes are runs, of which some aren't trusted, A boxes images, R boxes paths."""
    kind = F.when(F.col("label") == "N", 1).when(F.col("label") == "R", 2).otherwise(3)
    rows = boxes(spark, d).withColumns({"type": kind, "trusted": F.col("box_id") % 3 > 0, "width": F.lit(80.0), "height": F.lit(80.0)})
    return routing.regions(rows, "page_id")


def prj_ovis(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("# Title\n\n1. "), F.regexp_replace("text", "\n", "\n\n"), F.lit("\n\nA. one B. two $x+1$\n\n第 3 题"))
    return markdown.blocks(table(spark, d, "documents").select("doc_id", marked.alias("text")), "doc_id", "text")


def txt_html_table_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.length(k._unary("string", markdown.visible_text)(F.col("html"))).cast("long").alias("n"))


def vis_style_toggle(spark: SparkSession, d: str) -> DataFrame:
    """Parts as styles: each builds on the one of half its number; every third switches hiding on."""
    own = table(spark, d, "part").select(F.lit(1).alias("document"), F.col("p_partkey").alias("style"))
    parents = own.withColumn("based_on", F.when(F.col("style") > 1, F.floor(F.col("style") / 2).cast("long")))
    toggles = own.withColumn("enabled", F.col("style") % 3 == 0)
    return styles.hidden_styles(styles.chains(parents, "document"), toggles, "document").select("style", "hidden")


QUERIES += [route_page, prj_ovis, txt_html_table_text, vis_style_toggle]
ORACLES["vis_style_toggle"] = """WITH RECURSIVE c(style, a) AS (SELECT p_partkey, p_partkey FROM part UNION ALL SELECT style, a // 2 FROM c WHERE a > 1) SELECT style, count(*) FILTER (WHERE a % 3 = 0 AND a IN (SELECT p_partkey FROM part)) % 2 = 1 AS hidden FROM c GROUP BY style"""


def join_figure_region(spark: SparkSession, d: str) -> DataFrame:
    """For each A box in order the N or R box that it overlaps best."""

    def run(ids, figure, *sides):
        at, b = figure.astype(bool), np.stack(sides, axis=1)
        order = np.lexsort((ids[at],))
        found = k.best_regions(b[at][order], b[~at], least=0.1)
        rows = [(ids[at][order][i], ids[~at][r]) for i, r in enumerate(found) if r is not None]
        return [np.array([r[0] for r in rows], "int64"), np.array([r[1] for r in rows], "int64")]

    own = boxes(spark, d).withColumn("figure", (F.col("label") == "A").cast("int"))
    return k.by_page(own, "page_id", ["box_id", "figure", *k.SIDES], "figure_id long, region long", run)


def agg_component_groups(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a page that share an x cell of 10 or a row of 10, by whatever chain."""
    own = boxes(spark, d).select("page_id", "box_id", F.explode(F.array(F.floor(F.col("x0") / 10), F.floor(F.col("y0") / 10) + 1000)).alias("part"))
    return k.by_page(own.withColumn("part", F.col("part").cast("long")), "page_id", ["box_id", "part"], "box_id long, component long", lambda u, p: list(k.component_numbers(u, p)))


def geo_expand_native(spark: SparkSession, d: str) -> DataFrame:
    """The first box of each page, grown over all it touches."""

    def run(ids, *sides):
        b = np.stack(sides, axis=1)
        return [np.array([x]) for x in k.grown_over(b[ids.argmin()], b)]

    return k.by_page(boxes(spark, d), "page_id", ["box_id", *k.SIDES], "x0 double, y0 double, x1 double, y1 double", run)


def geo_text_rows(spark: SparkSession, d: str) -> DataFrame:
    def run(ids, *sides):
        b = np.stack(sides, axis=1)
        order = np.lexsort((ids, b[:, 0], b[:, 1]))
        return [ids[order], k.line_numbers((b[order, 1] + b[order, 3]) / 2, b[order, 3] - b[order, 1]) + 1]

    return k.by_page(boxes(spark, d), "page_id", ["box_id", *k.SIDES], "box_id long, line long", run)


def geo_grid_columns(spark: SparkSession, d: str) -> DataFrame:
    def run(ids, *sides):
        columns = k.grid_columns(np.stack(sides, axis=1)[np.argsort(ids)])
        return [np.array([columns or 0])]

    return k.by_page(boxes(spark, d), "page_id", ["box_id", *k.SIDES], "columns long", run)


QUERIES += [join_figure_region, agg_component_groups, geo_expand_native, geo_text_rows, geo_grid_columns]
ORACLES["agg_component_groups"] = f"""WITH RECURSIVE {BOXES}, e AS (SELECT DISTINCT a.page_id, a.box_id AS a, b.box_id AS b FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND (floor(a.x0 / 10) = floor(b.x0 / 10) OR floor(a.y0 / 10) = floor(b.y0 / 10))),
r(page_id, a, b) AS (SELECT page_id, a, b FROM e UNION SELECT r.page_id, r.a, e.b FROM r JOIN e ON r.page_id = e.page_id AND r.b = e.a) SELECT page_id, a AS box_id, min(b) AS component FROM r GROUP BY page_id, a"""
ORACLES["cls_page"] = f"""WITH {BOXES}, src AS (SELECT * FROM boxes WHERE label = 'A'), {UNION_AREA}, p AS (SELECT page_id, page_id % 10 = 0 AS failed, count(*) FILTER (WHERE label = 'R') AS runs, count(*) FILTER (WHERE label <> 'R') AS objects,
  bool_or(label = 'R') AND page_id % 7 = 0 AS abnormal, coalesce(bool_or(label = 'R' AND box_id % 3 = 0), false) AS unverified, count(DISTINCT CASE WHEN label = 'R' THEN (x0, y0, x1, y1) END) AS different, bool_or(label = 'A') AS image, bool_or(label = 'N') AS words,
  bool_or(label = 'N' AND box_id % 2 <> 0) AS shown, bool_or(label = 'N' AND box_id % 2 <> 0 AND x0 * 5 >= 245) AS white, bool_or(label <> 'R' AND box_id % 5 = 0) AS nested FROM boxes GROUP BY page_id),
k AS (SELECT *, CASE WHEN failed THEN 1 WHEN objects = 0 AND runs = 0 THEN 2 WHEN runs = 0 AND image THEN 3 WHEN runs = 0 THEN 4 WHEN abnormal THEN 5 WHEN image AND words AND NOT shown THEN 6 WHEN words AND NOT shown THEN 7 WHEN white THEN 8 WHEN unverified THEN 9 WHEN image THEN 10 ELSE 11 END AS c FROM p)
SELECT k.page_id, ['unknown', 'native', 'scanned', 'unknown', 'broken_encoding', 'hidden_text_scan', 'unknown', 'unknown', 'unknown', 'mixed', 'native'][c] AS page_type, CASE c WHEN 2 THEN 'blank' WHEN 3 THEN 'image_only' WHEN 4 THEN 'image_only' ELSE 'native' END AS content_state,
  concat_ws(',', ['NATIVE_EXTRACTION_FAILED', NULL, 'NO_NATIVE_TEXT', 'NO_NATIVE_TEXT', 'ABNORMAL_UNICODE', 'INVISIBLE_TEXT_WITH_IMAGE', 'INVISIBLE_TEXT_WITHOUT_IMAGE', 'WHITE_PAINT_VISIBILITY_REVIEW', 'UNVERIFIED_NATIVE_GEOMETRY', 'IMAGE_PURPOSE_UNCONFIRMED', NULL][c], CASE WHEN nested THEN 'NESTED_FORM_GEOMETRY_REVIEW' END, CASE WHEN runs <> different THEN 'DUPLICATE_NATIVE_RUNS' END) AS reason_codes,
  least(CAST(1 AS DOUBLE), coalesce(union_area, 0) / 6400) AS image_coverage FROM k LEFT JOIN covered USING (page_id)"""

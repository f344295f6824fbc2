"""Queries on associations, relations, scores and layouts, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import association as ops
from ..operators import boxes as box_ops
from ..operators import governance as gov
from ..operators.pages import visibility
from ..sources.files import admission
from .geometry import AREA, OVERLAP, UNION_AREA
from .views import BOXES, boxes, ledger, runs, table, turns

ROLES = {"A": ("N", "R"), "R": ("R", "A")}


def join_label_adjacent(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    found = ops.beside(b.where("label = 'N'"), b.where("label = 'A'"), "page_id", 30.0)
    return found.select("page_id", F.col("a_box_id").alias("label_id"), F.col("b_box_id").alias("figure"))


def join_caption_below(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    found = ops.below(b.where("label = 'A'"), b.where("label = 'N'"), "page_id", 35.0)
    return found.select("page_id", F.col("a_box_id").alias("figure"), F.col("b_box_id").alias("caption"))


def join_question_number(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    names = b.where("label <> 'A'").select("page_id", (F.col("box_id") % 3).alias("number"), "box_id")
    asked = b.where("label = 'A'").select("page_id", (F.col("box_id") % 4).alias("number"), F.col("box_id").alias("caption"))
    return ops.looked_up(asked, names, "number", "box_id", "page_id").select("page_id", "caption", "state", F.col("box_id").alias("question"))


def join_ledger_map(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    return ops.ledger_map(b.where("label <> 'R'").select("page_id", (F.col("box_id") % 4).alias("raw_index")), b.where("box_id % 4 <> 3").select("page_id", (F.col("box_id") % 4).alias("raw_index")), "page_id", "raw_index")


def join_content_localized(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).withColumn("t", F.concat_ws(":", "label", "box_id"))
    return ops.texts_inside(b.where("label = 'R'"), b.where("label = 'N'"), "page_id", 0.49, "t")


def rel_valid(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).select("page_id", F.col("box_id").alias("id"), F.col("label").alias("kind"))
    edges = b.select("page_id", F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.col("kind").alias("type"))
    return ops.relation_faults(edges, b, ROLES, "page_id")


def fuse_score(spark: SparkSession, d: str) -> DataFrame:
    """A weighted score of evidence less penalties, in an engine of three recognizers."""
    rows = boxes(spark, d).select("page_id", "box_id", (F.col("x0") / 64).alias("geometry"), (F.col("y0") / 64).alias("text"), F.when(F.col("label") == "N", 1.0).alias("agreement"), (F.col("box_id") % 2).cast("double").alias("conflict"))
    score = ops.weighted({"geometry": 0.25, "text": 0.5, "agreement": 0.25}, {"conflict": 0.125})
    return rows.select("page_id", "box_id", score.alias("score"))


def anchor_score(spark: SparkSession, d: str) -> DataFrame:
    return fuse_score(spark, d).select("page_id", "box_id", ops.banded(F.col("score"), 0.78, 0.55).alias("action"))


def route_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Where a page goes by its shares of valid text, of coverage and of replaced characters."""
    shares = boxes(spark, d).groupBy("page_id").agg(F.avg((F.col("label") != "A").cast("int")).alias("valid"), F.avg((F.col("label") == "R").cast("int")).alias("scan"))
    route = F.when(F.col("scan") >= 0.85, "scan").when(F.col("valid") >= 0.97, "native").otherwise("review")
    return shares.select("page_id", route.alias("route"))


def prj_render_plan(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    blocks = b.select("page_id", F.col("box_id").alias("id"), F.when(F.col("label") == "A", "visual").when(F.col("label") == "R", "title").otherwise("text").alias("kind"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "box_id"))), lambda x: x["box_id"])
    return ops.rendered(blocks, b.groupBy("page_id").agg(ordered.alias("reading_order")), "page_id")


def layout_accept(spark: SparkSession, d: str) -> DataFrame:
    before = box_ops.reading_order(boxes(spark, d), "page_id").select("page_id", "ordinal", "box_id", "label")
    case = F.col("page_id") % 3
    after = before.withColumns({"ordinal": F.when(case == 1, -F.col("ordinal")).otherwise(F.col("ordinal")), "label": F.when((case == 2) & (F.col("box_id") == 1), "X").otherwise(F.col("label"))})
    return ops.accepted(before, after, "page_id", "label", "box_id")


def con_bookmarks(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    marks = b.select("page_id", (F.col("box_id") % 3).alias("id"), F.when(F.col("label") == "N", "start").otherwise("end").alias("kind"), F.col("box_id").alias("pos"))
    return ops.bookmark_faults(marks, "page_id")


def con_parent_chain(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a row's kind and the next one's that aren't allowed."""
    own = turns(spark, d)
    edges = own.select("conv_id", "turn", "role").join(own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("child")), ["conv_id", "turn"])
    allowed = spark.createDataFrame([("user", "assistant"), ("system", "user")], "role string, child string")
    return edges.join(allowed, ["role", "child"], "left_anti").select("conv_id", "turn", "role", "child")


def con_forbidden_terms(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("en", "the and"), ("fr", "de la"), ("en", "HTTP")], "group string, term string")
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("group"), "text")
    return ops.forbidden(rows, rules, "text").select("doc_id", "term")


def con_image_geometry(spark: SparkSession, d: str) -> DataFrame:
    b = g.Box.of()
    return boxes(spark, d).select("page_id", "box_id", ops.display_width((b.x1 - b.x0) * 100, (b.y1 - b.y0) * 100).alias("shown"))


def prj_source_image(spark: SparkSession, d: str) -> DataFrame:
    b = g.Box.of()
    w, h = (b.x1 - b.x0) * 100, (b.y1 - b.y0) * 100
    return boxes(spark, d).select("page_id", "box_id", F.lit(595.28).cast("double").alias("width_pt"), (F.lit(595.28).cast("double") * h / w).alias("height_pt"))


def cls_visibility(spark: SparkSession, d: str) -> DataFrame:
    fill = F.when(F.col("box_id") % 5 > 0, F.col("x0") * 5.5)
    return boxes(spark, d).select("page_id", "box_id", visibility(F.col("box_id") % 4, F.when(F.col("box_id") % 6 == 0, 0).otherwise(255), fill).alias("visibility"))


def cls_image_coverage(spark: SparkSession, d: str) -> DataFrame:
    covered = box_ops.union_area(boxes(spark, d).where("label = 'A'"), "page_id")
    return covered.select("page_id", F.least(F.lit(1.0), F.col("union_area") / 900.0).alias("coverage"))


def src_validate_input(spark: SparkSession, d: str) -> DataFrame:
    ending = F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, ".gif").otherwise(".jpeg")
    size = F.when(F.col("page_id") % 7 == 0, 0).otherwise(F.length("html"))
    return table(spark, d, "pages").select("page_id", admission(F.concat("url", ending), size).alias("error"))


def src_replay(spark: SparkSession, d: str) -> DataFrame:
    """Keys for which there is exactly one completed response."""
    done = ledger(spark, d).where("status = 'COMPLETE'").withColumn("slot", F.col("event_id") % 500)
    return done.groupBy("provider", "variant", "slot").agg(F.count("*").alias("n"), F.min("event_id").alias("event_id")).where("n = 1").drop("n")


def sink_range_binding(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose output and source lists can be bound one to one: as many, and of the same kinds in turn."""
    b = boxes(spark, d)
    out, src = (box_ops.reading_order(x, "page_id").select("page_id", "ordinal", F.col("label").alias(n)) for x, n in ((b, "kind_out"), (b.where("box_id <> 5"), "kind_src")))
    joined = out.join(src, ["page_id", "ordinal"], "full")
    return joined.groupBy("page_id").agg(F.every(F.coalesce(F.col("kind_out") == F.col("kind_src"), F.lit(False))).alias("bound"))


def sink_junit_public(spark: SparkSession, d: str) -> DataFrame:
    """Statuses of allow-listed tests by kind, in columns."""
    allow = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey")).alias("user_id"))
    rows = gov.allowed(table(spark, d, "events"), allow, "user_id")
    count = lambda kind: F.count(F.when(F.col("event_type") == kind, 1)).alias(kind)
    return rows.groupBy((F.col("user_id") % 5).alias("part")).agg(count("click"), count("view"), count("error"))


def prj_noise_exclude(spark: SparkSession, d: str) -> DataFrame:
    """Reading orders without one excluded anchor; orders of fewer than two go."""
    orders = boxes(spark, d).groupBy("page_id").agg(F.array_sort(F.collect_list("box_id")).alias("ids"))
    kept = orders.withColumn("ids", F.array_remove("ids", F.lit(1).cast("long"))).where("size(ids) >= 2")
    return kept.select("page_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def prj_owner_readings(spark: SparkSession, d: str) -> DataFrame:
    """Texts with doubtful marks replaced by what their owners read."""
    text = F.replace(F.replace(F.col("text"), F.lit("|"), F.lit("[?]")), F.lit("[?]"), F.lit("/"))
    return runs(spark, d).where("ord = 1").select("doc_id", F.sha2(text, 256).alias("sha"), F.contains(text, F.lit("[?]")).alias("uncertain"))


QUERIES = [
    join_label_adjacent, join_caption_below, join_question_number, join_ledger_map, join_content_localized, rel_valid, fuse_score, anchor_score, route_thresholds, prj_render_plan, layout_accept, con_bookmarks, con_parent_chain,
    con_forbidden_terms, con_image_geometry, prj_source_image, cls_visibility, cls_image_coverage, src_validate_input, src_replay, sink_range_binding, sink_junit_public, prj_noise_exclude, prj_owner_readings,
]

_MUTUAL = "(SELECT *, count(*) OVER (PARTITION BY page_id, a) AS na, count(*) OVER (PARTITION BY page_id, b) AS nb FROM p) WHERE na = 1 AND nb = 1"
_SCORE = "CAST(0.25 AS DOUBLE) * (x0 / 64) + CAST(0.5 AS DOUBLE) * (y0 / 64) + CAST(0.25 AS DOUBLE) * CASE WHEN label = 'N' THEN 1 ELSE 0 END - CAST(0.125 AS DOUBLE) * (box_id % 2)"

ORACLES = {
    "join_label_adjacent": f"WITH {BOXES}, p AS (SELECT a.page_id, a.box_id AS a, b.box_id AS b FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.label = 'N' AND b.label = 'A' AND b.x0 - a.x1 >= 0 AND b.x0 - a.x1 < 30 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1) SELECT page_id, a AS label_id, b AS figure FROM {_MUTUAL}",
    "join_caption_below": f"WITH {BOXES}, p AS (SELECT a.page_id, a.box_id AS a, b.box_id AS b FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.label = 'A' AND b.label = 'N' AND b.y0 - a.y1 >= 0 AND b.y0 - a.y1 < 35 AND (b.x0 + b.x1) / 2 BETWEEN a.x0 AND a.x1) SELECT page_id, a AS figure, b AS caption FROM {_MUTUAL}",
    "join_question_number": f"WITH {BOXES}, n AS (SELECT page_id, box_id % 3 AS k, count(*) AS c, min(box_id) AS f FROM boxes WHERE label <> 'A' GROUP BY ALL) SELECT b.page_id, b.box_id AS caption, CASE WHEN c IS NULL THEN 'missing' WHEN c > 1 THEN 'ambiguous' ELSE 'unique' END AS state, CASE WHEN c = 1 THEN f END AS question FROM boxes b LEFT JOIN n ON b.page_id = n.page_id AND b.box_id % 4 = n.k WHERE b.label = 'A'",
    "join_ledger_map": f"WITH {BOXES}, o AS (SELECT page_id, box_id % 4 AS k, count(*) AS c FROM boxes WHERE label <> 'R' GROUP BY ALL), s AS (SELECT page_id, box_id % 4 AS k, count(*) AS c FROM boxes WHERE box_id % 4 <> 3 GROUP BY ALL) SELECT coalesce(o.page_id, s.page_id) AS page_id, coalesce(o.k, s.k) AS raw_index, CASE WHEN o.c IS NULL THEN 'lost' WHEN s.c IS NULL THEN 'extra' WHEN o.c > 1 OR s.c > 1 THEN 'doubled' ELSE 'bound' END AS state FROM o FULL JOIN s ON o.page_id = s.page_id AND o.k = s.k",
    "join_content_localized": f"WITH {BOXES} SELECT a.page_id, b.box_id AS area, string_agg(a.label || ':' || a.box_id, chr(10) ORDER BY a.y0, a.x0, a.box_id) AS content FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.label = 'R' AND b.label = 'N' AND {OVERLAP} / {AREA.format(t='a')} > 0.49 GROUP BY a.page_id, b.box_id",
    "rel_valid": f"WITH {BOXES} SELECT a.page_id, a.box_id AS src, a.box_id + 1 AS dst, a.label AS type, CASE WHEN b.label IS NULL THEN 'DANGLING' ELSE 'ROLE' END AS fault FROM boxes a LEFT JOIN boxes b ON a.page_id = b.page_id AND b.box_id = a.box_id + 1 WHERE b.label IS NULL OR NOT (a.label = 'R' AND b.label = 'A')",
    "fuse_score": f"WITH {BOXES} SELECT page_id, box_id, {_SCORE} AS score FROM boxes",
    "anchor_score": f"WITH {BOXES} SELECT page_id, box_id, CASE WHEN {_SCORE} >= CAST(0.78 AS DOUBLE) THEN 'AUTO' WHEN {_SCORE} >= CAST(0.55 AS DOUBLE) THEN 'REVIEW' ELSE 'REJECT' END AS action FROM boxes",
    "route_thresholds": f"WITH {BOXES}, s AS (SELECT page_id, avg(CASE WHEN label <> 'A' THEN 1 ELSE 0 END) AS v, avg(CASE WHEN label = 'R' THEN 1 ELSE 0 END) AS c FROM boxes GROUP BY page_id) SELECT page_id, CASE WHEN c >= 0.85 THEN 'scan' WHEN v >= 0.97 THEN 'native' ELSE 'review' END AS route FROM s",
    "prj_render_plan": f"WITH {BOXES} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, box_id) AS ordinal, box_id AS id, CASE label WHEN 'R' THEN 'Heading1' WHEN 'A' THEN 'Figure' ELSE 'Normal' END AS style FROM boxes",
    "layout_accept": f"WITH {BOXES} SELECT page_id, CASE WHEN page_id % 3 = 1 AND count(*) > 1 THEN 'READING_ORDER_CHANGED' WHEN page_id % 3 > 0 THEN 'CONTENT_PRESERVATION_FAILED' END AS code FROM boxes GROUP BY page_id",
    "con_bookmarks": f"WITH {BOXES}, m AS (SELECT page_id, box_id % 3 AS id, count(*) FILTER (WHERE label = 'N') AS s, count(*) FILTER (WHERE label <> 'N') AS e, min(box_id) FILTER (WHERE label = 'N') AS f, max(box_id) FILTER (WHERE label <> 'N') AS l FROM boxes GROUP BY ALL) SELECT page_id, id FROM m WHERE s <> 1 OR e <> 1 OR f > l",
    "con_parent_chain": "SELECT a.conv_id, a.turn, a.role, b.role AS child FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE NOT (a.role = 'user' AND b.role = 'assistant') AND NOT (a.role = 'system' AND b.role = 'user')",
    "con_forbidden_terms": "SELECT doc_id, term FROM documents JOIN (VALUES ('en', 'the and'), ('fr', 'de la'), ('en', 'HTTP')) r(g, term) ON lang = g WHERE contains(lower(text), lower(term))",
    "con_image_geometry": f"WITH {BOXES}, s AS (SELECT page_id, box_id, (x1 - x0) * 100 AS w, (y1 - y0) * 100 AS h FROM boxes) SELECT page_id, box_id, least(CAST(505.28 AS DOUBLE), w, CAST(650 AS DOUBLE) * w / h) AS shown FROM s",
    "prj_source_image": f"WITH {BOXES}, s AS (SELECT page_id, box_id, (x1 - x0) * 100 AS w, (y1 - y0) * 100 AS h FROM boxes) SELECT page_id, box_id, CAST(595.28 AS DOUBLE) AS width_pt, CAST(595.28 AS DOUBLE) * h / w AS height_pt FROM s",
    "cls_visibility": f"WITH {BOXES} SELECT page_id, box_id, CASE WHEN box_id % 4 = 3 OR box_id % 6 = 0 THEN 'invisible' WHEN box_id % 5 = 0 THEN 'unknown' WHEN x0 * 5.5 >= 245 THEN 'white_paint' ELSE 'painted' END AS visibility FROM boxes",
    "cls_image_coverage": f"WITH {BOXES}, src AS (SELECT * FROM boxes WHERE label = 'A'), {UNION_AREA} SELECT page_id, least(CAST(1 AS DOUBLE), union_area / 900) AS coverage FROM covered",
    "src_validate_input": "SELECT page_id, CASE WHEN page_id % 7 = 0 OR length(html) = 0 OR length(html) > 26214400 THEN 'INPUT_SIZE_LIMIT' WHEN page_id % 3 = 1 THEN 'UNSUPPORTED_FORMAT' END AS error FROM pages",
    "src_replay": "SELECT user_id % 3 AS provider, event_id % 2 AS variant, event_id % 500 AS slot, min(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY ALL HAVING count(*) = 1",
    "sink_range_binding": f"WITH {BOXES}, o AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, box_id) AS n, label FROM boxes), s AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, box_id) AS n, label FROM boxes WHERE box_id <> 5) SELECT o.page_id, bool_and(coalesce(o.label = s.label, false)) AS bound FROM o LEFT JOIN s ON o.page_id = s.page_id AND o.n = s.n GROUP BY o.page_id",
    "sink_junit_public": "SELECT user_id % 5 AS part, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'error') AS error FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ALL",
    "prj_noise_exclude": f"WITH {BOXES} SELECT page_id, string_agg(CAST(box_id AS VARCHAR), ',' ORDER BY box_id) AS ids FROM boxes WHERE box_id <> 1 GROUP BY page_id HAVING count(*) >= 2",
    "prj_owner_readings": "SELECT doc_id, sha256(replace(replace(split_part(text, chr(10), 1), '|', '[?]'), '[?]', '/')) AS sha, false AS uncertain FROM documents",
}

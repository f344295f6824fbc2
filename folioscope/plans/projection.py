"""Queries on responses, records, requests and observations, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import observation as obs
from ..operators import projection as ops
from .views import BOXES, boxes, ledger, table, turns

NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
ALLOWED = ["paragraph", "question", "option", "figure", "caption", "formula", "heading"]


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    """Boxes with a label of a provider's kind, in its order."""
    label = F.get(F.array(*map(F.lit, ("text", "image", "formula", "table", "number"))), (F.col("box_id") % 5).cast("int"))
    return boxes(spark, d).withColumn("provider_label", label)


def src_page_geometry(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    visible = g.Box(F.col("x0"), F.col("y0"), F.col("x1") - F.when(F.col("box_id") == 3, 40.0).otherwise(0.0), F.col("y1"))
    width, height, error = obs.page_geometry(visible, (F.col("box_id") % 4 * 90))
    return b.select("page_id", "box_id", width.alias("width"), height.alias("height"), error.alias("error"))


def src_observe_page(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    frame = F.when(F.col("box_id") % 3 == 0, "ccw").when(F.col("box_id") % 3 == 1, "cw").otherwise("none")
    runs = b.select("page_id", "box_id", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), frame.alias("frame_rotation"), (F.col("label") != "R").alias("advance_known"))
    visible = g.Box(F.lit(2.0), F.lit(3.0), F.lit(82.0), F.lit(93.0))
    return obs.observed_runs(runs, visible, F.col("page_id") % 4 * 90).select("page_id", "box_id", "x0", "y0", "x1", "y1", "geometry_verified")


def src_single_page(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).select("page_id", "box_id")
    return obs.single_page(b, b.select("page_id", (F.col("box_id") + F.col("page_id") % 3 - 2).alias("index")), "page_id", "index")


def src_single_input(spark: SparkSession, d: str) -> DataFrame:
    files = boxes(spark, d).select("page_id", F.concat(F.when(F.col("label") == "R", "input.").otherwise("note."), F.col("box_id").cast("string")).alias("name"))
    return obs.single_input(files, "page_id", "name")


def prj_chat_content(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    one = lambda text, end: F.struct(F.struct(text.alias("content")).alias("message"), F.lit(end).alias("finish_reason"))
    body = lambda *choices: F.to_json(F.struct(F.array(*choices).alias("choices")))
    text = F.col("text")
    k = F.col("turn") % 5
    made = F.when(k == 0, body(one(text, "stop"))).when(k == 1, body(one(text, "length"))).when(k == 2, body(one(text, "stop"), one(text, "stop"))).when(k == 3, body(one(F.length(text), "stop"))).otherwise("{")
    return t.select("conv_id", "turn", ops.chat_content(made).alias("content"))


def _block(spark: SparkSession, d: str) -> DataFrame:
    source = F.when(F.col("label") == "N", "native_pdf").when(F.col("label") == "A", "pp_structure").otherwise("other")
    name = F.concat(F.lit("b"), F.col("box_id").cast("string"))
    return boxes(spark, d).select("page_id", "box_id", ops.block(name, F.col("page_id"), g.Box.of(), F.col("label"), source, F.when(F.col("label") == "R", "figure")).alias("b"))


def prj_block(spark: SparkSession, d: str) -> DataFrame:
    return _block(spark, d).select("page_id", "box_id", "b.id", "b.type", "b.bbox", "b.selected_candidate_id", "b.render_policy")


def prj_candidate(spark: SparkSession, d: str) -> DataFrame:
    c = F.get("b.content_candidates", F.lit(0))
    return _block(spark, d).select("page_id", "box_id", c["id"].alias("id"), c["model_id"].alias("model_id"), c["text"].alias("text"), c["engine_confidence"].alias("engine_confidence"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each page; its blocks are bounded by the page."""
    own = _block(spark, d).groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("box_id", "b"))), lambda x: x["b"]).alias("blocks"))
    return own.select("page_id", ops.page_record(F.col("page_id"), F.lit(50.0), F.lit(50.0), F.lit("native"), F.col("blocks")).alias("p"))


def prj_page(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", "p.width_pt", "p.routing_decision", F.array_join("p.reading_order", ",").alias("reading_order"))


def prj_layout(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one page each."""
    name = F.concat(F.lit("doc"), F.col("page_id").cast("string"))
    made = _pages(spark, d).select("page_id", ops.layout_record(name, F.concat(name, F.lit(".pdf")), F.sha2(name, 256), F.array("p")).alias("ir"))
    return made.select("page_id", "ir.schema_version", "ir.document_id", F.col("ir.source.sha256").alias("sha256"), F.col("ir.source.page_count").cast("long").alias("page_count"))


def _numbered(spark: SparkSession, d: str, prefix: str) -> DataFrame:
    b = boxes(spark, d)
    known = b.where("label = 'N'").select("page_id", F.when(F.col("box_id") % 2 == 0, F.col("box_id")).alias("number"))
    found = ops.numbered_after(known, b.where("label <> 'N'").select("page_id", "box_id"), "page_id", "number", "box_id")
    return found.select("page_id", "box_id", F.concat(F.lit(prefix), F.col("number").cast("string")).alias("id"))


def prj_issue_id(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d, "issue-")


def prj_relation_id(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d, "relation-")


def prj_pp_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Responses as three lists; those of every seventh page lack a text."""
    own = pages_of(spark, d).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("box_id", "provider_label", F.array(*g.Box.of().sides).alias("bbox"), F.col("label").alias("text")))).alias("rows"))
    lists = own.select("page_id", F.transform("rows", lambda r: r["provider_label"]).alias("labels"), F.transform("rows", lambda r: r["bbox"]).alias("boxes"), F.transform(F.when(F.col("page_id") % 7 == 0, F.slice("rows", F.lit(2), F.size("rows"))).otherwise(F.col("rows")), lambda r: r["text"]).alias("texts"))
    found = ops.recognized(lists, "page_id", "labels", "boxes", "texts", F.lit(50.0), F.lit(50.0))
    return found.select("page_id", "ord", "type", "preserved", F.get("bbox", F.lit(0)).alias("x0"), "text")


def prj_parse_prediction(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).select("page_id", "box_id", "label")
    found = ops.layers(b.where("label = 'A'"), b.where("label <> 'R'"), b)
    return found.groupBy("page_id", "layer").agg(F.count("*").alias("n"), F.max("box_id").alias("last"))


def prj_region_table(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    markup = F.lit("<table border=1>\n<tr><td>x</td></tr></table >")
    content = F.concat("text", F.when(F.col("turn") % 3 == 0, markup).when(F.col("turn") % 3 == 1, F.concat(markup, markup)).otherwise(""), F.lit(" end"))
    b = g.Box(F.col("turn").cast("double"), F.lit(3.0), F.lit(30.0), F.lit(55.0))
    return t.select("conv_id", "turn", F.sha2(ops.table_as_image(content, b, F.col("conv_id") % 2 + 1, F.lit(64.0), F.lit(128.0)), 256).alias("sha"))


def txt_table_markup(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["<table><tbody><tr><td rowspan=\"2\" colspan=3>a<br/>b</td></tr></tbody></table>", "<table><tr><td class=x>a</td></tr></table>", "<table><tr><th>a</th></tr></table>", "<TABLE><tr><td>1 > 0</td></tr></TABLE>"]
    pick = F.get(F.array(*map(F.lit, kinds)), (F.col("turn") % 4).cast("int"))
    return turns(spark, d).select("conv_id", "turn", ops.plain_table_markup(pick).alias("plain"))


def prj_inline_text(spark: SparkSession, d: str) -> DataFrame:
    atoms = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("text"), (F.length(w) % 3 != 0).alias("visible")))
    return turns(spark, d).select("conv_id", "turn", F.sha2(ops.inline_text(atoms), 256).alias("sha"))


def prj_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as heaps: box n lies in box n / 2."""
    nodes = boxes(spark, d).select("page_id", "box_id", F.when(F.col("box_id") > 1, F.floor(F.col("box_id") / 2)).alias("parent"))
    return ops.leaves(nodes, "page_id", "box_id", "parent").select("page_id", "box_id")


def con_local_refs(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(F.col("event_id") % 4 == 0, '{"$ref": "#/a", "b": {"$ref":"file.json#/c"}}').when(F.col("event_id") % 4 == 1, '{"$ref" : "#/defs/x"}').otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", ops.local_references(other).alias("local"))


def prj_payload(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(ops.payload(F.encode("text", "UTF-8"), (F.col("doc_id") % 2).cast("int")), 256).alias("sha"))


def lin_finalized(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger(spark, d).select("event_id", "provider", "status", F.col("event_type").alias("audit"))
    return ops.finalized(rows, "audit", "event_id")


def lin_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger(spark, d).select("provider", "variant", "event_type").distinct()
    return rows.select("provider", "variant", "event_type", ops.fingerprint(F.col("event_type").alias("target"), F.col("variant").alias("parameters")).alias("sha256"))


def lin_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


def prj_region_remap(spark: SparkSession, d: str) -> DataFrame:
    """The R boxes of a page are replaced by two parts each."""
    b = boxes(spark, d).withColumns({"id": F.col("box_id"), "ord": F.col("box_id")})
    parts = b.where("label = 'R'").select("page_id", F.col("id").alias("target"), F.explode(F.array(F.lit(2), F.lit(1))).alias("part"), F.col("x0").alias("origin_x"), F.col("y0").alias("origin_y"))
    rows = parts.select("page_id", "target", F.col("part").alias("id"), F.col("part").alias("ord"), "origin_x", "origin_y", F.lit(0.5).alias("scale"), F.lit(0.0).alias("x0"), (F.col("part") * 2.0).alias("y0"), F.lit(8.0).alias("x1"), (F.col("part") * 2.0 + 2).alias("y1"))
    return ops.spliced(b, rows, "page_id", "r")


def lin_provenance(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).select("page_id", F.col("box_id").alias("id"), (F.col("page_id") * 10 + F.col("box_id") % 3).alias("request_id"), F.array(*g.Box.of().sides).alias("raw_bbox"), "label")
    return ops.provenance(b, "page_id", "id", "label").select("page_id", "id", "request_id", "reason", "supersedes")


def cap_unsupported(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (F.col("box_id") % n).cast("int"))
    codes = ops.unsupported_features(pick(["paragraph", "figure", "formula", "table", "heading"], 5), pick(["text", "image", "formula"], 3), pick(["editable", "preserve_image"], 2), F.col("page_id") % 2 * 90, pick(["image", "preserve_as_image", "omml", "text"], 4), ALLOWED)
    return boxes(spark, d).select("page_id", "box_id", F.array_join(codes, ",").alias("codes"))


def sink_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2(ops.preview(F.col("url"), F.split("html", ">")), 256).alias("sha"))


def prj_annotation_adapt(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).select(F.col("page_id").alias("document"), (F.col("box_id") % 3).alias("page"), F.col("box_id").alias("name"), F.col("label").alias("kind"), F.when(F.col("box_id") % 4 == 0, "").otherwise(F.col("label")).alias("text"), (F.col("x0") < 40).alias("certain"))
    return ops.adapted(b, {"A": "figure_edge", "N": "text"}, NAMESPACE)


QUERIES = [
    src_page_geometry, src_observe_page, src_single_page, src_single_input, prj_chat_content, prj_block, prj_candidate, prj_page, prj_layout, prj_issue_id, prj_relation_id, prj_pp_normalize, prj_parse_prediction, prj_region_table, txt_table_markup,
    prj_inline_text, prj_leaves, con_local_refs, prj_payload, lin_finalized, lin_targets, lin_sources, prj_region_remap, lin_provenance, cap_unsupported, sink_preview, prj_annotation_adapt,
]

_SOURCE = "CASE label WHEN 'N' THEN 'native_pdf' WHEN 'A' THEN 'pp_structure' ELSE 'other' END"
_MODEL = "CASE label WHEN 'N' THEN 'PDFium' WHEN 'A' THEN 'PP-StructureV3' ELSE 'other' END"
_FREE = """WITH {boxes}, known AS (SELECT page_id, CASE WHEN box_id % 2 = 0 THEN box_id END AS number FROM boxes WHERE label = 'N'),
fresh AS (SELECT page_id, box_id, row_number() OVER (PARTITION BY page_id ORDER BY box_id) AS place FROM boxes WHERE label <> 'N'),
open AS (SELECT page_id, n, row_number() OVER (PARTITION BY page_id ORDER BY n) AS place FROM (SELECT page_id, unnest(range((SELECT count(*) FROM known k WHERE k.page_id = p.page_id), (SELECT 2 * count(*) + 1 FROM boxes b WHERE b.page_id = p.page_id))) AS n FROM (SELECT DISTINCT page_id FROM fresh) p) c WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.page_id = c.page_id AND k.number = c.n))
SELECT f.page_id, box_id, '{prefix}-' || n AS id FROM fresh f JOIN open o ON f.page_id = o.page_id AND f.place = o.place"""
_TURNED = """[CASE box_id % 3 WHEN 0 THEN -y0 - (y1 - y0) WHEN 1 THEN y0 ELSE x0 END, CASE box_id % 3 WHEN 0 THEN x0 WHEN 1 THEN -x0 - (x1 - x0) ELSE y0 END, CASE box_id % 3 WHEN 2 THEN x1 - x0 ELSE y1 - y0 END, CASE box_id % 3 WHEN 2 THEN y1 - y0 ELSE x1 - x0 END]"""
_TAGGED = r"""'<table border=1>' || chr(10) || '<tr><td>x</td></tr></table >'"""

ORACLES = {
    "src_page_geometry": f"WITH {BOXES}, v AS (SELECT *, x1 - CASE WHEN box_id = 3 THEN 40 ELSE 0 END - x0 AS w, y1 - y0 AS h FROM boxes) SELECT page_id, box_id, CASE WHEN box_id % 2 = 1 THEN h ELSE w END AS width, CASE WHEN box_id % 2 = 1 THEN w ELSE h END AS height, CASE WHEN w <= 0 OR h <= 0 THEN 'INVALID_PAGE_SIZE' END AS error FROM v",
    "src_observe_page": f"""WITH {BOXES}, t AS (SELECT page_id, box_id, label, {_TURNED} AS q FROM boxes), r AS (SELECT *, 2 + q[1] AS a, 3 + q[2] AS b, 2 + q[1] + q[3] AS c, 3 + q[2] + q[4] AS e FROM t),
v AS (SELECT page_id, box_id, label, page_id % 4 AS k, CASE page_id % 4 WHEN 0 THEN [a - 2, 93 - e, c - 2, 93 - b] WHEN 1 THEN [b - 3, a - 2, e - 3, c - 2] WHEN 2 THEN [82 - c, b - 3, 82 - a, e - 3] ELSE [93 - e, 82 - c, 93 - b, 82 - a] END AS p FROM r)
SELECT page_id, box_id, CAST(p[1] AS DOUBLE) AS x0, CAST(p[2] AS DOUBLE) AS y0, CAST(p[3] AS DOUBLE) AS x1, CAST(p[4] AS DOUBLE) AS y1,
label <> 'R' AND p[1] >= 0 AND p[1] < p[3] AND p[3] <= CASE WHEN k % 2 = 1 THEN 91 ELSE 81 END AND p[2] >= 0 AND p[2] < p[4] AND p[4] <= CASE WHEN k % 2 = 1 THEN 81 ELSE 91 END AS geometry_verified FROM v""",
    "src_single_page": f"WITH {BOXES}, w AS (SELECT page_id, box_id + page_id % 3 - 2 AS index, count(*) OVER (PARTITION BY page_id) AS n FROM boxes) SELECT page_id, index, CASE WHEN index < 0 OR index >= n THEN 'PAGE_OUT_OF_RANGE' END AS error FROM w",
    "src_single_input": f"WITH {BOXES}, s AS (SELECT page_id, count(*) FILTER (label = 'R') AS n, min(CASE WHEN label = 'R' THEN 'input.' || box_id END) AS f FROM boxes GROUP BY page_id) SELECT page_id, CASE WHEN n = 1 THEN f END AS file, CASE WHEN n <> 1 THEN 'AMBIGUOUS_INPUT' END AS error FROM s",
    "prj_chat_content": "SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN text END AS content FROM conversations",
    "prj_block": f"WITH {BOXES} SELECT page_id, box_id, 'b' || box_id AS id, CASE WHEN label = 'R' THEN 'figure' ELSE 'paragraph' END AS type, [x0, y0, x1, y1] AS bbox, 'b' || box_id || '-c0' AS selected_candidate_id, 'editable' AS render_policy FROM boxes",
    "prj_candidate": f"WITH {BOXES} SELECT page_id, box_id, 'b' || box_id || '-c0' AS id, {_MODEL} AS model_id, label AS text, CAST(NULL AS DOUBLE) AS engine_confidence FROM boxes",
    "prj_page": f"WITH {BOXES} SELECT page_id, CAST(50 AS DOUBLE) AS width_pt, 'DEMO_REVIEW' AS routing_decision, string_agg('b' || box_id, ',' ORDER BY box_id) AS reading_order FROM boxes GROUP BY page_id",
    "prj_layout": f"WITH {BOXES} SELECT DISTINCT page_id, 'layout-ir/1.1' AS schema_version, 'doc' || page_id AS document_id, sha256('doc' || page_id) AS sha256, CAST(1 AS BIGINT) AS page_count FROM boxes",
    "prj_issue_id": _FREE.format(boxes=BOXES, prefix="issue"),
    "prj_relation_id": _FREE.format(boxes=BOXES, prefix="relation"),
    "prj_pp_normalize": f"""WITH {BOXES} SELECT page_id, box_id - 1 AS ord, CASE box_id % 5 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'figure' WHEN 2 THEN 'formula' WHEN 3 THEN 'figure' ELSE 'page_number' END AS type, box_id % 5 IN (1, 3) AS preserved, x0, CASE WHEN box_id % 5 NOT IN (1, 3) THEN label END AS text
FROM boxes WHERE page_id % 7 <> 0 AND x1 <= 50 AND y1 <= 50""",
    "prj_parse_prediction": f"WITH {BOXES}, l AS (SELECT page_id, box_id, 'macro' AS layer FROM boxes WHERE label = 'A' UNION ALL SELECT page_id, box_id, 'paragraph' FROM boxes WHERE label <> 'R' UNION ALL SELECT page_id, box_id, 'fine' FROM boxes) SELECT page_id, layer, count(*) AS n, max(box_id) AS last FROM l GROUP BY page_id, layer",
    "prj_region_table": f"""SELECT conv_id, turn, sha256(text || CASE turn % 3 WHEN 0 THEN CASE WHEN conv_id % 2 = 0 AND turn < 30 THEN chr(10) || chr(10) || '<img src="images/bbox_' || CAST(floor(turn / 64 * 1000) AS BIGINT) || '_23_469_430.jpg" />' || chr(10) || chr(10) ELSE {_TAGGED} END WHEN 1 THEN {_TAGGED} || {_TAGGED} ELSE '' END || ' end') AS sha FROM conversations""",
    "txt_table_markup": "SELECT conv_id, turn, turn % 4 IN (0, 3) AS plain FROM conversations",
    "prj_inline_text": "SELECT conv_id, turn, sha256(array_to_string(list_filter(string_split(text, ' '), lambda w: length(w) % 3 <> 0), '')) AS sha FROM conversations",
    "prj_leaves": f"WITH {BOXES} SELECT page_id, box_id FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM boxes c WHERE c.page_id = b.page_id AND c.box_id > 1 AND c.box_id // 2 = b.box_id)",
    "con_local_refs": "SELECT event_id, event_id % 4 <> 0 AS local FROM events",
    "prj_payload": """SELECT doc_id, sha256('{"file":"' || to_base64(encode(text)) || '","fileType":' || doc_id % 2 || '}') AS sha FROM documents""",
    "lin_finalized": """SELECT event_id, sha256('{"event_id":' || event_id || ',"provider":' || user_id % 3 || ',"status":"' || CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'COMPLETE' END || '"}') AS sha256 FROM events""",
    "lin_targets": """SELECT DISTINCT user_id % 3 AS provider, event_id % 2 AS variant, event_type, sha256('{"target":"' || event_type || '","parameters":' || event_id % 2 || '}') AS sha256 FROM events""",
    "lin_sources": "SELECT source || '/' || doc_id AS path, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents",
    "prj_region_remap": f"""WITH {BOXES}, u AS (SELECT page_id, CAST(box_id AS VARCHAR) AS id, box_id AS spot, 0 AS sub, x0, y0, x1, y1 FROM boxes WHERE label <> 'R' UNION ALL SELECT page_id, 'r' || box_id || '-' || p, box_id, p, x0, y0 + p, x0 + 4, y0 + p + 1 FROM boxes CROSS JOIN (SELECT unnest([1, 2]) AS p) WHERE label = 'R')
SELECT page_id, id, row_number() OVER (PARTITION BY page_id ORDER BY spot, sub, id) AS ord, x0, y0, x1, y1 FROM u""",
    "lin_provenance": f"WITH {BOXES}, p AS (SELECT page_id, box_id AS id, page_id * 10 + box_id % 3 AS request_id, lag(box_id) OVER (PARTITION BY page_id, label ORDER BY box_id) AS supersedes FROM boxes) SELECT page_id, id, request_id, CASE WHEN supersedes IS NULL THEN 'recognized' ELSE 'replaced' END AS reason, supersedes FROM p",
    "cap_unsupported": f"""WITH {BOXES}, a AS (SELECT page_id, box_id, ['paragraph', 'figure', 'formula', 'table', 'heading'][box_id % 5 + 1] AS t, ['text', 'image', 'formula'][box_id % 3 + 1] AS c, ['editable', 'preserve_image'][box_id % 2 + 1] AS p, ['image', 'preserve_as_image', 'omml', 'text'][box_id % 4 + 1] AS m FROM boxes)
SELECT page_id, box_id, array_to_string(list_filter([CASE WHEN t = 'table' THEN 'BLOCK_TYPE_UNSUPPORTED' END, CASE WHEN t = 'figure' AND c <> 'image' THEN 'FIGURE_CONTENT_UNSUPPORTED' END, CASE WHEN t = 'formula' AND c = 'formula' AND (m = 'image' OR p = 'preserve_image') THEN 'FORMULA_IMAGE_POLICY_UNSUPPORTED' END,
CASE WHEN c = 'image' AND m <> 'preserve_as_image' THEN 'IMAGE_RENDER_MODE_UNSUPPORTED' END, CASE WHEN c = 'formula' AND t <> 'formula' THEN 'BLOCK_CONTENT_COMBINATION_UNSUPPORTED' END, CASE WHEN page_id % 2 = 1 THEN 'BLOCK_ROTATION_UNSUPPORTED' END,
CASE WHEN (c = 'text' AND p = 'preserve_image') OR (c = 'image' AND p = 'editable') THEN 'BLOCK_CONTENT_POLICY_UNSUPPORTED' END, CASE WHEN t = 'heading' THEN 'PLANNED_HEADING_LEVEL_UNSUPPORTED' END], lambda x: x IS NOT NULL), ',') AS codes FROM a""",
    "sink_preview": """SELECT page_id, sha256('<!doctype html><title>' || replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</title>' || array_to_string(list_transform(string_split(html, '>'), lambda t: '<p>' || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') || '</p>'), '')) AS sha FROM pages""",
}

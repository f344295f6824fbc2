"""Queries on handing layout records over, on inline order, layout grids, reviewed formulas and service descriptions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import invalid_xml
from ..operators import bridging as ops
from .views import BOXES, boxes, table, turns


def _picked(values: tuple, by: F.Column) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as blocks of pages, ten pages a document; some pages have faults."""
    b = boxes(spark, d).withColumn("doc", F.floor(F.col("page_id") / 10).cast("long"))
    kind, content = _picked(("heading", "caption", "footer", "table", "paragraph"), F.col("box_id")), _picked(("text", "image", "text", "formula"), F.col("box_id"))
    again = (F.col("page_id") % 63 == 0) & (F.col("box_id") == 2)
    return b.select("doc", "page_id", "box_id", "x0", "y0", "x1", "y1", (F.col("page_id") * 100 + F.when(again, 1).otherwise(F.col("box_id"))).alias("id"), kind.alias("kind"), content.alias("content"), (F.col("box_id") % 2 == 1).alias("has_grid"), F.when(content == "image", F.col("box_id") % 7).alias("asset"))


def prj_bridge(spark: SparkSession, d: str) -> DataFrame:
    blocks = _blocks(spark, d)
    order = blocks.where((F.col("page_id") % 46 != 0) | (F.col("box_id") != 3)).select("doc", "page_id", "id")
    return ops.bridge_faults(blocks, order, blocks.where("asset < 5 or doc % 9 <> 0").select("doc", "asset").distinct(), "doc", "page_id", "id")


def prj_direct_middle(spark: SparkSession, d: str) -> DataFrame:
    """Blocks in the order of their numbers backwards."""
    blocks = _blocks(spark, d).withColumn("id", F.col("box_id"))
    order = blocks.select("doc", "page_id", "id", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("id"))).alias("place"))
    return ops.middle(ops.bridged(blocks, order, "doc", "page_id", "id", "place", F.lit(64.0), F.lit(64.0)))


def txt_inline_order(spark: SparkSession, d: str) -> DataFrame:
    """Words as spans, every fifth length a formula; the output cuts texts elsewhere, and turns some of them round."""
    words = F.split("text", " ")
    math = lambda w: F.length(w) % 5 == 0
    span = lambda kind, w: F.struct(F.lit(kind).alias("kind"), w.alias("content"))
    expected = F.transform(words, lambda w: F.when(math(w), span("math", w)).otherwise(span("text", w)))
    seen = F.when(F.col("turn") % 4 == 0, F.reverse(words)).otherwise(words)
    actual = F.flatten(F.transform(seen, lambda w: F.when(math(w), F.array(span("math", w))).otherwise(F.array(span("text", F.substring(w, 1, 2)), span("text", F.substring(w, 3, 1 << 30))))))
    return turns(spark, d).select("conv_id", "turn", ops.inline_order_fault(expected, actual).alias("fault"))


def con_layout_grid(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as cells of three tables a page, dealt row by row."""
    own = boxes(spark, d).select("page_id", (F.col("box_id") % 3).alias("t"), "box_id", "label")
    k = F.row_number().over(Window.partitionBy("page_id", "t").orderBy("box_id")) - 1
    cells = own.select("page_id", "t", F.floor(k / (1 + F.col("t") % 2)).alias("row"), (k % (1 + F.col("t") % 2)).alias("col"), F.when((F.col("box_id") == 5) & (F.col("label") == "N"), 2).otherwise(1).alias("rowspan"), F.lit(1).alias("colspan"), (F.col("label") != "R").alias("filled"))
    role = F.when(F.col("page_id") % 5 == 0, "layout").when(F.col("page_id") % 7 == 0, "data")
    tables = cells.groupBy("page_id", "t").agg((F.max("row") + 1).alias("rows")).select("page_id", "t", "rows", (1 + F.col("t") % 2).alias("cols"), (F.col("page_id") % 11 != 0).alias("borderless"), role.alias("role"))
    return ops.layout_grid_faults(tables, cells, cells.withColumn("rowspan", F.lit(1)), "page_id", "t")


def rev_replan_math(spark: SparkSession, d: str) -> DataFrame:
    """Turns with formulas at their end; an unknown one was a picture before in every second conversation."""
    made = F.concat(F.translate("text", "$\\", ""), _picked(("", " $x^2$ is", r" $\foo{x}$", r" \alpha", " $5."), F.col("turn")))
    previous = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit(r"\foo {x}"))).otherwise(F.array().cast("array<string>"))
    plan = ops.replanned_text(made, previous, invalid_xml(made))
    return turns(spark, d).select("conv_id", "turn", F.get_json_object(plan, "$.policy").alias("policy"), F.get_json_object(plan, "$.reason").alias("reason"), F.size(F.from_json(F.get_json_object(plan, "$.parts"), "array<string>")).cast("long").alias("n_parts"))


def _description(path: str, media: str, schema: dict, **more) -> dict:
    return {"paths": {path: {"post": {"requestBody": {"content": {media: {"schema": schema}}}} | more}}}


#: Descriptions of services: a part by reference, a joined one, an old one, a circle, and none.
DESCRIPTIONS = (
    _description("/a", "multipart/form-data", {"$ref": "#/s/up~1load"}) | {"s": {"up/load": {"properties": {"data": {"format": "binary"}}, "required": ["data"]}}},
    _description("/b", "application/json", {"allOf": [{"properties": {"x": {}}, "required": ["x"]}, {"properties": {"Image": {}}, "required": ["Image", "x"]}]}, deprecated=True),
    _description("/c", "text/plain", {"properties": {"file": {}}}),
    _description("/d", "application/json", {"$ref": "#/s"}) | {"s": {"$ref": "#/s"}},
)


def prj_openapi(spark: SparkSession, d: str) -> DataFrame:
    text = _picked((*map(json.dumps, DESCRIPTIONS), "{"), F.col("n_nationkey"))
    found = table(spark, d, "nation").select("n_nationkey", F.posexplode(ops.offered_uploads(text)).alias("rank", "u"))
    return found.select("n_nationkey", "rank", "u.path", "u.transport", "u.file_field", F.array_join("u.required", ",").alias("required"), "u.deprecated")


QUERIES = [prj_bridge, prj_direct_middle, txt_inline_order, con_layout_grid, rev_replan_math, prj_openapi]

_BLOCKS = f"""{BOXES}, blocks AS (
  SELECT page_id // 10 AS doc, page_id, box_id, x0, y0, x1, y1, page_id * 100 + CASE WHEN page_id % 63 = 0 AND box_id = 2 THEN 1 ELSE box_id END AS id,
    ['heading', 'caption', 'footer', 'table', 'paragraph'][box_id % 5 + 1] AS kind, ['text', 'image', 'text', 'formula'][box_id % 4 + 1] AS content, CASE WHEN box_id % 4 = 1 THEN box_id % 7 END AS asset FROM boxes)"""

ORACLES = {
    "prj_bridge": f"""WITH {_BLOCKS}, o AS (SELECT doc, page_id, id FROM blocks WHERE page_id % 46 <> 0 OR box_id <> 3),
f AS (SELECT doc, 0 AS rank FROM blocks GROUP BY doc, id HAVING count(*) > 1
  UNION ALL SELECT doc, 1 FROM blocks b WHERE (SELECT count(*) FROM o WHERE o.doc = b.doc AND o.page_id = b.page_id AND o.id = b.id) <> 1
  UNION ALL SELECT doc, 2 FROM blocks b WHERE asset IS NOT NULL AND NOT EXISTS (SELECT 1 FROM blocks c WHERE c.doc = b.doc AND (c.asset < 5 OR c.doc % 9 <> 0) AND c.asset = b.asset))
SELECT doc, ['BRIDGE_DUPLICATE_SOURCE_ID', 'BRIDGE_INCOMPLETE_READING_ORDER', 'BRIDGE_ASSET_MISSING'][min(rank) + 1] AS fault FROM f GROUP BY doc""",
    "prj_direct_middle": f"""WITH {_BLOCKS}, e AS (SELECT *, CASE content WHEN 'image' THEN 'image' WHEN 'formula' THEN 'equation' ELSE CASE kind WHEN 'heading' THEN 'paragraph_title' WHEN 'caption' THEN 'image_caption' WHEN 'footer' THEN 'footer' WHEN 'table' THEN CASE WHEN box_id % 2 = 1 THEN 'table' ELSE 'text' END ELSE 'text' END END AS type FROM blocks)
SELECT doc, page_id, box_id AS id, row_number() OVER (PARTITION BY page_id ORDER BY box_id DESC) - 1 AS raw_index, type, x0 / 64 AS x0, y0 / 64 AS y0, x1 / 64 AS x1, y1 / 64 AS y1,
CASE WHEN type = 'paragraph_title' THEN CAST(2 AS BIGINT) END AS level, CASE WHEN type IN ('image', 'table') THEN type || '_body' END AS body FROM e""",
    "txt_inline_order": """WITH w AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: CASE WHEN length(w) % 5 = 0 THEN chr(1) || w || chr(1) ELSE w END) AS s FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN turn % 4 = 0 AND array_to_string(s, '') <> array_to_string(list_reverse(s), '') THEN 'INLINE_ORDER_CHANGED' END AS fault FROM w UNION ALL SELECT conv_id, turn, NULL FROM conversations WHERE text IS NULL""",
    "con_layout_grid": f"""WITH {BOXES}, c AS (SELECT page_id, box_id % 3 AS t, row_number() OVER (PARTITION BY page_id, box_id % 3 ORDER BY box_id) - 1 AS k, label <> 'R' AS filled, box_id = 5 AND label = 'N' AS tall, 1 + box_id % 3 % 2 AS cols FROM boxes),
g AS (SELECT page_id, t, cols, count(*) AS n, max(k) // cols + 1 AS rows, bool_or(tall) AS tall, count(*) FILTER (filled) AS filled, max(k) FILTER (filled) AS last FROM c GROUP BY page_id, t, cols)
SELECT page_id, t, 'UNEXPECTED_LAYOUT_GRID' AS fault FROM g WHERE CASE WHEN page_id % 5 = 0 THEN tall WHEN page_id % 7 = 0 THEN false
ELSE page_id % 11 = 0 OR tall OR n <> rows * cols OR last IS NULL OR filled <> last + 1 OR n - 1 - last >= cols OR (rows = 1 AND n - 1 - last > 0) END""",
}

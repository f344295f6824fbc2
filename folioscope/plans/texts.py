"""Queries on markers, formulas, tables and styles of texts; those without SQL are compared with hand-written rows in the tests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import formulas, kernels, markdown, projection, styles
from ..operators.kernels import mapped_text as mapped
from .views import BOXES, RUNS, boxes, runs, table, turns

FORMULAS = [r"\frac{a}{b}+x^2", r"x_1^{2} = \sqrt{y}", r"\alpha\cdot b", r"a^{", r"\unknown{x}"]
TABLES = ["<table><tr><td>a</td><td rowspan=2>b</td></tr><tr><td>c</td></tr></table>", "<table><tr><td colspan=2>a</td></tr><tr><td>b</td></tr></table>", "<p>x</p>"]
WIRES = ['[{"label": "text", "bbox": [0, 0, 1, 1]}]', "[{'label': 'text'}]", '{"label": 1}', "[{'label': open('x')}]"]


def picked(values: list[str], by: F.Column) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))


def marked(spark: SparkSession, d: str) -> DataFrame:
    """Lines, some with markers before them."""
    head = picked(["3. ", "A、", "## ", "", "x "], F.col("ord"))
    return runs(spark, d).select("doc_id", "ord", F.when(F.col("ord") % 7 == 0, "第 12 题").otherwise(F.concat(head, "text")).alias("text"))


def txt_question(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).select("doc_id", "ord", F.col("text").rlike(t.QUESTION).alias("hit"))


def txt_option(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).select("doc_id", "ord", F.col("text").rlike(t.OPTION).alias("hit"))


def txt_caption(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).select("doc_id", "ord", F.col("text").rlike(t.CAPTION).alias("hit"))


def txt_split_markers(spark: SparkSession, d: str) -> DataFrame:
    """Turns with markers planted in front of their lines."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.concat((i + 1).cast("string"), F.lit(". ")), x))
    texts = turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.array_join(lines, "\n").alias("text"))
    return markdown.blocks(texts, "id", "text")


def txt_math_spans(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("for $5 and US$7.50, $x_1+2$ or $$y$$ of "), F.replace(F.col("text"), F.lit("$"), F.lit("")))
    return turns(spark, d).select("conv_id", "turn", mapped("string", lambda s: json.dumps(markdown.math_spans(s)), made).alias("spans"))


def txt_unrendered_math(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.replace(F.replace(F.col("text"), F.lit("$"), F.lit("")), F.lit("\\"), F.lit("")), picked(["", r" \(x", r" \alpha b", r" \foo bar", r" \foo {b}", " $5."], F.col("turn")))
    return turns(spark, d).select("conv_id", "turn", mapped("boolean", markdown.residual_math, made).alias("residual"))


def txt_md_unsupported(spark: SparkSession, d: str) -> DataFrame:
    made = picked(["plain words", "# heading", "- item", "> quote", "a **b**", "see [x](y)", "<b>x</b>", "fill ____ in", "$a*b$", "a `b`", "<img src=x>"], F.col("conv_id"))
    return turns(spark, d).select("conv_id", "turn", mapped("boolean", markdown.unsupported, made).alias("unsupported"))


def _tree(s: str, what) -> str | None:
    try:
        return what(s)
    except formulas.FormulaError:
        return None


def txt_formula_tree(spark: SparkSession, d: str) -> DataFrame:
    made = picked(FORMULAS, F.col("box_id"))
    return boxes(spark, d).select("page_id", "box_id", mapped("string", lambda s: _tree(s, formulas.canonical), made).alias("tree"))


def txt_latex_to_omml(spark: SparkSession, d: str) -> DataFrame:
    made = picked(FORMULAS, F.col("box_id"))
    return boxes(spark, d).select("page_id", "box_id", mapped("string", lambda s: _tree(s, formulas.omml), made).alias("omml"))


def txt_formula_verify(spark: SparkSession, d: str) -> DataFrame:
    """Whether a formula and one that is spaced differently are the same."""
    made = picked(FORMULAS[:3], F.col("box_id"))
    one, other = mapped("string", formulas.canonical, made), mapped("string", formulas.canonical, F.replace(F.concat(made, F.when(F.col("label") == "R", "+1").otherwise("")), F.lit("+"), F.lit(" + ")))
    return boxes(spark, d).select("page_id", "box_id", (one == other).alias("same"))


def txt_html_grid(spark: SparkSession, d: str) -> DataFrame:
    cells = mapped("string", lambda s: None if (g := kernels.html_grid(s)) is None else json.dumps(g), picked(TABLES, F.col("box_id")))
    return boxes(spark, d).select("page_id", "box_id", cells.alias("cells"))


def geo_col_widths(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d).select("conv_id", "turn", F.to_json(F.array(F.slice(F.split("text", " "), 1, 4))).alias("grid"))
    return rows.select("conv_id", "turn", mapped("string", lambda s: json.dumps(kernels.column_widths(json.loads(s), 400.0)), F.col("grid")).alias("widths"))


def join_formula_matching(spark: SparkSession, d: str) -> DataFrame:
    """Each page's largest matching of N boxes with the A boxes that touch their rows."""
    b = boxes(spark, d)
    n, a = b.where("label = 'N'"), b.where("label = 'A'").select("page_id", F.col("box_id").alias("other"), F.col("y0").alias("oy0"), F.col("y1").alias("oy1"))
    edges = n.join(a, "page_id").where("y0 < oy1 and oy0 < y1").groupBy("page_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("box_id", "other")))).alias("edges"))

    def size(text: str) -> int:
        links: dict[str, list[str]] = {}
        for e in json.loads(text):
            links.setdefault(str(e["box_id"]), []).append(str(e["other"]))
        return len(kernels.maximum_matching(links))

    return edges.select("page_id", mapped("long", size, F.col("edges")).alias("matched"))


def prj_monkey(spark: SparkSession, d: str) -> DataFrame:
    count = mapped("long", lambda s: -1 if (x := kernels.literal_blocks(s)[1]) is None else len(x), picked(WIRES, F.col("box_id")))
    return boxes(spark, d).select("page_id", "box_id", count.alias("blocks"))


def prj_wire_kind(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("page_id", "box_id", mapped("string", lambda s: kernels.literal_blocks(s)[0], picked(WIRES, F.col("box_id"))).alias("kind"))


def prj_structural_contract(spark: SparkSession, d: str) -> DataFrame:
    """Contracts that differ in prose and in the order of lists alone have one hash."""
    made = F.format_string('{"title": "%s", "required": [%s], "type": "object"}', "event_type", F.when(F.col("event_id") % 3 == 0, '"a", "b"').when(F.col("event_id") % 3 == 1, '"b", "a"').otherwise('"c"'))

    def contract(value):
        if isinstance(value, dict):
            return {k: contract(v) for k, v in value.items() if k not in projection.PROSE}
        return sorted(map(contract, value), key=lambda v: json.dumps(v, sort_keys=True)) if isinstance(value, list) else value

    rows = table(spark, d, "events").select("event_id", F.sha2(mapped("string", lambda s: json.dumps(contract(json.loads(s)), sort_keys=True), made), 256).alias("sha"))
    return rows.groupBy("sha").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).select("first", "n")


def con_math_content(spark: SparkSession, d: str) -> DataFrame:
    """Whether a tree of a formula holds any text."""
    trees = ['["row"]', '["row",["text","x"]]', '["row",["sqrt",["row"]]]', '["row",["sqrt",["row",["text","y"]]]]']

    def full(tree) -> bool:
        return bool(tree) and (tree[0] == "text" and bool(tree[1]) or any(full(x) for x in tree[1:] if isinstance(x, list)))

    return boxes(spark, d).select("page_id", "box_id", mapped("boolean", lambda s: full(json.loads(s)), picked(trees, F.col("box_id"))).alias("full"))


def chain_of(spark: SparkSession, d: str, **own: F.Column) -> DataFrame:
    """Boxes as styles: style n builds on style n - 1."""
    above = F.when(F.col("box_id") > 1, (F.col("box_id") - 1).cast("string"))
    return boxes(spark, d).select("page_id", F.col("box_id").cast("string").alias("style"), above.alias("based_on"), *(c.alias(n) for n, c in own.items()))


def vis_run_hidden(spark: SparkSession, d: str) -> DataFrame:
    return styles.hidden(chain_of(spark, d, enabled=F.col("label") == "R"), "page_id")


def con_pagination(spark: SparkSession, d: str) -> DataFrame:
    """What each style ends up with, where every A box sets it."""
    own = chain_of(spark, d, value=F.when(F.col("label") == "A", F.col("box_id").cast("string")))
    return styles.inherited(own, "page_id", ["value"]).where("value is not null")


def vis_font_closure(spark: SparkSession, d: str) -> DataFrame:
    """Fonts 1, 2, ... of a page, each an alias of the next where that is no R box."""
    b = boxes(spark, d)
    aliases = b.where("label <> 'R' and box_id > 1").select("page_id", (F.col("box_id") - 1).cast("string").alias("font"), F.col("box_id").cast("string").alias("other"))
    return styles.font_closure(b.where("box_id = 1").select("page_id", F.lit("1").alias("font")), aliases, "page_id")


def _bounded(spark: SparkSession, d: str, rules: list[tuple]) -> DataFrame:
    own = boxes(spark, d).select("page_id", F.col("label").alias("property"), F.col("x0").alias("value"))
    return styles.first_fault(own, spark.createDataFrame(rules, "rank int, property string, least double, most double, code string"), "page_id")


def vis_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _bounded(spark, d, [(1, "A", 5.0, 40.0, "A_OUT_OF_BOUNDS"), (2, "N", 0.0, 45.0, "N_OUT_OF_BOUNDS")])


def vis_background(spark: SparkSession, d: str) -> DataFrame:
    return _bounded(spark, d, [(1, "R", 0.0, 30.0, "UNSUPPORTED_VISIBILITY_STYLE")])


QUERIES = [
    txt_question, txt_option, txt_caption, txt_split_markers, txt_math_spans, txt_unrendered_math, txt_md_unsupported, txt_formula_tree, txt_latex_to_omml, txt_formula_verify, txt_html_grid, geo_col_widths, join_formula_matching, prj_monkey, prj_wire_kind,
    prj_structural_contract, con_math_content, vis_run_hidden, con_pagination, vis_font_closure, vis_bounds, vis_background,
]

_MARKED = "CASE WHEN ord % 7 = 0 THEN '第 12 题' ELSE ['3. ', 'A、', '## ', '', 'x '][ord % 5 + 1] || text END"
_BOUND = "WITH {boxes}, r AS (SELECT page_id, min(CASE {cases} END) AS k FROM boxes GROUP BY page_id) SELECT page_id, CASE k {names} END AS code FROM r WHERE k IS NOT NULL"

ORACLES = {
    "txt_question": rf"WITH {RUNS} SELECT doc_id, ord, regexp_matches({_MARKED}, '^[ \t]*[0-9]+[.．、]([^0-9]|$)') AS hit FROM runs",
    "txt_option": rf"WITH {RUNS} SELECT doc_id, ord, regexp_matches({_MARKED}, '^[ \t]*[A-D][.．、]') AS hit FROM runs",
    "txt_caption": rf"WITH {RUNS} SELECT doc_id, ord, regexp_matches({_MARKED}, '^[ \t]*第[ \t]*[0-9]+[ \t]*题[ \t]*$') AS hit FROM runs",
    "txt_math_spans": "SELECT conv_id, turn, '[[20, 27], [31, 36]]' AS spans FROM conversations",
    "txt_unrendered_math": "SELECT conv_id, turn, turn % 6 IN (1, 2, 4) AS residual FROM conversations",
    "txt_md_unsupported": "SELECT conv_id, turn, conv_id % 11 IN (2, 3, 4, 5, 6, 9) AS unsupported FROM conversations",
    "txt_formula_verify": f"WITH {BOXES} SELECT page_id, box_id, label <> 'R' AS same FROM boxes",
    "txt_html_grid": f"""WITH {BOXES} SELECT page_id, box_id, CASE WHEN box_id % 3 = 0 THEN '[[0, 0, 1, 1, "a"], [0, 1, 2, 1, "b"], [1, 0, 1, 1, "c"]]' END AS cells FROM boxes""",
    "prj_monkey": f"WITH {BOXES} SELECT page_id, box_id, CAST(CASE WHEN box_id % 4 < 2 THEN 1 ELSE -1 END AS BIGINT) AS blocks FROM boxes",
    "prj_wire_kind": f"WITH {BOXES} SELECT page_id, box_id, ['json', 'python_literal_list', 'json', 'unknown'][box_id % 4 + 1] AS kind FROM boxes",
    "prj_structural_contract": "SELECT min(event_id) AS first, count(*) AS n FROM events GROUP BY event_id % 3 = 2",
    "con_math_content": f"WITH {BOXES} SELECT page_id, box_id, box_id % 2 = 1 AS full FROM boxes",
    "vis_run_hidden": f"WITH {BOXES} SELECT page_id, CAST(box_id AS VARCHAR) AS style, count(*) FILTER (label = 'R') OVER (PARTITION BY page_id ORDER BY box_id) % 2 = 1 AS hidden FROM boxes",
    "con_pagination": f"WITH {BOXES}, v AS (SELECT page_id, CAST(box_id AS VARCHAR) AS style, max(CASE WHEN label = 'A' THEN box_id END) OVER (PARTITION BY page_id ORDER BY box_id) AS m FROM boxes) SELECT page_id, style, CAST(m AS VARCHAR) AS value FROM v WHERE m IS NOT NULL",
    "vis_font_closure": f"WITH {BOXES}, v AS (SELECT page_id, box_id, count(*) FILTER (label = 'R' AND box_id > 1) OVER (PARTITION BY page_id ORDER BY box_id) AS broken FROM boxes) SELECT page_id, CAST(box_id AS VARCHAR) AS font FROM v WHERE broken = 0",
    "vis_bounds": _BOUND.format(boxes=BOXES, cases="WHEN label = 'A' AND (x0 < 5 OR x0 > 40) THEN 1 WHEN label = 'N' AND x0 > 45 THEN 2", names="WHEN 1 THEN 'A_OUT_OF_BOUNDS' ELSE 'N_OUT_OF_BOUNDS'"),
    "vis_background": _BOUND.format(boxes=BOXES, cases="WHEN label = 'R' AND x0 > 30 THEN 1", names="WHEN 1 THEN 'UNSUPPORTED_VISIBILITY_STYLE'"),
}

"""Queries on claims, scores, gates, runs and layout rules, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance as gov
from ..operators import layout_rules as rules
from ..operators import scores as ops
from .views import BOXES, boxes, ledger, manifest, table, turns

GATES = {"error": ("1", "2"), "click": ("0",), "none": ("3",)}


def join_formula_span(spark: SparkSession, d: str) -> DataFrame:
    """R boxes are blocks, which hold their text once or twice; N boxes are formulas."""
    b = boxes(spark, d)
    spans = b.where("label = 'R'").select("page_id", F.col("box_id").alias("block"), (F.col("box_id") % 2).cast("string").alias("latex"), "x0", "y0", "x1", "y1", F.explode(F.sequence(F.lit(1), F.when(F.col("box_id") % 5 == 0, 2).otherwise(1))).alias("i"))
    formulas = b.where("label = 'N'").select("page_id", (F.col("box_id") % 2).cast("string").alias("latex"), *(F.col(c).alias(f"f{c}") for c in ("x0", "y0", "x1", "y1")))
    return ops.unique_spans(spans.drop("i"), formulas, "page_id", 0.25)


def join_image_claim(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).select("page_id", (F.col("box_id") % 2).cast("string").alias("sha"), F.col("box_id").alias("n"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), "label")
    shown = b.where("label <> 'N'").withColumn("width", F.col("width") / F.when(F.col("n") % 3 == 0, 8).otherwise(1))
    return ops.image_claims(shown, b.where("label <> 'A'"), "page_id", "n")


def join_edge_truth(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).select("page_id", (F.col("box_id") % 2).alias("src"), "label", "box_id")
    return ops.edge_truth(b, b.where("box_id % 3 = 0"), b.where("box_id % 3 = 1"), "page_id", "src", "label")


def agg_formula_scores(spark: SparkSession, d: str) -> DataFrame:
    units = boxes(spark, d).select("page_id", F.col("box_id").alias("unit"), F.when(F.col("label") != "R", F.col("label")).alias("tree"), (F.col("x0") < 25).alias("preserved"))
    return ops.formula_scores(units, units.where("tree is not null and unit % 2 = 0"), "page_id", "unit")


def agg_reading_order(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).select("page_id", F.col("box_id").alias("anchor"), "label", F.floor("y0").alias("at"))
    bound = b.where("label <> 'R'").select("page_id", "anchor", F.explode(F.array(F.col("at"), F.col("at") + F.col("anchor") % 3)).alias("paragraph"))
    return ops.reading_order(b, bound, "page_id", "anchor", "anchor", "paragraph")


def agg_page_metrics(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).select("page_id", (F.col("box_id") % 4).alias("anchor"), "label")
    return ops.page_metrics(b, b.where("label = 'A'"), "page_id", "anchor")


def set_union(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    return ops.union_distinct(b.where("label = 'A'").select("page_id", F.floor("x0").alias("x")), b.where("label = 'N'").select("page_id", F.floor("y0").alias("x")))


def grp_sets(spark: SparkSession, d: str) -> DataFrame:
    found = ledger(spark, d).groupingSets([["provider", "status"], ["provider"], []], "provider", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return found.select("provider", "status", F.col("level").cast("long").alias("level"), "n")


def win_option_distribution(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    rows = b.where("label = 'A'").select("page_id", "box_id", (F.col("box_id") % 3).alias("cells"))
    return ops.distributed(b.where("label = 'N'").select("page_id", "box_id"), rows, "page_id", "box_id")


def gate_commands(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger(spark, d).select("provider", F.when(F.col("status") == "FAILED", F.col("event_id") % 5).otherwise(0).cast("long").alias("code"))
    return ops.worst(rows, "provider")


def gate_test_report(spark: SparkSession, d: str) -> DataFrame:
    """Tests as users; each report is a row of the ledger."""
    rows = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("passed").alias("status"), "value")
    return rows.groupBy("user_id").agg(F.max_by("status", F.when(F.col("status") == "failed", 2).when(F.col("status") == "skipped", 1).otherwise(0)).alias("status"), F.count("*").alias("reports"), F.max("value").alias("longest"))


def con_gate_deps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("user_id < 4").select(F.col("event_type").alias("ticket"), F.col("user_id").cast("string").alias("needs"))
    return ops.gate_faults(rows, GATES, "ticket", "needs")


def con_mentions(spark: SparkSession, d: str) -> DataFrame:
    return ops.missing_mentions(table(spark, d, "documents"), ["the", "and", "esta", "zz"], "doc_id", "text")


def con_inputs(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit(":"), "lang").alias("name"), "lang", F.length("text").alias("size"), F.sha2("text", 256).alias("sha"))
    found = own.where("doc_id % 11 <> 0").withColumns({"lang": F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")), "size": F.col("size") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0), "sha": F.when(F.col("doc_id") % 2 == 0, F.col("sha")).otherwise(F.lit("0"))})
    return ops.drift(own, found, "doc_id", [("name", "NAME_DRIFT"), ("lang", "FORMAT_DRIFT"), ("size", "SIZE_DRIFT"), ("sha", "HASH_DRIFT")])


def con_run(spark: SparkSession, d: str) -> DataFrame:
    own = manifest(spark, d).select("doc_id", "sha")
    now = own.where("doc_id % 7 <> 1").withColumn("sha", F.when(F.col("doc_id") % 5 == 2, F.lit("0")).otherwise(F.col("sha")))
    return ops.run_faults(own.where("doc_id % 6 <> 3"), now, "doc_id", "sha")


def con_metadata_drift(spark: SparkSession, d: str) -> DataFrame:
    """Contracts by provider, whose model list and structure may have changed."""
    rows = ledger(spark, d).groupBy("provider").agg(F.collect_set("event_type").alias("ids"))
    expected = spark.createDataFrame([(0, "error"), (1, "nothing")], "provider long, expected string")
    return ops.observed_models(rows, expected, "provider").select("provider", F.when(~F.col("expected_present"), "MODEL_IDENTITY_DRIFT").alias("fault"))


def obs_models(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("ids"))
    expected = spark.createDataFrame([(i, t) for i in range(0, 60, 2) for t in ("error",)], "user_id long, expected string")
    return ops.observed_models(rows, expected, "user_id")


def obs_save(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", *ops.observed_response(F.when(F.col("event_type") == "error", 500).otherwise(200), F.col("event_type"), F.col("props")))


def cfg_guard(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    url = F.when(F.col("event_id") % 4 == 0, "http://a/v1?x").when(F.col("event_id") % 4 == 1, None).otherwise("http://a/v1")
    fault = ops.provider_faults(F.col("value") - 50, F.when(F.col("user_id") % 3 == 0, " ").otherwise(F.col("event_type")), url, (F.col("event_id") % 3).cast("int"), 1)
    return e.select("event_id", fault.alias("fault"))


def con_schema(spark: SparkSession, d: str) -> DataFrame:
    """Whether the properties are an object whose k is a whole number."""
    made = F.when(F.col("event_id") % 5 == 0, '{"k": "x"}').when(F.col("event_id") % 5 == 1, "{k").when(F.col("event_id") % 5 == 2, "{}").otherwise(F.col("props"))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(made), "$.k", "variant"))
    return table(spark, d, "events").select("event_id", F.coalesce(kind == "BIGINT", F.lit(False)).alias("valid"))


def rev_integrate(spark: SparkSession, d: str) -> DataFrame:
    own = manifest(spark, d).select("doc_id", "split", F.lit(3).cast("long").alias("version"))
    new = own.where("doc_id % 4 = 0").withColumns({"doc_id": F.when(F.col("doc_id") % 8 == 0, F.col("doc_id")).otherwise(-F.col("doc_id")), "split": F.lit("changed")})
    return ops.integrated(own, new, "doc_id", "version")


def rev_import(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed rows with the seal of the bundle that they were made from; automatic ones keep theirs."""
    own = manifest(spark, d).select("doc_id", "sha", "split")
    reviewed = own.where("split = 'holdout'").select("doc_id", F.sha2(F.concat("sha", F.lit("+")), 256).alias("reviewed"))
    return own.join(reviewed, "doc_id", "left").select("doc_id", F.col("sha").alias("parent_sha"), F.coalesce("reviewed", "sha").alias("sha"), F.col("reviewed").isNotNull().alias("reviewed"))


def rev_archive(spark: SparkSession, d: str) -> DataFrame:
    """A copy is checked against the hashes of what it was made from."""
    own = manifest(spark, d).select("doc_id", "sha")
    copied = table(spark, d, "documents").select("doc_id", F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha"))
    return gov.compared(own, copied, "doc_id", "sha")


def rev_ab_compare(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    return ops.compared_runs(b.where("label <> 'R'").select("page_id", F.floor("x0").alias("x")), b.where("label <> 'A'").select("page_id", F.floor("x0").alias("x")))


def rev_guarded_adopt(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).select("page_id", "box_id", F.lit("paragraph").alias("kind"), F.col("label").alias("sha"), F.array("x0", "y0").alias("bbox"), (F.col("box_id") % 5 == 0).alias("locked"))
    hint = b.select("page_id", F.when(F.col("box_id") % 7 != 3, F.col("box_id")).alias("box_id"), F.concat(F.lit("k"), F.col("box_id").cast("string")).alias("kind"), F.when(F.col("box_id") % 3 == 0, "other").otherwise(F.col("sha")).alias("sha"), "bbox")
    return ops.adopted(b, hint, "page_id", "box_id")


def sink_public_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("secret", F.lit("x"))
    return ops.public_summary(rows, ["n_chars", "text", "secret", "none"], "doc_id")


def join_protocol_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Users' requests against a schedule of three."""
    schedule = spark.createDataFrame([(1, "click"), (2, "view"), (3, "error")], "ordinal long, event_type string")
    rows = table(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_id", "event_type")
    return gov.protocol_prefix(rows, schedule, "event_id", "event_type").select("run_id", "event_id", "ordinal")


def con_body_region(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    sections = b.select("page_id", "box_id", F.when(F.col("box_id") % 3 != 0, F.col("x1") * 500).cast("long").alias("width"), F.lit(None).cast("long").alias("height"), (F.col("x0") * 40).cast("long").alias("left"), F.when(F.col("label") == "A", 200).cast("long").alias("right"), F.lit(None).cast("long").alias("top"), (F.col("y0") * 300 - 300).cast("long").alias("bottom"), F.lit(0).cast("long").alias("gutter"))
    return rules.body_regions(sections, "page_id")


def vis_theme_font(spark: SparkSession, d: str) -> DataFrame:
    names = boxes(spark, d).select("page_id", F.get(F.array(*map(F.lit, ("majorAscii", "minorEastAsia", "minorBidi", "bogus"))), (F.col("box_id") % 4).cast("int")).alias("name")).distinct()
    parts = names.select("page_id").distinct().where("page_id % 2 = 0")
    theme = parts.select("page_id", F.lit("major").alias("part"), F.lit("latin").alias("kind"), F.lit("Cambria").alias("typeface")).union(parts.select("page_id", F.lit("minor"), F.lit("ea"), F.lit("SimSun")))
    return rules.theme_fonts(names, theme, "page_id")


def vis_table_width(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    sized = b.select("page_id", "box_id", (F.col("x1") * 10).cast("long").cast("string").alias("raw"), F.when(F.col("label") == "A", "pct").when(F.col("label") == "R", "auto").otherwise("dxa").alias("kind"), F.lit(1200).cast("long").alias("available"))
    cells = sized.where("box_id % 2 = 0").withColumns({"row": F.col("box_id") % 4, "reserved": F.lit(100).cast("long")})
    return rules.table_width_faults(sized.where("box_id % 2 = 1"), cells, "page_id")


def vis_page_background(spark: SparkSession, d: str) -> DataFrame:
    color = F.when(F.col("box_id") % 3 == 0, "FFFFFF").when(F.col("box_id") % 3 == 1, "FF0000")
    return boxes(spark, d).select("page_id", "box_id", rules.page_background(color, F.col("box_id") % 4 == 3, F.when(F.col("label") == "A", 1).otherwise(0)).alias("fault"))


def con_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as paragraphs in styles s0 to s3; s1 builds on s2 and s2 on s3."""
    b = boxes(spark, d)
    paragraphs = b.select("page_id", F.col("box_id").alias("paragraph"), F.concat(F.lit("s"), (F.col("box_id") % 4).cast("string")).alias("style"), F.when(F.col("label") == "A", "0").when((F.col("label") == "R") & (F.col("box_id") % 3 == 0), "x").alias("number"))
    pages = b.select("page_id").distinct()
    listed = lambda rows, *names: F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names, strict=True))) for r in rows))).alias("x")
    steps = [("s0", "s0", 0), ("s1", "s1", 0), ("s1", "s2", 1), ("s1", "s3", 2), ("s2", "s2", 0), ("s2", "s3", 1), ("s3", "s3", 0)]
    chain = pages.select("page_id", listed(steps, "style", "ancestor", "distance")).select("page_id", "x.*")
    numbers = pages.select("page_id", listed([("s2", "0"), ("s3", "7")], "style", "number")).select("page_id", "x.*")
    return rules.numbered_paragraphs(paragraphs, chain, numbers, "page_id")


def pic_structure(spark: SparkSession, d: str) -> DataFrame:
    drawings = boxes(spark, d).select("page_id", (F.col("box_id") % 5).alias("drawing"), F.lit(1).alias("inline"), F.when(F.col("x0") < 5, 2).otherwise(1).alias("pictures"), F.lit(1).alias("blips"), F.when(F.col("x0") < 48, F.lit("p")).alias("name"), (F.col("label") == "A").alias("hidden"), (F.col("label") == "R").alias("linked"))
    return rules.picture_structure(drawings, "page_id")


def pic_scale(spark: SparkSession, d: str) -> DataFrame:
    wide, high = (F.col("x1") - F.col("x0")).cast("long"), (F.col("y1") - F.col("y0")).cast("long")
    fault = rules.picture_scale(wide * 9525, high * 9525 + F.when(F.col("box_id") % 3 == 0, 9000).otherwise(0), wide, F.when(F.col("box_id") % 7 != 0, high), F.lit(200000), F.lit(150000))
    return boxes(spark, d).select("page_id", "box_id", fault.alias("fault"))


def pic_effects(spark: SparkSession, d: str) -> DataFrame:
    extras = F.when(F.col("box_id") % 4 == 0, F.array(F.lit("effectLst"))).when(F.col("box_id") % 4 == 1, F.array(F.lit("effectLst"), F.lit("ln"))).otherwise(F.array(F.lit("glow")))
    fault = rules.picture_effects(F.lit(0), F.when(F.col("label") == "R", 90).otherwise(0), F.lit(False), F.when(F.col("x0") < 45, "rect").otherwise("ellipse"), extras, ["effectLst", "ln"])
    return boxes(spark, d).select("page_id", "box_id", fault.alias("fault"))


def pic_orphan(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).select("page_id", (F.col("box_id") % 4).alias("image"), "label")
    return rules.orphans(b, b.where("label = 'N'"), "page_id", "image")


def wid_container(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    columns = b.where("label <> 'R'").select("page_id", (F.col("box_id") - 1).alias("column"), (F.col("x1") * 20).cast("long").alias("width"))
    cells = b.select("page_id", F.col("box_id").alias("cell"), (F.col("box_id") - 1).alias("first"), (F.col("box_id") % 3 + 1).alias("span"), F.when(F.col("box_id") % 2 == 0, 600).cast("long").alias("preferred"), F.lit(216).cast("long").alias("margins"), (F.col("y0") * 10).cast("long").alias("indents"))
    return rules.cell_widths(columns, cells, "page_id").groupBy("page_id", "cell").agg(F.min("width").alias("width"), F.min("fault").alias("fault"))


def con_extension(spark: SparkSession, d: str) -> DataFrame:
    rows = boxes(spark, d).select("page_id", F.col("box_id").alias("id"), F.array(F.lit("w"), F.when(F.col("box_id") % 3 == 0, "x14").otherwise("wp")).alias("path"), (F.col("label") != "R").alias("payload"))
    return rules.wrapped_payload(rows, ["w", "wp", "a"], "page_id")


def con_visible(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    pictures = b.where("label <> 'R'").select("page_id", F.when(F.col("x0") > 45, "IMAGE_DISPLAY_SCALE_INVALID").alias("fault"))
    return rules.visible_faults(b.where("label = 'R' and box_id % 3 = 0").select("page_id"), pictures, "page_id")


def bind_ranges(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).select("page_id", "box_id", F.lit("p").alias("container"), F.col("label").alias("text"), F.when(F.col("label") == "A", F.lit("i")).alias("image"))
    other = b.where("box_id % 6 <> 5").withColumns({"container": F.when(F.col("box_id") % 5 == 0, "tc").otherwise(F.col("container")), "text": F.when(F.col("box_id") % 4 == 0, "q").otherwise(F.col("text")), "image": F.when(F.col("box_id") % 3 == 0, F.lit(None)).otherwise(F.col("image"))})
    return rules.bound_ranges(other, b.where("box_id <> 1"), "page_id", "box_id")


QUERIES = [
    join_formula_span, join_image_claim, join_edge_truth, agg_formula_scores, agg_reading_order, agg_page_metrics, set_union, grp_sets, win_option_distribution, gate_commands, gate_test_report, con_gate_deps, con_mentions, con_inputs, con_run, con_metadata_drift,
    obs_models, obs_save, cfg_guard, con_schema, rev_integrate, rev_import, rev_archive, rev_ab_compare, rev_guarded_adopt, sink_public_summary, join_protocol_prefix, con_body_region, vis_theme_font, vis_table_width, vis_page_background, con_numbering, pic_structure,
    pic_scale, pic_effects, pic_orphan, wid_container, con_extension, con_visible, bind_ranges,
]

_INSIDE = "greatest(0, least(f.x1, b.x1) - greatest(f.x0, b.x0)) * greatest(0, least(f.y1, b.y1) - greatest(f.y0, b.y0)) > 0.25 * ((f.x1 - f.x0) * (f.y1 - f.y0))"
_WIDTH = "CASE label WHEN 'R' THEN 0 WHEN 'A' THEN CASE WHEN CAST(x1 * 10 AS BIGINT) * 1200 // 5000 <= 1200 THEN CAST(x1 * 10 AS BIGINT) * 1200 // 5000 END ELSE CASE WHEN CAST(x1 * 10 AS BIGINT) <= 1200 THEN CAST(x1 * 10 AS BIGINT) END END"

ORACLES = {
    "join_formula_span": f"WITH {BOXES}, m AS (SELECT b.page_id, b.box_id, count(f.box_id) AS c FROM boxes b LEFT JOIN boxes f ON f.page_id = b.page_id AND f.label = 'N' AND f.box_id % 2 = b.box_id % 2 AND {_INSIDE} WHERE b.label = 'R' GROUP BY b.page_id, b.box_id) SELECT page_id, box_id AS block, CAST(CASE WHEN box_id % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n, c = 1 AND box_id % 5 <> 0 AS reliable FROM m",
    "join_image_claim": f"""WITH {BOXES}, i AS (SELECT page_id, box_id, box_id % 2 AS s, x1 - x0 AS w, y1 - y0 AS h, row_number() OVER (PARTITION BY page_id, box_id % 2 ORDER BY box_id) AS k FROM boxes WHERE label <> 'A'), v AS (SELECT page_id, box_id, box_id % 2 AS s, (x1 - x0) / CASE WHEN box_id % 3 = 0 THEN 8 ELSE 1 END AS w, y1 - y0 AS h, row_number() OVER (PARTITION BY page_id, box_id % 2 ORDER BY box_id) AS k FROM boxes WHERE label <> 'N')
SELECT i.page_id, i.box_id AS image, v.box_id AS drawing, CASE WHEN v.box_id IS NULL THEN 'MISSING_OR_REPLACED_IMAGE' WHEN v.w < i.w * 0.25 OR v.h < i.h * 0.25 THEN 'IMAGE_DISPLAY_SCALE_INVALID' ELSE 'CLAIMED' END AS status FROM i LEFT JOIN v ON i.page_id = v.page_id AND i.s = v.s AND i.k = v.k""",
    "join_edge_truth": f"WITH {BOXES}, g AS (SELECT page_id, box_id % 2 AS src, label, count(*) AS predicted, bool_or(box_id % 3 = 0) AS expected, count(*) FILTER (box_id % 3 = 1) AS u FROM boxes GROUP BY ALL) SELECT page_id, src, label, predicted, expected, CAST(expected AS BIGINT) AS matched, CASE WHEN expected THEN 0 ELSE least(predicted, u) END AS excluded FROM g",
    "agg_formula_scores": f"WITH {BOXES} SELECT page_id, count(*) AS total, count(*) FILTER (label <> 'R') AS supported, count(*) FILTER (label <> 'R' AND box_id % 2 = 0) AS matched, count(*) FILTER (label = 'R') AS unsupported, count(*) FILTER (label <> 'R' AND box_id % 2 = 1 AND x0 < 25) AS fallback FROM boxes GROUP BY page_id",
    "agg_reading_order": f"""WITH {BOXES}, a AS (SELECT page_id, box_id, CASE WHEN label <> 'R' THEN CAST(floor(y0) AS BIGINT) END AS lo, CASE WHEN label <> 'R' THEN CAST(floor(y0) AS BIGINT) + box_id % 3 END AS hi FROM boxes), p AS (SELECT page_id, lo, hi, lead(lo) OVER w AS nlo, lead(hi) OVER w AS nhi, lead(box_id) OVER w AS n FROM a WINDOW w AS (PARTITION BY page_id ORDER BY box_id)),
s AS (SELECT page_id, CASE WHEN lo IS NULL OR nlo IS NULL OR lo IN (nlo, nhi) OR hi IN (nlo, nhi) THEN 'm' WHEN hi < nlo THEN 'c' ELSE 'i' END AS k FROM p WHERE n IS NOT NULL) SELECT page_id, count(*) FILTER (k = 'c') AS correct, count(*) FILTER (k = 'i') AS incorrect, count(*) FILTER (k = 'm') AS missing FROM s GROUP BY page_id""",
    "agg_page_metrics": f"WITH {BOXES} SELECT page_id, count(*) AS expected, count(*) FILTER (EXISTS (SELECT 1 FROM boxes c WHERE c.page_id = b.page_id AND c.label = 'A' AND c.box_id % 4 = b.box_id % 4)) AS matched FROM boxes b GROUP BY page_id",
    "set_union": f"WITH {BOXES} SELECT page_id, CAST(floor(x0) AS BIGINT) AS x FROM boxes WHERE label = 'A' UNION SELECT page_id, CAST(floor(y0) AS BIGINT) FROM boxes WHERE label = 'N'",
    "grp_sets": "SELECT provider, status, CAST(grouping(provider, status) AS BIGINT) AS level, count(*) AS n FROM (SELECT user_id % 3 AS provider, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'COMPLETE' END AS status FROM events) GROUP BY GROUPING SETS ((provider, status), (provider), ())",
    "win_option_distribution": f"""WITH {BOXES}, o AS (SELECT page_id, box_id, row_number() OVER (PARTITION BY page_id ORDER BY box_id) AS place, count(*) OVER (PARTITION BY page_id) AS n FROM boxes WHERE label = 'N'), r AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY box_id) AS row, box_id % 3 AS cells, count(*) OVER (PARTITION BY page_id) AS k, sum(box_id % 3) OVER (PARTITION BY page_id) AS t FROM boxes WHERE label = 'A'),
s AS (SELECT r.*, CASE WHEN t = n THEN cells ELSE n // k END AS c, t <> n AS inferred FROM r JOIN (SELECT DISTINCT page_id, n FROM o) q ON r.page_id = q.page_id WHERE t = n OR n % k = 0), e AS (SELECT *, sum(c) OVER (PARTITION BY page_id ORDER BY row) AS last FROM s)
SELECT o.page_id, box_id, e.row, CAST(place - (last - c) AS BIGINT) AS cell, inferred FROM o JOIN e ON o.page_id = e.page_id AND place > last - c AND place <= last""",
    "gate_commands": "SELECT user_id % 3 AS provider, count(*) AS commands, count(*) FILTER (event_type = 'error' AND event_id % 5 <> 0) AS failed, max(CASE WHEN event_type = 'error' THEN event_id % 5 ELSE 0 END) AS code FROM events GROUP BY 1",
    "gate_test_report": "SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'signup') THEN 'skipped' ELSE 'passed' END AS status, count(*) AS reports, max(value) AS longest FROM events GROUP BY user_id",
    "con_gate_deps": "WITH r AS (SELECT * FROM (VALUES ('error', '1,2'), ('click', '0'), ('none', '3')) AS v(ticket, wanted)), f AS (SELECT r.ticket, wanted, coalesce((SELECT string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) FROM events WHERE user_id < 4 AND event_type = r.ticket), '') AS found FROM r) SELECT ticket, found FROM f WHERE found <> wanted",
    "con_mentions": "SELECT doc_id, id FROM documents CROSS JOIN (SELECT unnest(['the', 'and', 'esta', 'zz']) AS id) WHERE NOT contains(text, id)",
    "con_inputs": "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'MISSING' WHEN doc_id % 5 = 0 THEN 'FORMAT_DRIFT' WHEN doc_id % 3 = 0 THEN 'SIZE_DRIFT' WHEN doc_id % 2 = 1 THEN 'HASH_DRIFT' END AS drift FROM documents",
    "con_run": "SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'MISSING' WHEN doc_id % 6 = 3 THEN 'UNSEALED' ELSE 'CHANGED' END AS fault FROM documents WHERE (doc_id % 7 = 1 AND doc_id % 6 <> 3) OR (doc_id % 7 <> 1 AND (doc_id % 6 = 3 OR doc_id % 5 = 2))",
    "con_metadata_drift": "SELECT user_id % 3 AS provider, CASE WHEN user_id % 3 <> 0 OR NOT bool_or(event_type = 'error') THEN 'MODEL_IDENTITY_DRIFT' END AS fault FROM events GROUP BY user_id % 3",
    "obs_models": "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS n_distinct, user_id < 60 AND user_id % 2 = 0 AND bool_or(event_type = 'error') AS expected_present FROM events GROUP BY user_id",
    "obs_save": "SELECT event_id, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, event_type AS content_type, CAST(strlen(props) AS BIGINT) AS bytes, sha256(props) AS body_sha256, sha256(CASE WHEN event_type = 'error' THEN '500' ELSE '200' END || '|' || event_type || '|' || strlen(props)) AS fact_sha256 FROM events",
    "cfg_guard": "SELECT event_id, CASE WHEN NOT value - 50 > 0 THEN 'TIMEOUT_NOT_POSITIVE' WHEN user_id % 3 = 0 THEN 'NAME_EMPTY' WHEN event_id % 4 IN (0, 1) THEN 'BASE_URL_HAS_QUERY' WHEN event_id % 3 < 1 THEN 'RETRIES_TOO_FEW' END AS fault FROM events",
    "con_schema": "SELECT event_id, event_id % 5 > 2 AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS valid FROM events",
    "rev_integrate": f"SELECT doc_id, {"CASE WHEN doc_id % 24 < 12 THEN 'development' WHEN doc_id % 24 < 18 THEN 'validation' ELSE 'holdout' END"} AS split, CAST(3 AS BIGINT) AS version FROM documents WHERE doc_id % 8 <> 0 UNION ALL SELECT CASE WHEN doc_id % 8 = 0 THEN doc_id ELSE -doc_id END, 'changed', 4 FROM documents WHERE doc_id % 4 = 0",
    "rev_import": "SELECT doc_id, sha256(text) AS parent_sha, CASE WHEN doc_id % 24 >= 18 THEN sha256(sha256(text) || '+') ELSE sha256(text) END AS sha, doc_id % 24 >= 18 AS reviewed FROM documents",
    "rev_ab_compare": f"WITH {BOXES}, c AS (SELECT page_id, CAST(floor(x0) AS BIGINT) AS x, count(*) FILTER (label <> 'R') - count(*) FILTER (label <> 'A') AS n FROM boxes GROUP BY ALL) SELECT page_id, x, CASE WHEN n > 0 THEN 'a' ELSE 'b' END AS side FROM c, LATERAL (SELECT unnest(range(abs(n))) AS i)",
    "rev_guarded_adopt": f"""WITH {BOXES}, h AS (SELECT page_id, max(box_id) AS last FROM boxes GROUP BY page_id) SELECT page_id, box_id, CASE WHEN t THEN 'k' || box_id ELSE 'paragraph' END AS kind, t AS taken FROM (SELECT *, box_id % 7 <> 3 AND box_id % 5 <> 0 AND box_id % 3 <> 0 AS t FROM boxes)
UNION ALL SELECT b.page_id, last + row_number() OVER (PARTITION BY b.page_id ORDER BY 'k' || box_id), 'k' || box_id, true FROM boxes b JOIN h ON b.page_id = h.page_id WHERE box_id % 7 = 3""",
    "sink_public_summary": "SELECT doc_id, n_chars FROM documents",
    "join_protocol_prefix": "WITH n AS (SELECT user_id AS run_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal FROM events) SELECT run_id, event_id, ordinal FROM n WHERE ordinal > 3 OR event_type <> ['click', 'view', 'error'][ordinal]",
    "con_body_region": f"""WITH {BOXES}, s AS (SELECT page_id, coalesce(CASE WHEN box_id % 3 <> 0 THEN CAST(x1 * 500 AS BIGINT) END, 12240) AS w, CAST(x0 * 40 AS BIGINT) AS l, CASE WHEN label = 'A' THEN 200 ELSE 1440 END AS r, CAST(y0 * 300 - 300 AS BIGINT) AS b FROM boxes)
SELECT page_id, w - l - r AS usable_width, 15840 - 1440 - b AS usable_height, CASE WHEN greatest(w, 15840) > 31680 THEN 'UNSUPPORTED_PAGE_SIZE' WHEN least(l, r, b) < 0 OR least(w - l - r, 15840 - 1440 - b) < 240 THEN 'UNSUPPORTED_TEXT_POSITION' END AS fault FROM s""",
    "vis_theme_font": f"WITH {BOXES}, n AS (SELECT DISTINCT page_id, ['majorAscii', 'minorEastAsia', 'minorBidi', 'bogus'][box_id % 4 + 1] AS name FROM boxes), f AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN CASE name WHEN 'majorAscii' THEN 'Cambria' WHEN 'minorEastAsia' THEN 'SimSun' END END AS typeface FROM n) SELECT *, CASE WHEN typeface IS NULL THEN 'UNSUPPORTED_FONT_MAPPING' END AS fault FROM f",
    "vis_table_width": f"""WITH {BOXES}, s AS (SELECT page_id, box_id, {_WIDTH} AS w FROM boxes), g AS (SELECT page_id, bool_or(w IS NULL) OR coalesce(sum(w), 0) > 1200 AS bad FROM s WHERE box_id % 2 = 1 GROUP BY page_id UNION ALL SELECT page_id, bool_or(w IS NULL) OR coalesce(sum(w), 0) + 100 > 1200 FROM s WHERE box_id % 2 = 0 GROUP BY page_id, box_id % 4)
SELECT page_id, 'UNSUPPORTED_TABLE_WIDTH' AS fault FROM g GROUP BY page_id HAVING bool_or(bad)""",
    "vis_page_background": f"WITH {BOXES} SELECT page_id, box_id, CASE WHEN box_id % 3 = 1 OR box_id % 4 = 3 OR label = 'A' THEN 'UNSUPPORTED_VISIBILITY_STYLE' END AS fault FROM boxes",
    "con_numbering": f"WITH {BOXES}, n AS (SELECT page_id, box_id AS paragraph, coalesce(CASE WHEN label = 'A' THEN '0' WHEN label = 'R' AND box_id % 3 = 0 THEN 'x' END, CASE box_id % 4 WHEN 1 THEN '0' WHEN 2 THEN '0' WHEN 3 THEN '7' END) AS v FROM boxes) SELECT page_id, paragraph, v IS NOT NULL AND v <> '0' AS numbered FROM n",
    "pic_structure": f"WITH {BOXES} SELECT page_id, box_id % 5 AS drawing, CASE WHEN x0 < 5 OR x0 >= 48 OR count(*) OVER (PARTITION BY page_id, box_id % 5) > 1 THEN 'INVALID_DRAWING_CONTAINER' WHEN label = 'A' THEN 'HIDDEN_CONTENT' WHEN label = 'R' THEN 'UNSUPPORTED_LINKED_IMAGE' END AS fault FROM boxes",
    "pic_scale": f"""WITH {BOXES}, s AS (SELECT page_id, box_id, CAST(x1 - x0 AS BIGINT) AS w, CAST(y1 - y0 AS BIGINT) AS h FROM boxes), t AS (SELECT *, w * 9525 AS cx, h * 9525 + CASE WHEN box_id % 3 = 0 THEN 9000 ELSE 0 END AS cy FROM s)
SELECT page_id, box_id, CASE WHEN cx > 200000 OR cy > 150000 OR least(cx, cy) < 12700 OR box_id % 7 = 0 OR abs(cx * h - cy * w) * 50 > greatest(cx * h, cy * w) THEN 'IMAGE_DISPLAY_SCALE_INVALID' END AS fault FROM t""",
    "pic_effects": f"WITH {BOXES} SELECT page_id, box_id, CASE WHEN label = 'R' OR x0 >= 45 OR box_id % 4 > 1 THEN 'UNSUPPORTED_IMAGE_RENDERING' END AS fault FROM boxes",
    "pic_orphan": f"WITH {BOXES} SELECT page_id, box_id % 4 AS image, 'INVALID_DRAWING_CONTAINER' AS fault FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM boxes c WHERE c.page_id = b.page_id AND c.label = 'N' AND c.box_id % 4 = b.box_id % 4)",
    "wid_container": f"""WITH {BOXES}, c AS (SELECT b.page_id, b.box_id, b.y0, count(k.box_id) AS n, sum(CAST(k.x1 * 20 AS BIGINT)) AS grid FROM boxes b LEFT JOIN boxes k ON k.page_id = b.page_id AND k.label <> 'R' AND k.box_id >= b.box_id AND k.box_id <= b.box_id + b.box_id % 3 GROUP BY b.page_id, b.box_id, b.y0),
w AS (SELECT page_id, box_id AS cell, n, CAST(least(grid, CASE WHEN box_id % 2 = 0 THEN 600 ELSE grid END) - 216 - CAST(y0 * 10 AS BIGINT) AS BIGINT) AS width FROM c) SELECT page_id, cell, width, CASE WHEN n < cell % 3 + 1 OR width <= 0 THEN 'INVALID_TABLE_GRID' END AS fault FROM w""",
    "con_extension": f"WITH {BOXES} SELECT page_id, box_id AS id, 'UNSUPPORTED_EXTENSION' AS fault FROM boxes WHERE label <> 'R' AND box_id % 3 = 0",
    "con_visible": f"WITH {BOXES}, f AS (SELECT page_id, bool_or(label = 'R' AND box_id % 3 = 0) AS h, bool_or(label <> 'R' AND x0 > 45) AS p FROM boxes GROUP BY page_id) SELECT page_id, CASE WHEN h THEN 'HIDDEN_CONTENT' ELSE 'IMAGE_DISPLAY_SCALE_INVALID' END AS fault FROM f WHERE h OR p",
    "bind_ranges": f"""WITH {BOXES} SELECT page_id, box_id, CASE WHEN box_id % 6 = 5 THEN 'MISSING' WHEN box_id = 1 THEN 'EXTRA' WHEN box_id % 5 = 0 THEN 'CONTAINER_MISMATCH' WHEN box_id % 4 = 0 THEN 'TEXT_MISMATCH' ELSE 'IMAGE_MISMATCH' END AS code FROM boxes
WHERE (box_id = 1) OR (box_id % 6 = 5) OR box_id % 5 = 0 OR box_id % 4 = 0 OR (box_id % 3 = 0 AND label = 'A')""",
}

"""Queries on manifests, ledgers, catalogues and scores, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..operators import boxes as box_ops
from ..operators import evaluation as ev
from ..operators import governance as gov
from ..operators import sequences as seq
from .geometry import PAIR_IOU
from .views import BOXES, LEDGER, MANIFEST, PRED, boxes, ledger, manifest, predicted, table, turns

STATUSES = ["view", "click", "purchase", "error", "timeout"]


def con_leakage(spark: SparkSession, d: str) -> DataFrame:
    return gov.leaks(manifest(spark, d), "sha", "split").withColumnRenamed("groups", "splits")


def con_quota(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([("development", 400), ("validation", 300), ("holdout", 200), ("reserve", 10)], "split string, target long")
    return gov.shortfalls(manifest(spark, d), "split", targets)


def agg_dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).groupBy("source", "split").agg(F.count("*").alias("n"), F.countDistinct("sha").alias("originals"))


def con_unique(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("long").alias("line"))
    return gov.repeated(rows, "page_id", "line")


def con_contiguous_pages(spark: SparkSession, d: str) -> DataFrame:
    return gov.contiguous(turns(spark, d).where("turn <> 1 or conv_id % 3 <> 0"), "turn", "conv_id")


def join_dangling(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    found = gov.dangling(table(spark, d, "orders"), "o_custkey", known, "c_custkey")
    return found.select(F.col("o_orderkey").alias("key"))


def join_allow_list(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return gov.allowed(table(spark, d, "orders"), rules, "o_custkey").select(F.col("o_orderkey").alias("key"))


def con_roles(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose nation isn't in the region that their segment asks for."""
    due = F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(F.col("n_regionkey"))
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.where(F.col("n_regionkey") != due).select("c_custkey", "n_regionkey")


def con_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Holdout documents without an access event."""
    seen = table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("doc_id")).distinct()
    return manifest(spark, d).where("split = 'holdout'").join(seen, "doc_id", "left_anti").select("doc_id")


def join_seal(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    declared = docs.where("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("sha"))
    actual = docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 13 == 0, F.upper("text")).otherwise(F.col("text")), 256).alias("sha"))
    return gov.compared(declared, actual, "doc_id", "sha")


def join_catalog_3way(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    changed = docs.withColumn("lang", F.when(F.col("doc_id") % 17 == 0, "xx").otherwise(F.col("lang")))
    return gov.three_ways(docs, docs.where("doc_id % 5 <> 0"), changed.where("doc_id % 6 <> 0"), "doc_id", "lang")


def set_multiset_equal(spark: SparkSession, d: str) -> DataFrame:
    langs = table(spark, d, "documents").select("lang", "source")
    return gov.unequal_rows(langs, langs.where("source <> 'src3'").union(langs.where("source = 'src5'")))


def set_except(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "documents").select("doc_id")
    return keys.exceptAll(table(spark, d, "labels").select("doc_id"))


def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


def con_protocol(spark: SparkSession, d: str) -> DataFrame:
    return gov.matrix(spark, [("monkey", 3), ("pp", 3), ("ovis", 1)], ("jpg", "png")).select("ordinal", "provider", "variant", "repeat_index")


def con_once(spark: SparkSession, d: str) -> DataFrame:
    return gov.at_most_once(ledger(spark, d), "event_id", "provider", "variant", "duration_ms").select("event_id")


def join_cache_reuse(spark: SparkSession, d: str) -> DataFrame:
    own = ledger(spark, d).withColumn("input", F.floor("duration_ms").cast("long"))
    asked = own.where("event_id % 10 = 0").select("event_id", "provider", "input")
    cache = own.where("event_id % 10 <> 0").withColumnRenamed("event_id", "cache_id")
    return gov.reused(asked, cache, "cache_id", "provider", "input").select("event_id", "response_id")


def rev_merge_events(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").select("event_id", "event_type")
    return gov.merged_events(own.where("event_id % 3 <> 0"), own.where("event_id % 2 = 0").withColumn("event_type", F.lit("new")), "event_id")


def rev_gc(spark: SparkSession, d: str) -> DataFrame:
    return gov.unreferenced(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


def win_next_version(spark: SparkSession, d: str) -> DataFrame:
    version = F.regexp_extract("source", r"([0-9]+)$", 1).cast("long")
    return table(spark, d, "documents").groupBy("lang").agg((F.max(version) + 1).alias("next_version"))


def agg_metric(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    eligible, scored = F.col("doc_id") % 2 == 0, F.col("quality").isNotNull()
    return rows.groupBy("source").agg(*m.metric(eligible, scored, F.coalesce(F.col("toxic") == 0, F.lit(False)), F.coalesce(F.col("quality") == 0, F.lit(False))))


def agg_durations(spark: SparkSession, d: str) -> DataFrame:
    return ev.durations(ledger(spark, d), "provider", "variant")


def agg_pairwise_agreement(spark: SparkSession, d: str) -> DataFrame:
    requests = ledger(spark, d).select(F.floor(F.col("event_id") / 14).cast("long").alias("run"), F.col("event_id").alias("request_id"), "provider", "variant", (F.floor(F.col("event_id") / 4) % 3).alias("repeat_index"))
    return ev.agreements(requests, "run")


def agg_detection(spark: SparkSession, d: str) -> DataFrame:
    truth, found = boxes(spark, d), predicted(spark, d).where("box_id % 4 <> 0")
    same = box_ops.iou_edges(truth, found, "page_id", 0.5).where("a_box_id = b_box_id").select("page_id", "iou")
    scores = ev.detection(truth, found, same, "page_id")
    return scores.select("page_id", "gt_count", "prediction_count", "tp", "fp", "fn", "precision", "recall", F.round("iou_mean", 9).alias("iou_mean"), "iou_median")


def join_order_pairs(spark: SparkSession, d: str) -> DataFrame:
    bound = boxes(spark, d).select("page_id", F.col("label").alias("anchor"), F.when(F.col("box_id") % 5 != 0, F.col("y0")).alias("position"))
    return seq.reading_pairs(bound, "anchor", "position", "page_id").select("page_id", "anchor", "next_anchor", "status")


def agg_order_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.order_counts(join_order_pairs(spark, d), "anchor")


def agg_relation_scores(spark: SparkSession, d: str) -> DataFrame:
    own = boxes(spark, d).select("page_id", "label")
    return ev.edge_scores(own.where("label <> 'N'"), own, "page_id", "label")


def ref_valid(spark: SparkSession, d: str) -> DataFrame:
    """Tables of two columns, one row a line item, in which every fourth cell spans both."""
    wide = F.col("box_id") % 4 == 0
    columns = F.when(wide, F.array(F.lit(0).cast("long"))).otherwise(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    cells = boxes(spark, d).select("page_id", (F.col("box_id") - 1).alias("row"), F.when(wide, 2).otherwise(1).cast("long").alias("colspan"), F.explode(columns).alias("col"))
    cells = cells.withColumn("rowspan", F.when((F.col("row") % 6 == 5) & (F.col("col") == 1), 2).otherwise(1).cast("long"))
    return ev.table_tiling(cells, "page_id").select("page_id", "rows", "cols", "ok")


def agg_necessary_content(spark: SparkSession, d: str) -> DataFrame:
    units = boxes(spark, d).select("page_id", (F.col("box_id") % 2 == 0).alias("correct"), (F.col("label") == "N").alias("preserved"), (F.col("x0") > 40).alias("failed"))
    return ev.necessary_content(units, "page_id")


def agg_document_status(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("x0") > 48, "FAIL").when(F.col("x0") > 40, "REVIEW_REQUIRED").when(F.col("x0") > 5, "PASS").otherwise("NOT_SCORED")
    return ev.document_status(boxes(spark, d).select("page_id", status.alias("status")), "page_id")


def agg_layout_status(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).groupBy("page_id").agg(gov.rolled_up(F.col("label")).alias("status"))


def agg_page_editable(spark: SparkSession, d: str) -> DataFrame:
    own = boxes(spark, d)
    auxiliary = own.where("y0 < 5").select("page_id", "box_id")
    return own.join(auxiliary, ["page_id", "box_id"], "left_anti").groupBy("page_id").agg(F.bool_or(F.col("label") == "N").alias("editable"))


def agg_qa(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).groupBy("page_id").agg(F.countDistinct("label").alias("labels"), m.count_if(F.col("x0") > 25).alias("open_issues"))


def agg_text_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("lang", F.length("text").alias("length"), (F.col("doc_id") % 10).alias("distance"))
    return ev.micro_average(rows, "distance", "length", "lang")


def agg_annotation_counts(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return joined.groupBy("source").agg(m.count_if(F.col("quality") == 1).alias("confirmed"), m.count_if(F.col("quality") == 0).alias("uncertain"), F.sum(F.length("text")).cast("long").alias("characters"))


def agg_test_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.status_counts(table(spark, d, "events").select(F.col("event_type").alias("status")), STATUSES)


def obs_error(spark: SparkSession, d: str) -> DataFrame:
    http = F.when(F.col("status") == "FAILED", 500).otherwise(200 + F.col("event_id") % 150)
    code = F.when(F.col("event_id") % 7 == 0, 1).when(F.col("event_id") % 7 == 1, 0)
    return ledger(spark, d).select("event_id", ev.observed_error(http, code).alias("observed"))


def route_budget(spark: SparkSession, d: str) -> DataFrame:
    waiting = F.col("label") != "N"
    budget = boxes(spark, d).groupBy("page_id").agg(F.sum(F.when(waiting, 2).otherwise(0)).cast("long").alias("budget"), m.count_if(waiting).alias("pending"))
    return budget.withColumn("status", F.when(F.col("pending") > 0, "AWAITING").otherwise("LOCAL_COMPLETE"))


def cls_region_purpose(spark: SparkSession, d: str) -> DataFrame:
    """What a region holds, by the set of its labels: figures, text, both, or unknown."""
    labels = F.collect_set("label")
    sets = boxes(spark, d).groupBy("page_id").agg(labels.alias("labels"))
    within = lambda *xs: F.size(F.array_except("labels", F.array(*map(F.lit, xs)))) == 0
    purpose = F.when(within("A"), "figure").when(within("N"), "text").when(within("A", "N"), "mixed").otherwise("unknown")
    return sets.select("page_id", purpose.alias("purpose"))


def cls_native_evidence(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).groupBy("page_id").agg(m.ratio(m.count_if(F.col("label") == "N"), F.count("*")).alias("printable"), m.ratio(m.count_if(F.col("x1") > 50), F.count("*")).alias("invalid"), m.ratio(F.count("*") - F.countDistinct("label"), F.count("*")).alias("duplicate"))


def flt_locked(spark: SparkSession, d: str) -> DataFrame:
    flags = F.array(F.col("l_linestatus"), F.when(F.col("l_quantity") > 40, "user_locked").otherwise("free"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.exists(flags, lambda f: F.contains(f, F.lit("lock"))).alias("locked")).where("locked").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def srt_candidates(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("page_id").orderBy((F.col("label") == "R").cast("int"), F.desc("x0"), "box_id")
    return boxes(spark, d).select("page_id", "box_id", F.row_number().over(order).cast("long").alias("place"))


QUERIES = [
    con_leakage, con_quota, agg_dataset_counts, con_unique, con_contiguous_pages, join_dangling, join_allow_list, con_roles, con_holdout, join_seal, join_catalog_3way, set_multiset_equal, set_except, set_intersect, con_protocol, con_once,
    join_cache_reuse, rev_merge_events, rev_gc, win_next_version, agg_metric, agg_durations, agg_pairwise_agreement, agg_detection, join_order_pairs, agg_order_counts, agg_relation_scores, ref_valid, agg_necessary_content,
    agg_document_status, agg_layout_status, agg_page_editable, agg_qa, agg_text_totals, agg_annotation_counts, agg_test_counts, obs_error, route_budget, cls_region_purpose, cls_native_evidence, flt_locked, srt_candidates,
]

_PAIRS = f"""{BOXES}, sp AS (SELECT page_id, label AS anchor, min(CASE WHEN box_id % 5 <> 0 THEN y0 END) AS lo, max(CASE WHEN box_id % 5 <> 0 THEN y0 END) AS hi FROM boxes GROUP BY ALL),
np AS (SELECT *, lead(anchor) OVER w AS next_anchor, lead(lo) OVER w AS nlo FROM sp WINDOW w AS (PARTITION BY page_id ORDER BY anchor)),
pr AS (SELECT page_id, anchor, next_anchor, CASE WHEN hi IS NULL OR nlo IS NULL THEN 'missing' WHEN hi < nlo THEN 'correct' ELSE 'incorrect' END AS status FROM np WHERE next_anchor IS NOT NULL)"""

ORACLES = {
    "con_leakage": f"WITH {MANIFEST} SELECT sha, count(*) AS n, count(DISTINCT split) AS splits FROM manifest GROUP BY sha HAVING count(DISTINCT split) > 1",
    "con_quota": f"WITH {MANIFEST}, t AS (SELECT * FROM (VALUES ('development', CAST(400 AS BIGINT)), ('validation', 300), ('holdout', 200), ('reserve', 10)) v(split, target)) SELECT t.split, target, count(doc_id) AS n, greatest(CAST(0 AS BIGINT), target - count(doc_id)) AS shortfall FROM t LEFT JOIN manifest m ON t.split = m.split GROUP BY t.split, target",
    "agg_dataset_counts": f"WITH {MANIFEST} SELECT source, split, count(*) AS n, count(DISTINCT sha) AS originals FROM manifest GROUP BY source, split",
    "con_unique": "SELECT l_orderkey AS page_id, CAST(l_linenumber AS BIGINT) AS line, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "con_contiguous_pages": "SELECT conv_id, max(turn) - min(turn) + 1 = count(DISTINCT turn) AS ok FROM conversations WHERE turn <> 1 OR conv_id % 3 <> 0 GROUP BY conv_id",
    "join_dangling": "SELECT o_orderkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')",
    "join_allow_list": "SELECT o_orderkey AS key FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "con_roles": "SELECT c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_regionkey <> 0",
    "con_holdout": f"WITH {MANIFEST} SELECT doc_id FROM manifest WHERE split = 'holdout' AND doc_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click')",
    "join_seal": "WITH a AS (SELECT doc_id, sha256(text) AS s FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 13 = 0 THEN upper(text) ELSE text END) AS s FROM documents WHERE doc_id % 11 <> 0) SELECT * FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'unexpected' WHEN a.s <> b.s THEN 'changed' END AS diff FROM a FULL JOIN b ON a.doc_id = b.doc_id) WHERE diff IS NOT NULL",
    "join_catalog_3way": "SELECT doc_id, diff FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 6 = 0 THEN 'missing:second,third' WHEN doc_id % 5 = 0 THEN 'missing:second' WHEN doc_id % 6 = 0 THEN 'missing:third' WHEN doc_id % 17 = 0 THEN 'fields' END AS diff FROM documents) WHERE diff IS NOT NULL",
    "set_multiset_equal": "SELECT lang, source, 'left' AS side FROM documents WHERE source = 'src3' UNION ALL SELECT lang, source, 'right' FROM documents WHERE source = 'src5'",
    "set_except": "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels",
    "set_intersect": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels",
    "con_protocol": "SELECT CAST(i AS BIGINT) AS ordinal, provider, variant, CAST(r AS BIGINT) AS repeat_index FROM (VALUES (1,'monkey','jpg',1),(2,'monkey','png',1),(3,'monkey','png',2),(4,'monkey','jpg',2),(5,'monkey','jpg',3),(6,'monkey','png',3),(7,'pp','jpg',1),(8,'pp','png',1),(9,'pp','png',2),(10,'pp','jpg',2),(11,'pp','jpg',3),(12,'pp','png',3),(13,'ovis','jpg',1),(14,'ovis','png',1)) v(i, provider, variant, r)",
    "con_once": f"WITH {LEDGER} SELECT min(event_id) AS event_id FROM ledger GROUP BY provider, variant, duration_ms",
    "join_cache_reuse": f"WITH {LEDGER}, l AS (SELECT *, CAST(floor(duration_ms) AS BIGINT) AS input FROM ledger), c AS (SELECT provider, input, min(event_id) AS response_id FROM l WHERE event_id % 10 <> 0 AND status = 'COMPLETE' GROUP BY ALL) SELECT event_id, response_id FROM l LEFT JOIN c USING (provider, input) WHERE event_id % 10 = 0",
    "rev_merge_events": "SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 'new' FROM events WHERE event_id % 6 = 0",
    "rev_gc": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "win_next_version": "SELECT lang, max(CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT)) + 1 AS next_version FROM documents GROUP BY lang",
    "agg_metric": """WITH r AS (SELECT source, d.doc_id % 2 = 0 AS e, quality IS NOT NULL AS s, coalesce(toxic = 0, false) AS c, coalesce(quality = 0, false) AS u FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
a AS (SELECT source, count(*) FILTER (WHERE e) AS e, count(*) FILTER (WHERE e AND s) AS s, count(*) FILTER (WHERE e AND s AND c) AS c, count(*) FILTER (WHERE u) AS u FROM r GROUP BY source)
SELECT source, e AS eligible_count, s AS scored_count, c AS correct_count, u AS uncertain_count, e - s AS not_scored_count, CASE WHEN e > 0 THEN CAST(c AS DOUBLE) / e END AS value, CASE WHEN s = 0 THEN 'NOT_SCORED' WHEN c < s THEN 'FAIL' WHEN s < e THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS status FROM a""",
    "agg_durations": f"WITH {LEDGER} SELECT provider, variant, count(*) FILTER (WHERE status = 'COMPLETE') AS n, median(duration_ms) FILTER (WHERE status = 'COMPLETE') AS median_ms, min(duration_ms) FILTER (WHERE status = 'COMPLETE') AS min_ms, max(duration_ms) FILTER (WHERE status = 'COMPLETE') AS max_ms, count(*) FILTER (WHERE status <> 'COMPLETE') AS failed FROM ledger GROUP BY ALL",
    "agg_pairwise_agreement": f"WITH {LEDGER}, r AS (SELECT event_id // 14 AS run, event_id AS id, provider AS p, variant AS v, (event_id // 4) % 3 AS k FROM ledger), t AS (SELECT a.run, a.id AS a, b.id AS b, CASE WHEN a.p = b.p THEN CASE WHEN a.v = b.v THEN 'within_format_repeat' ELSE 'cross_format' END WHEN a.v = b.v AND a.k = b.k THEN 'inter_provider_agreement' END AS kind FROM r a JOIN r b ON a.run = b.run AND a.id < b.id) SELECT * FROM t WHERE kind IS NOT NULL",
    "agg_detection": f"""WITH {BOXES}, {PRED}, p AS (SELECT * FROM pred WHERE box_id % 4 <> 0), m AS (SELECT a.page_id, {PAIR_IOU} AS iou FROM boxes a JOIN p b ON a.page_id = b.page_id AND a.box_id = b.box_id WHERE {PAIR_IOU} >= 0.5),
x AS (SELECT page_id, count(*) AS gt_count, count(*) FILTER (WHERE box_id % 4 <> 0) AS prediction_count FROM boxes GROUP BY page_id), y AS (SELECT page_id, count(*) AS tp, round(avg(iou), 9) AS iou_mean, median(iou) AS iou_median FROM m GROUP BY page_id)
SELECT page_id, gt_count, prediction_count, coalesce(tp, 0) AS tp, prediction_count - coalesce(tp, 0) AS fp, gt_count - coalesce(tp, 0) AS fn, CASE WHEN prediction_count > 0 THEN CAST(coalesce(tp, 0) AS DOUBLE) / prediction_count END AS precision, CAST(coalesce(tp, 0) AS DOUBLE) / gt_count AS recall, iou_mean, iou_median FROM x LEFT JOIN y USING (page_id)""",
    "ref_valid": f"""WITH {BOXES}, c AS (SELECT page_id, box_id - 1 AS r, CASE WHEN box_id % 4 = 0 THEN 2 ELSE 1 END AS w, unnest(CASE WHEN box_id % 4 = 0 THEN [0] ELSE [0, 1] END) AS k FROM boxes),
h AS (SELECT *, CASE WHEN r % 6 = 5 AND k = 1 THEN 2 ELSE 1 END AS t FROM c), s AS (SELECT page_id, unnest(range(r, r + t)) AS r, k, w FROM h), u AS (SELECT page_id, r, unnest(range(k, k + w)) AS k FROM s)
SELECT page_id, max(r) + 1 AS rows, max(k) + 1 AS cols, count(*) = count(DISTINCT (r, k)) AND count(*) = (max(r) + 1) * (max(k) + 1) AS ok FROM u GROUP BY page_id""",
    "join_order_pairs": f"WITH {_PAIRS} SELECT * FROM pr",
    "agg_order_counts": f"WITH {_PAIRS} SELECT anchor, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'incorrect') AS incorrect, count(*) FILTER (WHERE status = 'missing') AS missing, CAST(count(*) FILTER (WHERE status <> 'missing') AS DOUBLE) / count(*) AS coverage FROM pr GROUP BY anchor",
    "agg_relation_scores": f"WITH {BOXES} SELECT page_id, label, count(*) FILTER (WHERE label <> 'N') AS found, count(*) AS expected, count(*) FILTER (WHERE label <> 'N') AS matched FROM boxes GROUP BY ALL",
    "agg_necessary_content": f"WITH {BOXES}, t AS (SELECT page_id, count(*) AS necessary, count(*) FILTER (WHERE (box_id % 2 = 0 OR label = 'N') AND NOT x0 > 40) AS retained FROM boxes GROUP BY page_id) SELECT *, CAST(retained AS DOUBLE) / necessary AS value FROM t",
    "agg_document_status": f"WITH {BOXES} SELECT page_id, CASE WHEN max(x0) > 48 THEN 'FAIL' WHEN max(x0) > 40 THEN 'REVIEW_REQUIRED' WHEN max(x0) > 5 THEN 'PASS' ELSE 'NOT_SCORED' END AS status FROM boxes GROUP BY page_id",
    "agg_layout_status": f"WITH {BOXES} SELECT page_id, CASE WHEN count(DISTINCT label) = 1 THEN min(label) ELSE 'PARTIAL' END AS status FROM boxes GROUP BY page_id",
    "agg_page_editable": f"WITH {BOXES} SELECT page_id, bool_or(label = 'N') AS editable FROM boxes WHERE NOT y0 < 5 GROUP BY page_id",
    "agg_qa": f"WITH {BOXES} SELECT page_id, count(DISTINCT label) AS labels, count(*) FILTER (WHERE x0 > 25) AS open_issues FROM boxes GROUP BY page_id",
    "agg_text_totals": "WITH t AS (SELECT lang, CAST(sum(doc_id % 10) AS BIGINT) AS distance, CAST(sum(length(text)) AS BIGINT) AS reference_chars FROM documents GROUP BY lang) SELECT *, CAST(distance AS DOUBLE) / reference_chars AS value FROM t",
    "agg_annotation_counts": "SELECT source, count(*) FILTER (WHERE quality = 1) AS confirmed, count(*) FILTER (WHERE quality = 0) AS uncertain, CAST(sum(length(text)) AS BIGINT) AS characters FROM labels JOIN documents USING (doc_id) GROUP BY source",
    "agg_test_counts": "SELECT status, count(event_id) AS n FROM (SELECT unnest(['view', 'click', 'purchase', 'error', 'timeout']) AS status) LEFT JOIN events ON event_type = status GROUP BY status",
    "obs_error": f"WITH {LEDGER}, t AS (SELECT event_id, CASE WHEN status = 'FAILED' THEN 500 ELSE 200 + event_id % 150 END AS h, CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS c FROM ledger) SELECT event_id, (h BETWEEN 400 AND 599) OR (h BETWEEN 200 AND 299 AND coalesce(c <> 0, false)) AS observed FROM t",
    "route_budget": f"WITH {BOXES}, t AS (SELECT page_id, CAST(2 * count(*) FILTER (WHERE label <> 'N') AS BIGINT) AS budget, count(*) FILTER (WHERE label <> 'N') AS pending FROM boxes GROUP BY page_id) SELECT *, CASE WHEN pending > 0 THEN 'AWAITING' ELSE 'LOCAL_COMPLETE' END AS status FROM t",
    "cls_region_purpose": f"WITH {BOXES} SELECT page_id, CASE WHEN bool_and(label = 'A') THEN 'figure' WHEN bool_and(label = 'N') THEN 'text' WHEN bool_and(label IN ('A', 'N')) THEN 'mixed' ELSE 'unknown' END AS purpose FROM boxes GROUP BY page_id",
    "cls_native_evidence": f"WITH {BOXES} SELECT page_id, CAST(count(*) FILTER (WHERE label = 'N') AS DOUBLE) / count(*) AS printable, CAST(count(*) FILTER (WHERE x1 > 50) AS DOUBLE) / count(*) AS invalid, CAST(count(*) - count(DISTINCT label) AS DOUBLE) / count(*) AS duplicate FROM boxes GROUP BY page_id",
    "flt_locked": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY l_orderkey",
    "srt_candidates": f"WITH {BOXES} SELECT page_id, box_id, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN label = 'R' THEN 1 ELSE 0 END, x0 DESC, box_id) AS place FROM boxes",
}


def agg_table_scores(spark: SparkSession, d: str) -> DataFrame:
    """Cells of expected and found tables: how many are there, and how many have the same text."""
    cells = boxes(spark, d).select("page_id", (F.col("box_id") % 3).alias("row"), (F.floor(F.col("box_id") / 3)).cast("long").alias("col"), "label")
    found = cells.withColumn("label", F.when(F.col("col") == 1, "X").otherwise(F.col("label"))).where("row <> 2").withColumnRenamed("label", "got")
    joined = cells.join(found, ["page_id", "row", "col"], "left")
    return joined.groupBy("page_id").agg(F.count("*").alias("cells"), F.count("got").alias("there"), m.count_if(F.col("got") == F.col("label")).alias("equal"))


def con_truth(spark: SparkSession, d: str) -> DataFrame:
    """Order constraints whose ends aren't confirmed boxes."""
    own = boxes(spark, d)
    pairs = own.select("page_id", F.col("box_id").alias("a"), (F.col("box_id") + 2).alias("b"))
    confirmed = own.where("label <> 'R'").select("page_id", "box_id")
    side = lambda c: pairs.join(confirmed.withColumnRenamed("box_id", c), ["page_id", c], "left_anti").select("page_id", "a", "b")
    return side("a").union(side("b")).distinct()


def con_plan_bind(spark: SparkSession, d: str) -> DataFrame:
    """The first reason why a plan doesn't hold any more, or null."""
    rows = ledger(spark, d).withColumn("hash", F.sha2(F.concat_ws(":", "provider", "variant"), 256))
    checks = ((F.col("event_id") % 11 == 0, "PLAN_HASH"), (F.col("duration_ms") > 90, "PLAN_EXPIRED"), (F.col("event_id") % 7 == 0, "PLAN_BUDGET"), (F.substring("hash", 1, 1) == "a", "PLAN_SOURCE"))
    return rows.select("event_id", F.coalesce(*(F.when(c, code) for c, code in checks)).alias("code"))


def con_spans(spark: SparkSession, d: str) -> DataFrame:
    """Columns whose row spans aren't those that the owner gave."""
    own = boxes(spark, d).select("page_id", (F.col("box_id") % 2).alias("col"), F.col("box_id").alias("row"), F.length("label").cast("long").alias("rowspan"))
    return gov.unequal_rows(own, own.where("page_id % 5 <> 0"))


def lin_identity(spark: SparkSession, d: str) -> DataFrame:
    """One hash of each conversation's turns, in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat_ws("|", x["turn"], x["role"], F.sha2(x["text"], 256)))
    return turns(spark, d).groupBy("conv_id").agg(F.sha2(F.array_join(parts, ","), 256).alias("identity"))


QUERIES += [agg_table_scores, con_truth, con_plan_bind, con_spans, lin_identity]
ORACLES |= {
    "agg_table_scores": f"WITH {BOXES} SELECT page_id, count(*) AS cells, count(*) FILTER (WHERE box_id % 3 <> 2) AS there, count(*) FILTER (WHERE box_id % 3 <> 2 AND box_id // 3 <> 1) AS equal FROM boxes GROUP BY page_id",
    "con_truth": f"WITH {BOXES} SELECT a.page_id, a.box_id AS a, a.box_id + 2 AS b FROM boxes a LEFT JOIN boxes b ON a.page_id = b.page_id AND b.box_id = a.box_id + 2 AND b.label <> 'R' WHERE a.label = 'R' OR b.box_id IS NULL",
    "con_plan_bind": f"WITH {LEDGER} SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'PLAN_HASH' WHEN duration_ms > 90 THEN 'PLAN_EXPIRED' WHEN event_id % 7 = 0 THEN 'PLAN_BUDGET' WHEN substr(sha256(provider || ':' || variant), 1, 1) = 'a' THEN 'PLAN_SOURCE' END AS code FROM ledger",
    "con_spans": f"WITH {BOXES} SELECT page_id, box_id % 2 AS col, box_id AS row, CAST(length(label) AS BIGINT) AS rowspan, 'left' AS side FROM boxes WHERE page_id % 5 = 0",
    "lin_identity": "SELECT conv_id, sha256(string_agg(turn || '|' || role || '|' || sha256(text), ',' ORDER BY turn, role, text)) AS identity FROM conversations GROUP BY conv_id",
}

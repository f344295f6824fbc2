"""Queries on texts and turns, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import governance as gov
from ..operators import sequences as seq
from .views import BOXES, RUNS, boxes, runs, table, turns

SPACE = r"[ \t\n\r\f\v]+"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def txt_light(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.length(t.without_space(F.col("text"))).cast("long").alias("n"))


def txt_normalize(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.sha2(t.normalized(F.col("text")), 256).alias("sha"))


def txt_compare(spark: SparkSession, d: str) -> DataFrame:
    spaced = F.regexp_replace("text", " ", "  ")
    return documents(spark, d).select("doc_id", F.col("text").eqNullSafe(spaced).alias("raw_equal"), t.normalized(F.col("text")).eqNullSafe(t.normalized(spaced)).alias("normalized_equal"))


def txt_md_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.size(t.paragraphs(F.col("text"))).cast("long").alias("n"))


def txt_block_kind(spark: SparkSession, d: str) -> DataFrame:
    marks = F.when(F.col("ord") % 9 == 1, F.concat(F.lit("3. "), F.col("text"))).when(F.col("ord") % 9 == 2, F.concat(F.lit("A、"), F.col("text"))).when(F.col("ord") % 9 == 3, F.concat(F.lit("## "), F.col("text")))
    marked = runs(spark, d).withColumn("text", marks.when(F.col("ord") % 9 == 4, "第 12 题").when(F.col("ord") % 9 == 5, "7页").otherwise(F.col("text")))
    return marked.select("doc_id", "ord", t.block_kind(F.col("text")).alias("kind"))


def txt_presence(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items that stand in a document.

    Only an item's inner words are whole words of the document, too: items of six words or more meet it on the four after
    their first. Shorter ones are few and are sought in all documents.
    """
    words = F.split(F.col("text"), SPACE)
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"), words.alias("parts"))
    long = items.where(F.size("parts") >= 6).select("item_id", "item", F.array_join(F.slice("parts", 2, 4), " ").alias("gram"))
    follow = F.arrays_zip(*(F.slice("words", i, F.size("words")).alias(f"w{i}") for i in range(1, 5)))
    grams = F.transform(follow, lambda w: F.concat_ws(" ", w["w1"], w["w2"], w["w3"], w["w4"]))
    docs = documents(spark, d).select("doc_id", "text", words.alias("words"))
    met = docs.select("doc_id", "text", F.explode(F.array_distinct(grams)).alias("gram")).join(long, "gram").where(F.contains("text", "item"))
    short = items.where(F.size("parts") < 6).select("item_id", "item")
    sought = documents(spark, d).join(short, F.contains("text", "item"))
    return met.select("doc_id", "item_id").union(sought.select("doc_id", "item_id")).distinct()


def txt_cer(spark: SparkSession, d: str) -> DataFrame:
    """Distances, in characters, of the first two lines of documents."""
    lines = runs(spark, d)
    a, b = (lines.where(F.col("ord") == i).select("doc_id", F.col("text").alias(f"t{i}")) for i in (1, 2))
    return a.join(b, "doc_id").select("doc_id", F.levenshtein("t1", "t2").cast("long").alias("d"))


def txt_img_tag(spark: SparkSession, d: str) -> DataFrame:
    tagged = runs(spark, d).withColumn("text", F.concat_ws("", "text", F.lit("bbox_"), "ord", F.lit("_2_"), F.col("doc_id") % 50 + 10, F.lit("_40")))
    found = F.regexp_extract_all("text", F.lit(r"bbox_([0-9]+_[0-9]+_[0-9]+_[0-9]+)"), F.lit(1))
    sides = F.split(F.col("box"), "_")
    return tagged.select("doc_id", "ord", F.explode(found).alias("box")).select("doc_id", "ord", *(F.get(sides, F.lit(i)).cast("long").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


def txt_invalid_xml(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.col("doc_id") % 10 == 0, F.concat(F.col("text"), F.lit("\x0b"))).otherwise(F.col("text"))
    return documents(spark, d).select("doc_id", t.invalid_xml(odd).alias("invalid"))


def txt_split_parts(spark: SparkSession, d: str) -> DataFrame:
    found = seq.split_at(runs(spark, d), 120, "doc_id", "ord", "text")
    return found.select("doc_id", "ord", F.length("head").cast("long").alias("n_head"), F.length("tail").cast("long").alias("n_tail"))


def txt_page_join(spark: SparkSession, d: str) -> DataFrame:
    """Adjacent lines of one document joined where the first ends in a comma."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    lines = runs(spark, d).withColumn("before", F.lag("text").over(order))
    return lines.where(F.col("before").endswith(",")).select("doc_id", "ord", F.concat("before", "text").alias("joined"))


def txt_public_id(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", t.public_id(F.concat("source", F.lit("["), "lang", F.lit("]"))).alias("public_id"))


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("page_id") % 3 == 0, "/v1").when(F.col("page_id") % 3 == 1, "/v1/v1/").otherwise("//")
    return table(spark, d, "pages").select("page_id", t.one_v1(F.concat("url", end)).alias("url"))


def url_guard(spark: SparkSession, d: str) -> DataFrame:
    case = F.col("page_id") % 5
    url = F.when(case == 0, "http://127.0.0.1:8080/v1").when(case == 1, "https://localhost:1/").when(case == 2, "http://localhost:80?x=1").when(case == 3, "http://localhost:9000").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", t.loopback(url).alias("ok"))


def prj_redact(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("conv_id", "turn", t.sealed(F.col("text")).alias("t"))


def prj_scrub(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.sha2(t.redacted(F.col("text")), 256).alias("sha"))


def prj_eval_region(spark: SparkSession, d: str) -> DataFrame:
    aliases = {"A": "visual", "N": "text", "R": "title"}
    table_ = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return boxes(spark, d).select("page_id", "box_id", F.coalesce(F.try_element_at(table_, F.col("label")), F.lower("label")).alias("type"))


def doc_policy_lines(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("text").rlike(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}") & ~F.col("text").contains("mail")
    return runs(spark, d).where(hit).select("doc_id", "ord")


def dd_exact_runs(spark: SparkSession, d: str) -> DataFrame:
    own = runs(spark, d).where("text <> ''")
    return gov.kept_once(own, "ord", "doc_id", "text").where("dup_count > 1").select("doc_id", "ord", "dup_count")


def dd_count_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).groupBy("doc_id").agg((F.count("*") - F.countDistinct("text")).alias("duplicates"))


def dd_assets(spark: SparkSession, d: str) -> DataFrame:
    hashed = documents(spark, d).select(F.sha2("text", 256).alias("sha"), "doc_id")
    return gov.first_of(hashed, "doc_id", "first_doc", "doc_id", "sha")


def dd_ordered_unique(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.size(F.array_distinct(F.split("text", "\n"))).cast("long").alias("n"))


def join_last_question(spark: SparkSession, d: str) -> DataFrame:
    found = seq.last_seen(turns(spark, d), F.when(F.col("role") == "user", F.col("turn")), "question_turn", "turn", "conv_id")
    return found.select("conv_id", "turn", "question_turn")


def join_prev_next(spark: SparkSession, d: str) -> DataFrame:
    return seq.neighbours(turns(spark, d), "role", "turn", "conv_id").select("conv_id", "turn", "prev_role", "next_role")


def join_zip_sequence(spark: SparkSession, d: str) -> DataFrame:
    own = turns(spark, d)
    a, b = (own.where(F.col("role") == r).select("conv_id", "turn") for r in ("user", "assistant"))
    return seq.zipped(a, b, "turn", "turn", "conv_id").select("conv_id", "ordinal", F.col("a_turn").alias("question"), F.col("b_turn").alias("answer"))


def win_contiguous_pairs(spark: SparkSession, d: str) -> DataFrame:
    return seq.islands(boxes(spark, d).where("label = 'R'"), "box_id", "page_id").select("page_id", "island", "first_id", "last_id", "n")


def win_shared_rows(spark: SparkSession, d: str) -> DataFrame:
    return seq.shared_rows(boxes(spark, d), "page_id").groupBy("page_id", "row_no").agg(F.count("*").alias("n"))


def win_pairwise(spark: SparkSession, d: str) -> DataFrame:
    found = seq.neighbours(boxes(spark, d).select("page_id", "box_id", "y0"), "y0", "box_id", "page_id")
    return found.where("next_y0 is not null").select("page_id", "box_id", (F.col("next_y0") - F.col("y0")).alias("step"))


def win_sliding_text(spark: SparkSession, d: str) -> DataFrame:
    found = documents(spark, d).select("doc_id", F.split("text", "\n").alias("parts")).select("doc_id", F.explode(seq.windows_of(F.col("parts"), 3)).alias("w"))
    return found.select("doc_id", F.col("w.start").cast("long").alias("start"), F.col("w.n").cast("long").alias("n"), F.length("w.text").cast("long").alias("chars"))


def win_question_ranges(spark: SparkSession, d: str) -> DataFrame:
    """How many turns follow each user turn before the next; 0 is what comes before the first."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    numbered = turns(spark, d).withColumn("question", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order).cast("long"))
    return numbered.groupBy("conv_id", "question").agg(F.count("*").alias("n"))


def lim_topk(spark: SparkSession, d: str) -> DataFrame:
    ranked = documents(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).cast("long"))
    return ranked.where("place <= 2").select("source", "place", "doc_id")


def src_page_select(spark: SparkSession, d: str) -> DataFrame:
    """Pages of selections such as 1-2,5, numbered from 0; selections of over three pages, or of one twice, are rejected."""
    chosen = F.when(F.col("conv_id") % 3 == 0, "1-2,5").when(F.col("conv_id") % 3 == 1, "4").otherwise("1-3,2")
    parts = turns(spark, d).select("conv_id").distinct().select("conv_id", F.explode(F.split(chosen, ",")).alias("part"))
    ends = F.split("part", "-")
    pages = parts.select("conv_id", F.explode(F.sequence(F.get(ends, F.lit(0)).cast("long"), F.element_at(ends, -1).cast("long"))).alias("page"))
    fine = pages.groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("page").alias("u")).where("n <= 3 and n = u").select("conv_id")
    return pages.join(fine, "conv_id").select("conv_id", (F.col("page") - 1).alias("page_index"))


QUERIES = [
    txt_light, txt_normalize, txt_compare, txt_md_paragraphs, txt_block_kind, txt_presence, txt_cer, txt_img_tag, txt_invalid_xml, txt_split_parts, txt_page_join, txt_public_id, url_normalize, url_guard,
    prj_redact, prj_scrub, prj_eval_region, doc_policy_lines, dd_exact_runs, dd_count_runs, dd_assets, dd_ordered_unique, join_last_question, join_prev_next, join_zip_sequence,
    win_contiguous_pairs, win_shared_rows, win_pairwise, win_sliding_text, win_question_ranges, lim_topk, src_page_select,
]

_NORMAL = r"regexp_replace(replace(replace(replace(replace(replace({c}, '$', ''), '\(', ''), '\)', ''), '\[', ''), '\]', ''), '[ \t\n\r\f\v]+', '', 'g')"
_MARKED = "CASE ord % 9 WHEN 1 THEN '3. ' || text WHEN 2 THEN 'A、' || text WHEN 3 THEN '## ' || text WHEN 4 THEN '第 12 题' WHEN 5 THEN '7页' ELSE text END"
_BEFORE = "coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"

ORACLES = {
    "txt_light": r"SELECT doc_id, length(regexp_replace(text, '[ \t\n\r\f\v]+', '', 'g')) AS n FROM documents",
    "txt_normalize": f"SELECT doc_id, sha256({_NORMAL.format(c='text')}) AS sha FROM documents",
    "txt_compare": f"SELECT doc_id, text = replace(text, ' ', '  ') AS raw_equal, {_NORMAL.format(c='text')} = {_NORMAL.format(c=chr(34) + 'spaced' + chr(34))} AS normalized_equal FROM (SELECT *, replace(text, ' ', '  ') AS spaced FROM documents)",
    "txt_md_paragraphs": r"SELECT doc_id, CAST(len(string_split_regex(text, '\n[ \t\r\f\v]*\n')) AS BIGINT) AS n FROM documents",
    "txt_block_kind": rf"""WITH {RUNS}, m AS (SELECT doc_id, ord, {_MARKED} AS s FROM runs) SELECT doc_id, ord, CASE WHEN regexp_matches(s, '^#{{1,6}}[ \t]+') THEN 'heading' WHEN regexp_matches(s, '^[ \t]*[0-9]+[.．、]([^0-9]|$)') THEN 'question'
WHEN regexp_matches(s, '^[ \t]*[A-D][.．、]') THEN 'option' WHEN regexp_matches(s, '^[ \t]*第[ \t]*[0-9]+[ \t]*题[ \t]*$') THEN 'caption' WHEN regexp_matches(s, '^(.*第|[0-9]+页)$') THEN 'footer' ELSE 'paragraph' END AS kind FROM m""",
    "txt_presence": "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "txt_img_tag": f"WITH {RUNS}, t AS (SELECT doc_id, ord, unnest(regexp_extract_all(text || 'bbox_' || ord || '_2_' || (doc_id % 50 + 10) || '_40', 'bbox_([0-9]+_[0-9]+_[0-9]+_[0-9]+)', 1)) AS b FROM runs) SELECT doc_id, ord, CAST(split_part(b, '_', 1) AS BIGINT) AS x0, CAST(split_part(b, '_', 2) AS BIGINT) AS y0, CAST(split_part(b, '_', 3) AS BIGINT) AS x1, CAST(split_part(b, '_', 4) AS BIGINT) AS y1 FROM t",
    "txt_invalid_xml": r"SELECT doc_id, regexp_matches(CASE WHEN doc_id % 10 = 0 THEN text || chr(11) ELSE text END, '[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]') AS invalid FROM documents",
    "txt_split_parts": f"WITH {RUNS}, t AS (SELECT doc_id, ord, text, greatest(0, least(length(text), 120 - {_BEFORE})) AS k FROM runs) SELECT doc_id, ord, CAST(k AS BIGINT) AS n_head, CAST(length(text) - k AS BIGINT) AS n_tail FROM t",
    "txt_page_join": f"WITH {RUNS}, t AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY ord) AS b FROM runs) SELECT doc_id, ord, b || text AS joined FROM t WHERE suffix(b, ',')",
    "txt_public_id": "SELECT doc_id, source || '#' || substr(sha256(source || '[' || lang || ']'), 1, 12) AS public_id FROM documents",
    "url_normalize": r"SELECT page_id, regexp_replace(regexp_replace(url || CASE page_id % 3 WHEN 0 THEN '/v1' WHEN 1 THEN '/v1/v1/' ELSE '//' END, '/+$', ''), '(/v1)+$', '') || '/v1' AS url FROM pages",
    "url_guard": r"SELECT page_id, regexp_matches(CASE page_id % 5 WHEN 0 THEN 'http://127.0.0.1:8080/v1' WHEN 1 THEN 'https://localhost:1/' WHEN 2 THEN 'http://localhost:80?x=1' WHEN 3 THEN 'http://localhost:9000' ELSE url END, '^http://(127\.0\.0\.1|localhost):[0-9]{1,5}(/[^?#@]*)?$') AS ok FROM pages",
    "prj_redact": "SELECT conv_id, turn, '[REDACTED:sha256=' || sha256(text) || ':length=' || length(text) || ']' AS t FROM conversations",
    "prj_scrub": r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}', '[IP]', 'g'), '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+', '[MAIL]', 'g'), '[Bb]earer [A-Za-z0-9._-]+', '[BEARER]', 'g')) AS sha FROM documents",
    "prj_eval_region": f"WITH {BOXES} SELECT page_id, box_id, CASE label WHEN 'A' THEN 'visual' WHEN 'N' THEN 'text' WHEN 'R' THEN 'title' ELSE lower(label) END AS type FROM boxes",
    "doc_policy_lines": rf"WITH {RUNS} SELECT doc_id, ord FROM runs WHERE regexp_matches(text, '[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}') AND NOT contains(text, 'mail')",
    "dd_exact_runs": f"WITH {RUNS} SELECT doc_id, min(ord) AS ord, count(*) AS dup_count FROM runs WHERE text <> '' GROUP BY doc_id, text HAVING count(*) > 1",
    "dd_count_runs": f"WITH {RUNS} SELECT doc_id, count(*) - count(DISTINCT text) AS duplicates FROM runs GROUP BY doc_id",
    "dd_assets": "SELECT sha256(text) AS sha, doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc FROM documents",
    "dd_ordered_unique": "SELECT doc_id, CAST(len(list_distinct(string_split(text, chr(10)))) AS BIGINT) AS n FROM documents",
    "join_last_question": "SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question_turn FROM conversations",
    "join_prev_next": "SELECT conv_id, turn, lag(role) OVER w AS prev_role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "join_zip_sequence": "WITH s AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id, role) AS c FROM conversations) SELECT a.conv_id, a.n AS ordinal, a.turn AS question, b.turn AS answer FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.n = b.n AND a.c = b.c AND a.role = 'user' AND b.role = 'assistant'",
    "win_contiguous_pairs": f"WITH {BOXES}, t AS (SELECT page_id, box_id, box_id - row_number() OVER (PARTITION BY page_id ORDER BY box_id) AS g FROM boxes WHERE label = 'R') SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY min(box_id)) AS island, min(box_id) AS first_id, max(box_id) AS last_id, count(*) AS n FROM t GROUP BY page_id, g",
    "win_shared_rows": f"WITH {BOXES}, t AS (SELECT *, CASE WHEN least(y1, lag(y1) OVER w) - greatest(y0, lag(y0) OVER w) > 0 AND lag(y1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS s FROM boxes WINDOW w AS (PARTITION BY page_id ORDER BY box_id)), r AS (SELECT page_id, sum(s) OVER (PARTITION BY page_id ORDER BY box_id ROWS UNBOUNDED PRECEDING) AS k FROM t) SELECT page_id, CAST(k AS BIGINT) AS row_no, count(*) AS n FROM r GROUP BY page_id, k",
    "win_pairwise": f"WITH {BOXES}, t AS (SELECT page_id, box_id, lead(y0) OVER (PARTITION BY page_id ORDER BY box_id) - y0 AS step FROM boxes) SELECT * FROM t WHERE step IS NOT NULL",
    "win_sliding_text": f"WITH {RUNS}, r AS (SELECT doc_id, ord - 1 AS s, length(text) AS l FROM runs) SELECT a.doc_id, a.s AS start, CAST(k AS BIGINT) AS n, CAST(sum(b.l) + k - 1 AS BIGINT) AS chars FROM r a CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) JOIN r b ON a.doc_id = b.doc_id AND b.s >= a.s AND b.s < a.s + k GROUP BY a.doc_id, a.s, k HAVING count(*) = k",
    "win_question_ranges": "WITH t AS (SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS q FROM conversations) SELECT conv_id, CAST(q AS BIGINT) AS question, count(*) AS n FROM t GROUP BY conv_id, q",
    "lim_topk": "SELECT source, place, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 2",
    "src_page_select": "SELECT conv_id, CAST(unnest(CASE conv_id % 3 WHEN 0 THEN [0, 1, 4] ELSE [3] END) AS BIGINT) AS page_index FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 <> 2",
}

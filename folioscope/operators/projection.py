"""Recognizers' responses, tables and requests as rows and records of one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

# Names of models by provider, what a provider's labels mean, and keys of a contract that say nothing about structure.
MODELS = {"pp_structure": "PP-StructureV3", "ovis_ocr2": "ovis-ocr2", "native_pdf": "PDFium"}
LABEL_KINDS = {"text": "paragraph", "paragraph_title": "heading", "doc_title": "heading", "formula": "formula", "image": "figure", "table": "figure", "figure_title": "caption", "footer": "footer", "number": "page_number"}
PRESERVED = ("image", "table")
PROSE = ("description", "summary", "title", "examples", "example", "available")
TABLE_TAGS = r"(?i)</?(?:table|tbody|tr|td)(?:\s+(?:rowspan|colspan)=\"?[0-9]+\"?)*\s*>|<br\s*/?>"
TABLE = r"(?is)<table\b[^>]*>.*?</table\s*>"


def chat_content(body: Column) -> Column:
    """The text of a chat response: of exactly one choice that stopped by itself and holds a string; null otherwise."""
    parsed = F.try_parse_json(body)
    item = lambda path: F.try_variant_get(parsed, path, "variant")
    text = F.schema_of_variant(item("$.choices[0].message.content")) == "STRING"
    one = item("$.choices[0]").isNotNull() & item("$.choices[1]").isNull()
    stopped = F.try_variant_get(parsed, "$.choices[0].finish_reason", "string") == "stop"
    return F.when(one & stopped & text, F.try_variant_get(parsed, "$.choices[0].message.content", "string"))


def candidate(id_: Column, provider: Column, text: Column) -> Column:
    """A candidate text with an unknown probability."""
    model = F.coalesce(*(F.when(provider == p, F.lit(m)) for p, m in MODELS.items()), provider)
    return F.struct(id_.alias("id"), provider.alias("provider"), model.alias("model_id"), F.lit("unknown").alias("model_version"), F.lit("text").alias("content_kind"), text.alias("text"), F.lit(None).cast("double").alias("engine_confidence"), F.lit(True).alias("selected"))


def block(id_: Column, page: Column, b: g.Box, text: Column, source: Column, kind: Column | None = None) -> Column:
    """The least legal block: one candidate, which is selected, and its own id as provenance."""
    own = candidate(F.concat(id_, F.lit("-c0")), source, text)
    return F.struct(
        id_.alias("id"), F.coalesce(kind if kind is not None else F.lit(None), F.lit("paragraph")).alias("type"), page.alias("page_index"), F.array(*b.sides).alias("bbox"), F.lit(0).alias("rotation"), source.alias("source_type"),
        F.array(id_).alias("provenance_refs"), F.array(own).alias("content_candidates"), own["id"].alias("selected_candidate_id"), F.lit("editable").alias("render_policy"),
    )


def page_record(index: Column, width: Column, height: Column, source: Column, blocks: Column) -> Column:
    """A page that nothing has scored yet; blocks in reading order."""
    return F.struct(index.alias("page_index"), width.alias("width_pt"), height.alias("height_pt"), F.lit(0).alias("rotation"), source.alias("page_type"), F.transform(blocks, lambda b: b["id"]).alias("reading_order"), F.lit("DEMO_REVIEW").alias("routing_decision"))


def layout_record(id_: Column, filename: Column, sha: Column, pages: Column) -> Column:
    """A document of the current schema."""
    source = F.struct(filename.alias("filename"), sha.alias("sha256"), F.size(pages).alias("page_count"))
    return F.struct(F.lit("layout-ir/1.1").alias("schema_version"), id_.alias("document_id"), source.alias("source"), pages.alias("pages"))


def numbered_after(known: DataFrame, fresh: DataFrame, key: str, number: str, order: str) -> DataFrame:
    """Numbers for new records: for each key, in order, the free ones from the count of known records on.

    Known rows hold (key, number), null numbers being other names, and fresh ones (key, order). The numbers that could be free are
    as many as known and new records together, so that each key gets enough of them.
    """
    counts = known.groupBy(key).agg(F.count("*").alias("known"))
    wanted = fresh.groupBy(key).agg(F.count("*").alias("wanted")).join(counts, key, "left").na.fill(0, ["known"])
    range_ = F.sequence(F.col("known"), 2 * F.col("known") + F.col("wanted"))
    open_ = wanted.select(key, F.explode(range_).alias(number)).join(known.select(key, number).distinct(), [key, number], "left_anti")
    place = lambda column: F.row_number().over(Window.partitionBy(key).orderBy(column))
    return fresh.withColumn("place", place(order)).join(open_.withColumn("place", place(number)), [key, "place"]).drop("place")


def recognized(responses: DataFrame, key: str, labels: str, boxes: str, texts: str, width: Column, height: Column) -> DataFrame:
    """Blocks of provider responses whose three lists have one length: key, ord from 0, label, type, preserved, box and text.

    Pictures and tables are preserved as images and give no text; regions outside the page are left out.
    """
    same = (F.size(labels) == F.size(boxes)) & (F.size(labels) == F.size(texts))
    rows = responses.where(same).select(key, width.alias("width"), height.alias("height"), F.posexplode(F.arrays_zip(F.col(labels).alias("label"), F.col(boxes).alias("bbox"), F.col(texts).alias("text"))).alias("ord", "x"))
    b = g.Box(*(F.get("x.bbox", F.lit(i)) for i in range(4)))
    fine = rows.where(g.error_code(b, F.col("width"), F.col("height")).isNull())
    kind = F.coalesce(*(F.when(F.col("x.label") == k, F.lit(v)) for k, v in LABEL_KINDS.items()), F.lit("paragraph"))
    kept = F.col("x.label").isin(*PRESERVED)
    return fine.select(key, F.col("ord").cast("long").alias("ord"), F.col("x.label").alias("label"), kind.alias("type"), kept.alias("preserved"), F.col("x.bbox").alias("bbox"), F.when(~kept, F.col("x.text")).alias("text"))


def layers(macro: DataFrame, paragraph: DataFrame, fine: DataFrame) -> DataFrame:
    """Three layers of regions as one table."""
    named = [df.withColumn("layer", F.lit(n)) for df, n in ((macro, "macro"), (paragraph, "paragraph"), (fine, "fine"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def table_as_image(content: Column, b: g.Box, tables: Column, width: Column, height: Column) -> Column:
    """The text with its only table replaced by an image's tag, where the page has just one table region, inside it; else as it is."""
    share = lambda v, of, end: F.format_string("%d", (F.ceil if end else F.floor)(v / of * 1000).cast("long"))
    tag = F.concat(F.lit('<img src="images/bbox_'), F.concat_ws("_", share(b.x0, width, False), share(b.y0, height, False), share(b.x1, width, True), share(b.y1, height, True)), F.lit('.jpg" />'))
    one = (F.regexp_count(content, F.lit(TABLE)) == 1) & (F.regexp_count(content, F.lit(r"(?i)<table\b")) == 1) & (tables == 1)
    inside = (b.x0 >= 0) & (b.y0 >= 0) & (b.x0 < b.x1) & (b.y0 < b.y1) & (b.x1 <= width) & (b.y1 <= height)
    return F.when(one & inside, F.regexp_replace(content, F.lit(TABLE), F.concat(F.lit("\n\n"), tag, F.lit("\n\n")))).otherwise(content)


def plain_table_markup(markup: Column) -> Column:
    """Whether a table holds no tags but rows, cells with spans, and breaks."""
    return ~F.regexp_replace(markup, TABLE_TAGS, "").contains("<")


def inline_text(atoms: Column) -> Column:
    """The texts of inline spans joined in order; spans that show nothing are left out."""
    return F.array_join(F.transform(F.filter(atoms, lambda a: a["visible"]), lambda a: a["text"]), "")


def leaves(nodes: DataFrame, key: str, id_: str, parent: str) -> DataFrame:
    """Nodes of trees that are no node's parent."""
    inner = nodes.where(F.col(parent).isNotNull()).select(key, F.col(parent).alias(id_)).distinct()
    return nodes.join(inner, [key, id_], "left_anti")


def local_references(document: Column) -> Column:
    """Whether every reference in a JSON text stays in it."""
    return F.forall(F.regexp_extract_all(document, F.lit(r'"\$ref"\s*:\s*"([^"]*)"'), F.lit(1)), lambda r: r.startswith("#"))


def payload(data: Column, kind: Column) -> Column:
    """A provider's request: the file in base 64, on one line, and its kind."""
    return F.to_json(F.struct(F.regexp_replace(F.base64(data), r"\s", "").alias("file"), kind.alias("fileType")))


def fingerprint(*columns: Column) -> Column:
    """The hash of a record as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def finalized(rows: DataFrame, audit: str, *keys: str) -> DataFrame:
    """The keys and the hash of each record without its own audit column, so that writing the audit changes nothing."""
    own = [F.col(c) for c in sorted(rows.columns) if c != audit]
    return rows.select(*keys, fingerprint(*own).alias("sha256"))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based identifier (version 5) of a name in a namespace, given by its 32 digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def adapted(annotations: DataFrame, kinds: dict[str, str], namespace: str) -> DataFrame:
    """Truth units of source annotations (document, page, name, kind, text, certain): deterministic ids, mapped kinds, and uncertain ones demoted."""
    kind = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in kinds.items()))
    status = F.when(F.col("certain") & kind.isNotNull() & (F.col("text") != ""), "confirmed").otherwise("uncertain")
    name = F.concat_ws("/", F.col("document").cast("string"), F.col("page").cast("string"), F.col("name").cast("string"))
    return annotations.select(uuid5(namespace, name).alias("unit_id"), "document", "page", F.coalesce(kind, F.lit("text")).alias("kind"), status.alias("status"), "text")


def spliced(blocks: DataFrame, replacements: DataFrame, key: str, prefix: str) -> DataFrame:
    """Blocks of pages with some replaced by the blocks of a region, in their place and in the page's frame: key, id, ord from 1, and box.

    Blocks are (key, id, ord, x0, y0, x1, y1); replacements (key, target, id, ord, the box in the region's pixels, and the
    region's origin and scale). Ids of replacements get the prefix and their target's id.
    """
    names = [key, "id", "at", "sub", "x0", "y0", "x1", "y1"]
    gone = replacements.select(key, F.col("target").alias("id")).distinct()
    own = blocks.join(gone, [key, "id"], "left_anti").select(key, F.col("id").cast("string").alias("id"), F.col("ord").alias("at"), F.lit(0).cast("long").alias("sub"), "x0", "y0", "x1", "y1")
    r = replacements.join(blocks.select(key, F.col("id").alias("target"), F.col("ord").alias("at")), [key, "target"])
    name = F.concat(F.lit(prefix), F.col("target").cast("string"), F.lit("-"), F.col("id").cast("string"))
    moved = [(F.col(f"origin_{c[0]}") + F.col(c) * F.col("scale")).alias(c) for c in ("x0", "y0", "x1", "y1")]
    joined = own.select(names).unionByName(r.select(key, name.alias("id"), "at", F.col("ord").cast("long").alias("sub"), *moved).select(names))
    place = F.row_number().over(Window.partitionBy(key).orderBy("at", "sub", "id")).cast("long")
    return joined.select(key, "id", place.alias("ord"), "x0", "y0", "x1", "y1")


def provenance(blocks: DataFrame, key: str, order: str, what: str) -> DataFrame:
    """Each block's request, the box as it came, why it is there, and which earlier block of the same content it supersedes."""
    before = F.lag("id").over(Window.partitionBy(key, what).orderBy(order))
    return blocks.select(key, "id", "request_id", "raw_bbox", F.when(before.isNull(), "recognized").otherwise("replaced").alias("reason"), before.alias("supersedes"))


def unsupported_features(block_type: Column, content: Column, policy: Column, rotation: Column, mode: Column, allowed: list[str]) -> Column:
    """The codes of what a renderer doesn't support in a block, in a fixed order."""
    rules = [
        (~block_type.isin(*allowed), "BLOCK_TYPE_UNSUPPORTED"),
        ((block_type == "figure") & (content != "image"), "FIGURE_CONTENT_UNSUPPORTED"),
        ((block_type == "formula") & (content == "formula") & ((mode == "image") | (policy == "preserve_image")), "FORMULA_IMAGE_POLICY_UNSUPPORTED"),
        ((content == "image") & (mode != "preserve_as_image"), "IMAGE_RENDER_MODE_UNSUPPORTED"),
        ((content == "formula") & (block_type != "formula"), "BLOCK_CONTENT_COMBINATION_UNSUPPORTED"),
        (rotation != 0, "BLOCK_ROTATION_UNSUPPORTED"),
        (((content == "text") & (policy == "preserve_image")) | ((content == "image") & (policy == "editable")), "BLOCK_CONTENT_POLICY_UNSUPPORTED"),
        (block_type == "heading", "PLANNED_HEADING_LEVEL_UNSUPPORTED"),
    ]
    return F.array_compact(F.array(*(F.when(rule, F.lit(code)) for rule, code in rules)))


def preview(title: Column, lines: Column) -> Column:
    """A page that shows lines of text as they are."""
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    body = F.array_join(F.transform(lines, lambda t: F.concat(F.lit("<p>"), plain(t), F.lit("</p>"))), "")
    return F.concat(F.lit("<!doctype html><title>"), plain(title), F.lit("</title>"), body)

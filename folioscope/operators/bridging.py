"""Layout records as another program's model, reading streams of inline content, grids that only lay out, and reviewed formulas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import formulas, markdown
from .kernels import mapped_text

# The model's names for kinds of text blocks, kinds with a body of their own, and the level of titles.
TEXT_TYPES = {"heading": "paragraph_title", "caption": "image_caption", "footer": "footer"}
WITH_BODY, TITLE_LEVEL = ("image", "table"), 2

#: What no XML text can hold stands around formulas.
MARK = "\x01"


def bridge_faults(blocks: DataFrame, order: DataFrame, assets: DataFrame, document: str, page: str, id_: str) -> DataFrame:
    """The first fault of each document that can't be handed over; other documents have no row.

    An id stands once in a document; the reading order (document, page, id) holds each block of its page once and nothing else; the asset
    of a block (column ``asset``, null for none) exists. Blocks or orders without rows on a page count as empty.
    """
    again = blocks.groupBy(document, id_).agg(F.count("*").alias("n")).where("n > 1").select(document, F.lit(0).alias("rank"))
    listed = order.groupBy(document, page, id_).agg(F.count("*").alias("places"))
    there = blocks.groupBy(document, page, id_).agg(F.count("*").alias("n"))
    uneven = there.join(listed, [document, page, id_], "full").where("n is null or places is null or places > 1").select(document, F.lit(1).alias("rank"))
    lost = blocks.where("asset is not null").join(assets, [document, "asset"], "left_anti").select(document, F.lit(2).alias("rank"))
    codes = F.array(*map(F.lit, ("BRIDGE_DUPLICATE_SOURCE_ID", "BRIDGE_INCOMPLETE_READING_ORDER", "BRIDGE_ASSET_MISSING")))
    return again.unionByName(uneven).unionByName(lost).groupBy(document).agg(F.min("rank").alias("rank")).select(document, F.get(codes, "rank").alias("fault"))


def model_type(kind: Column, content: Column, has_grid: Column) -> Column:
    """The model's type of a block: its content decides for pictures and formulas, its kind for texts; null for other contents."""
    text = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in TEXT_TYPES.items()), F.when((kind == "table") & has_grid, F.lit("table")), F.lit("text"))
    return F.when(content == "image", "image").when(content == "formula", "equation").when(content == "text", text)


def bridged(blocks: DataFrame, order: DataFrame, document: str, page: str, id_: str, place: str, width: Column, height: Column) -> DataFrame:
    """The ledger's entries: each block at its index from 0 in the reading order of its page, with its type and its box as shares of the page.

    Blocks have kind, content, has_grid and the four sides; the order has document, page, id and place. Only for documents without a fault.
    """
    at = order.select(document, page, id_, (F.col(place) - 1).cast("long").alias("raw_index"))
    shares = [(F.col(c) / size).alias(c) for c, size in (("x0", width), ("y0", height), ("x1", width), ("y1", height))]
    return blocks.join(at, [document, page, id_]).select(document, page, id_, "raw_index", model_type(F.col("kind"), F.col("content"), F.col("has_grid")).alias("type"), *shares)


def middle(entries: DataFrame) -> DataFrame:
    """Entries as a renderer takes them: titles have a level, pictures and tables a body inside."""
    inner = F.when(F.col("type").isin(*WITH_BODY), F.concat("type", F.lit("_body")))
    return entries.withColumns({"level": F.when(F.col("type") == "paragraph_title", F.lit(TITLE_LEVEL)).cast("long"), "body": inner})


def stream(spans: Column) -> Column:
    """Inline spans (kind, content) as one text: how a text is cut doesn't count, where a formula stands does; its content is its canonical form."""
    one = lambda s: F.when(s["kind"] == "math", F.concat(F.lit(MARK), s["content"], F.lit(MARK))).otherwise(s["content"])
    return F.array_join(F.transform(spans, one), "")


def inline_order_fault(expected: Column, actual: Column) -> Column:
    """INLINE_ORDER_CHANGED where output spans aren't the source's letters and formulas in their order."""
    return F.when(stream(expected) != stream(actual), F.lit("INLINE_ORDER_CHANGED"))


def layout_grid_faults(tables: DataFrame, cells: DataFrame, references: DataFrame, key: str, table: str) -> DataFrame:
    """Tables whose grid isn't one that a layout calls for.

    Tables have rows, cols, borderless and role: ``data`` and ``unknown`` ones are judged elsewhere, ``layout`` ones have the cells of the reference
    (key, table, row, col, rowspan, colspan). Any other is the writer's wrapper: without borders, one plain cell at each place, and those
    without content only at the end, fewer than a row of them, none if there is one row. Cells are (key, table, row, col, rowspan, colspan, filled).
    """
    spot = F.col("row") * F.col("cols") + F.col("col")
    own = tables.select(key, table, "rows", "cols", "borderless", "role")
    outside = ~(F.col("row").between(0, F.col("rows") - 1) & F.col("col").between(0, F.col("cols") - 1))
    counted = own.where("role is null").join(cells, [key, table], "left").groupBy(key, table, "rows", "cols", "borderless").agg(
        F.count("row").alias("n"), F.count_distinct(F.when(F.col("row").isNotNull(), F.struct("row", "col"))).alias("places"),
        F.coalesce(F.max(outside | (F.col("rowspan") != 1) | (F.col("colspan") != 1)), F.lit(False)).alias("odd"),
        F.count_if("filled").alias("filled"), F.max(F.when(F.col("filled"), spot)).alias("last"),
    )
    size = F.col("rows") * F.col("cols")
    empty = size - F.col("last") - 1
    bad = ~F.col("borderless") | F.col("odd") | (F.col("n") != size) | (F.col("places") != size) | F.col("last").isNull() | (F.col("filled") != F.col("last") + 1) | (empty >= F.col("cols")) | ((F.col("rows") == 1) & (empty > 0))
    corners = ["row", "col", "rowspan", "colspan"]
    laid = own.where("role = 'layout'").select(key, table)
    sides = [laid.join(rows, [key, table]).groupBy(key, table, *corners).agg(F.count("*").alias(name)) for rows, name in ((cells, "seen"), (references, "wanted"))]
    changed = sides[0].join(sides[1], [key, table, *corners], "full").where("seen is distinct from wanted").select(key, table).distinct()
    return counted.where(F.coalesce(bad, F.lit(True))).select(key, table).unionByName(changed).select(key, table, F.lit("UNEXPECTED_LAYOUT_GRID").alias("fault"))


def inner(span: str) -> str:
    """A formula without its dollars."""
    return span[2:-2] if span.startswith("$$") else span[1:-1]


def replanned(text: str, previous: list[str] = (), invalid: bool = False) -> dict:
    """How a block with a reviewed text is shown: ``editable``, ``hybrid`` with its parts, or ``preserve_image`` with the reason.

    A formula that can't be written as Office math keeps its picture if exactly one formula of the block before had the same signs; otherwise the whole
    block stays a picture, as do texts that XML can't hold and texts with formula signs outside of formulas.
    """
    if invalid:
        return {"policy": "preserve_image", "reason": "INVALID_XML_TEXT_FALLBACK", "parts": []}
    if not markdown.residual_math(text):
        return {"policy": "editable", "reason": None, "parts": []}
    kept = {"policy": "preserve_image", "reason": "ACCEPTED_CANDIDATE_FORMULA_REVIEW", "parts": []}
    spans = markdown.math_spans(text)
    if not spans or markdown.residual_math(markdown.without_math(text)):
        return kept
    before = ["".join(p.split()) for p in previous]
    parts, at = [], 0
    for a, b in spans:
        source = inner(text[a:b])
        parts.append({"text": text[at:a]})
        at = b
        try:
            formulas.canonical(source)
        except formulas.FormulaError:
            if before.count("".join(source.split())) != 1:
                return kept
            parts.append({"image": source})
        else:
            parts.append({"math": source})
    return {"policy": "hybrid", "reason": None, "parts": [*parts, {"text": text[at:]}]}


def replanned_text(text: Column, previous: Column, invalid: Column) -> Column:
    """:func:`replanned` of columns, as JSON; null for null texts."""
    asked = F.to_json(F.struct(text.alias("text"), previous.alias("previous"), invalid.alias("invalid")))
    return mapped_text("string", lambda s: json.dumps(replanned(**json.loads(s)), ensure_ascii=False), F.when(text.isNotNull(), asked))


def offered_uploads(text: Column) -> Column:
    """:func:`uploads` of a column, as an array."""
    rows = "array<struct<path: string, transport: string, file_field: string, required: array<string>, deprecated: boolean>>"
    return F.from_json(mapped_text("string", lambda s: json.dumps(uploads(s)), text), rows)


class Unresolved(ValueError):
    """A reference that leads out of its document, nowhere, or back to itself."""


def pointed(document, reference) -> object:
    """What a reference such as ``#/a/b~1c`` names in its document."""
    if not isinstance(reference, str) or reference[:2] != "#/":
        raise Unresolved(reference)
    found = document
    for step in reference[2:].split("/"):
        name = step.replace("~1", "/").replace("~0", "~")
        if not isinstance(found, dict) or name not in found:
            raise Unresolved(reference)
        found = found[name]
    return found


def schema_of(document, node, open_: frozenset = frozenset()) -> dict:
    """A schema with its reference followed and the properties and required names of all its ``allOf`` parts joined; its own come first."""
    if not isinstance(node, dict):
        return {}
    if "$ref" in node:
        name, target = node["$ref"], pointed(document, node["$ref"])
        if name in open_:
            raise Unresolved(name)
        return schema_of(document, target, open_ | {name}) | {k: v for k, v in node.items() if k != "$ref"}
    parts = [schema_of(document, p, open_) for p in node.get("allOf", ())]
    if not parts:
        return node
    properties, required = dict(node.get("properties", {})), list(node.get("required", ()))
    for p in parts:
        properties |= p.get("properties", {})
        required += p.get("required", ())
    return node | {"properties": properties, "required": list(dict.fromkeys(required))}


# What uploads may look like.
TRANSPORTS, FILE_NAMES, BINARY = {"application/json": "json_base64", "multipart/form-data": "multipart"}, {"file", "image", "image_base64"}, {"binary", "byte"}


def is_binary(document, node, open_: frozenset = frozenset()) -> bool:
    """Whether a schema, or one of its alternatives, is a file's."""
    found = schema_of(document, node, open_)
    return found.get("format") in BINARY or any(is_binary(document, s, open_) for k in ("anyOf", "oneOf") for s in found.get(k, ()))


def uploads(text: str) -> list[dict]:
    """The uploads that a service's description offers, current ones first; operations with broken references and texts that don't parse offer none."""
    try:
        document = json.loads(text)
        paths = document.get("paths", {}).items()
    except (ValueError, AttributeError):
        return []
    found = []
    for path, item in paths:
        operation = item.get("post") if isinstance(item, dict) else None
        if not isinstance(operation, dict):
            continue
        try:
            body = schema_of(document, operation.get("requestBody", {}))
            for media, value in body.get("content", {}).items():
                if media in TRANSPORTS:
                    schema = schema_of(document, value.get("schema", {}))
                    fields = [n for n, p in schema.get("properties", {}).items() if n.lower() in FILE_NAMES or is_binary(document, p)]
                    if fields:
                        found.append({"path": path, "transport": TRANSPORTS[media], "file_field": fields[0], "required": schema.get("required", []), "deprecated": bool(operation.get("deprecated", False))})
        except (Unresolved, RecursionError, AttributeError, TypeError):  # TypeError and AttributeError: a part of another kind than it has to be
            continue
    return sorted(found, key=lambda x: x["deprecated"])

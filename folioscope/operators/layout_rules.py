"""Rules for what a Word document shows, over tables of its styles, sections, tables and pictures; sizes in twips, pictures in EMU."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Theme slots, and what an office program takes where a section says nothing.
SLOTS = {"Ascii": "latin", "HAnsi": "latin", "EastAsia": "ea", "Bidi": "cs"}
PAGE_WIDTH, PAGE_HEIGHT, MARGIN, LARGEST, LEAST_BODY, LEAST_EMU = 12240, 15840, 1440, 31680, 240, 12700


def body_regions(sections: DataFrame, key: str) -> DataFrame:
    """The usable width and height of each section (width, height, left, right, top, bottom, gutter, nulls being defaults), or its fault."""
    value = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    width, height, gutter = value("width", PAGE_WIDTH), value("height", PAGE_HEIGHT), value("gutter", 0)
    left, right, top, bottom = (value(n, MARGIN) for n in ("left", "right", "top", "bottom"))
    wide, high = width - left - right - gutter, height - top - bottom - gutter
    narrow = (F.least(left, right, top, bottom, gutter) < 0) | (F.least(wide, high) < LEAST_BODY)
    fault = F.when(F.greatest(width, height) > LARGEST, "UNSUPPORTED_PAGE_SIZE").when(narrow, "UNSUPPORTED_TEXT_POSITION")
    return sections.select(key, wide.cast("long").alias("usable_width"), high.cast("long").alias("usable_height"), fault.alias("fault"))


def theme_fonts(names: DataFrame, theme: DataFrame, key: str) -> DataFrame:
    """The typeface that a theme gives for a slot such as minorEastAsia, or UNSUPPORTED_FONT_MAPPING; theme is (key, part, kind, typeface)."""
    pattern = r"^(major|minor)(Ascii|HAnsi|EastAsia|Bidi)$"
    slot = F.regexp_extract("name", pattern, 2)
    kind = F.coalesce(*(F.when(slot == s, F.lit(k)) for s, k in SLOTS.items()))
    asked = names.select(key, "name", F.regexp_extract("name", pattern, 1).alias("part"), kind.alias("kind"))
    found = asked.join(theme, [key, "part", "kind"], "left")
    return found.select(key, "name", "typeface", F.when(F.col("typeface").isNull(), F.lit("UNSUPPORTED_FONT_MAPPING")).alias("fault"))


def resolved_width(raw: Column, kind: Column, available: Column) -> Column:
    """A table's width in twips: of its own, a share in fiftieths of a percent, or 0 where it is left open; null where it isn't supported."""
    fine = raw.rlike("^[0-9]+$") & F.coalesce(kind, F.lit("dxa")).isin("dxa", "pct", "auto", "nil")
    value = F.when(fine, raw.cast("long"))
    width = F.when(F.coalesce(kind, F.lit("dxa")) == "pct", F.floor(value * available / 5000)).otherwise(value)
    return F.when(fine & kind.isin("auto", "nil"), F.lit(0)).when(fine & (width <= available), width)


def table_width_faults(columns: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Tables that are wider than there is room: by their columns (key, raw, kind, available) or by a row's cells (key, row, reserved, raw, kind, available)."""
    width = resolved_width(F.col("raw"), F.col("kind"), F.col("available"))
    bad = F.max(F.when(width.isNull(), 1).otherwise(0)) == 1
    grid = columns.groupBy(key).agg((bad | (F.sum(width) > F.max("available"))).alias("bad"))
    cells = rows.groupBy(key, "row").agg((bad | (F.sum(width) + F.max("reserved") > F.max("available"))).alias("bad")).select(key, "bad")
    return grid.unionByName(cells).groupBy(key).agg(F.max("bad").alias("bad")).where("bad").select(key, F.lit("UNSUPPORTED_TABLE_WIDTH").alias("fault"))


def page_background(color: Column, themed: Column, children: Column) -> Column:
    """UNSUPPORTED_VISIBILITY_STYLE unless there is no background or a plain white one; a null color with nothing else is none."""
    there = color.isNotNull() | themed | (children > 0)
    return F.when(there & ((F.coalesce(color, F.lit("")) != "FFFFFF") | themed | (children > 0)), F.lit("UNSUPPORTED_VISIBILITY_STYLE"))


def numbered_paragraphs(paragraphs: DataFrame, chain: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """Paragraphs that get a generated number, by their own property or the nearest style that says something: key, paragraph, numbered.

    Paragraphs are (key, paragraph, style, number), chain (key, style, ancestor, distance) and numbers of styles (key, style, number); a number of 0
    switches numbering off, and a property that isn't a number counts as one.
    """
    said = chain.join(numbers.select(key, F.col("style").alias("ancestor"), F.col("number").alias("style_number")), [key, "ancestor"])
    nearest = said.groupBy(key, "style").agg(F.min_by("style_number", "distance").alias("style_number"))
    found = paragraphs.join(nearest, [key, "style"], "left")
    value = F.coalesce("number", "style_number")
    off = F.coalesce(F.coalesce("number", "style_number").try_cast("int") == 0, F.lit(False))
    return found.select(key, "paragraph", (value.isNotNull() & ~off).alias("numbered"))


def picture_structure(drawings: DataFrame, key: str) -> DataFrame:
    """The first fault of each drawing's build: (key, drawing, inline, pictures, blips, name, hidden, linked); ids must be unique in a document."""
    again = drawings.groupBy(key, "drawing").agg(F.count("*").alias("times"))
    built = (F.col("inline") == 1) & (F.col("pictures") == 1) & (F.col("blips") == 1) & (F.col("times") == 1) & F.col("name").isNotNull()
    fault = F.when(~built, "INVALID_DRAWING_CONTAINER").when(F.col("hidden"), "HIDDEN_CONTENT").when(F.col("linked"), "UNSUPPORTED_LINKED_IMAGE")
    return drawings.join(again, [key, "drawing"]).select(key, "drawing", fault.alias("fault"))


def picture_scale(cx: Column, cy: Column, pixel_width: Column, pixel_height: Column, room: Column, tallest: Column) -> Column:
    """IMAGE_DISPLAY_SCALE_INVALID where a picture is larger than its place, next to nothing, or out of shape by over 2 percent."""
    a, b = cx.cast("decimal(38,0)") * pixel_height, cy.cast("decimal(38,0)") * pixel_width
    skewed = F.abs(a - b) * 50 > F.greatest(a, b)
    bad = (cx > room) | (cy > tallest) | (F.least(cx, cy) < LEAST_EMU) | skewed | pixel_width.isNull() | pixel_height.isNull()
    return F.when(F.coalesce(bad, F.lit(True)), F.lit("IMAGE_DISPLAY_SCALE_INVALID"))


def picture_effects(crop: Column, rotation: Column, flipped: Column, shape: Column, extras: Column, allowed: list[str]) -> Column:
    """UNSUPPORTED_IMAGE_RENDERING for crops, turns, flips, shapes other than a rectangle, and any effect that isn't allowed."""
    odd = F.exists(extras, lambda e: ~e.isin(*allowed))
    return F.when((crop != 0) | (rotation != 0) | flipped | (shape != "rect") | odd, F.lit("UNSUPPORTED_IMAGE_RENDERING"))


def orphans(references: DataFrame, accepted: DataFrame, *keys: str) -> DataFrame:
    """Image references that sit in no accepted drawing."""
    return references.join(accepted.select(*keys).distinct(), list(keys), "left_anti").select(*keys, F.lit("INVALID_DRAWING_CONTAINER").alias("fault"))


def cell_widths(columns: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """The width that a cell leaves for its content: its columns' sum, or a smaller preferred one, less its margins and indents.

    Columns are (key, column, width) from 0, cells (key, cell, first, span, preferred, margins, indents).
    """
    spans = cells.withColumn("column", F.explode(F.sequence("first", F.col("first") + F.col("span") - 1)))
    found = spans.join(columns, [key, "column"], "left").groupBy(key, "cell", "preferred", "margins", "indents").agg(F.sum("width").alias("grid"), F.count("width").alias("n"), F.count("*").alias("spanned"))
    wide = F.least(F.col("grid"), F.coalesce("preferred", "grid")) - F.col("margins") - F.col("indents")
    fault = F.when((F.col("n") < F.col("spanned")) | (wide <= 0), F.lit("INVALID_TABLE_GRID"))
    return found.select(key, "cell", wide.alias("width"), fault.alias("fault"))


def wrapped_payload(elements: DataFrame, known: list[str], key: str) -> DataFrame:
    """Elements with content that lie in an element of a namespace that isn't known: elements are (key, id, path of ancestors' namespaces, payload)."""
    strange = F.exists("path", lambda n: ~n.isin(*known))
    return elements.where(F.col("payload") & strange).select(key, "id", F.lit("UNSUPPORTED_EXTENSION").alias("fault"))


def visible_faults(hidden: DataFrame, pictures: DataFrame, key: str) -> DataFrame:
    """The first fault of a document: hidden content comes before pictures."""
    a = hidden.select(key, F.lit(0).alias("rank"), F.lit("HIDDEN_CONTENT").alias("fault"))
    b = pictures.where("fault is not null").select(key, F.lit(1).alias("rank"), "fault")
    return a.unionByName(b).groupBy(key).agg(F.min(F.struct("rank", "fault"))["fault"].alias("fault"))


def bound_ranges(outputs: DataFrame, ledger: DataFrame, key: str, order: str) -> DataFrame:
    """Output elements that differ from the ledger's record at their place: container, text, or image; MISSING and EXTRA where one side ends."""
    a = outputs.select(key, order, F.col("container").alias("a_container"), F.col("text").alias("a_text"), F.col("image").alias("a_image"), F.lit(True).alias("a"))
    b = ledger.select(key, order, F.col("container").alias("b_container"), F.col("text").alias("b_text"), F.col("image").alias("b_image"), F.lit(True).alias("b"))
    code = F.when(F.col("a").isNull(), "MISSING").when(F.col("b").isNull(), "EXTRA").when(F.col("a_container") != F.col("b_container"), "CONTAINER_MISMATCH")
    code = code.when(~F.col("a_text").eqNullSafe(F.col("b_text")), "TEXT_MISMATCH").when(~F.col("a_image").eqNullSafe(F.col("b_image")), "IMAGE_MISMATCH")
    return a.join(b, [key, order], "full").select(key, order, code.alias("code")).where("code is not null")

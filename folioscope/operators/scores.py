"""Claims, matches and scores of structures against truth, and sets of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.metrics import count_if


def unique_spans(spans: DataFrame, formulas: DataFrame, key: str, share: float = 0.6) -> DataFrame:
    """Blocks whose formulas all find their place: key, n, reliable.

    Spans are (key, block, latex, the block's box) and formulas (key, latex, fx0, fy0, fx1, fy1). A span is placed if
    just one formula of its text lies in the block by more than the share; as a formula is used once, a block holds a text once.
    """
    f, b = g.Box.of("f"), g.Box.of()
    inside = (g.area(f) > 0) & (g.overlap(f, b) > share * g.area(f))
    texts = spans.groupBy(key, "block", "latex", "x0", "y0", "x1", "y1").agg(F.count("*").alias("spans"))
    near = texts.join(formulas, [key, "latex"], "left").groupBy(key, "block", "latex", "spans").agg(count_if(inside).alias("formulas"))
    fine = (F.col("spans") == 1) & (F.col("formulas") == 1)
    return near.groupBy(key, "block").agg(F.sum("spans").alias("n"), (F.min(F.when(fine, 1).otherwise(0)) == 1).alias("reliable"))


def image_claims(drawings: DataFrame, images: DataFrame, key: str, order: str, least: float = 0.25) -> DataFrame:
    """Source images with the drawing that shows them: drawings with the same marker and hash are claimed in order, each once.

    Drawings are (key, sha, order, width, height), images the same with the extent of their box. status is CLAIMED, IMAGE_DISPLAY_SCALE_INVALID
    where the drawing is smaller than the share of the box, or MISSING_OR_REPLACED_IMAGE.
    """
    place = F.row_number().over(Window.partitionBy(key, "sha").orderBy(order))
    a = images.select(key, "sha", F.col(order).alias("image"), "width", "height", place.alias("place"))
    b = drawings.select(key, "sha", F.col(order).alias("drawing"), F.col("width").alias("shown_width"), F.col("height").alias("shown_height"), place.alias("place"))
    small = (F.col("shown_width") < F.col("width") * least) | (F.col("shown_height") < F.col("height") * least)
    status = F.when(F.col("drawing").isNull(), "MISSING_OR_REPLACED_IMAGE").when(small, "IMAGE_DISPLAY_SCALE_INVALID").otherwise("CLAIMED")
    return a.join(b, [key, "sha", "place"], "left").select(key, "image", "drawing", status.alias("status"))


def edge_truth(predicted: DataFrame, expected: DataFrame, uncertain: DataFrame, key: str, *edge: str) -> DataFrame:
    """For each edge how often it is predicted, whether it is expected, and its part: matched once, excluded as uncertain, or wrong."""
    counts = predicted.groupBy(key, *edge).agg(F.count("*").alias("predicted"))
    e = expected.select(key, *edge).distinct().withColumn("expected", F.lit(True))
    u = uncertain.groupBy(key, *edge).agg(F.count("*").alias("uncertain"))
    joined = counts.join(e, [key, *edge], "full").join(u, [key, *edge], "left").na.fill(0, ["predicted", "uncertain"]).na.fill(False, ["expected"])
    matched = F.when(F.col("expected") & (F.col("predicted") > 0), 1).otherwise(0)
    excluded = F.when(F.col("expected"), 0).otherwise(F.least("predicted", "uncertain"))
    return joined.select(key, *edge, "predicted", "expected", matched.cast("long").alias("matched"), excluded.cast("long").alias("excluded"))


def formula_scores(units: DataFrame, matches: DataFrame, key: str, unit: str) -> DataFrame:
    """Formulas of a key: total, supported (with a tree), matched, unsupported, and fallback: not matched, but kept as an image.

    Units are (key, unit, tree, preserved); matches (key, unit) of those that a maximum matching pairs.
    """
    hit = units.join(matches.select(key, unit).distinct().withColumn("hit", F.lit(True)), [key, unit], "left")
    known, hits = F.col("tree").isNotNull(), F.coalesce("hit", F.lit(False))
    return hit.groupBy(key).agg(F.count("*").alias("total"), count_if(known).alias("supported"), count_if(known & hits).alias("matched"), count_if(~known).alias("unsupported"), count_if(known & ~hits & F.col("preserved")).alias("fallback"))


def reading_order(anchors: DataFrame, bound: DataFrame, key: str, order: str, anchor: str, position: str) -> DataFrame:
    """Neighbouring anchors of a reading order by whether their outputs follow each other: key, correct, incorrect, missing.

    A pair is missing where an anchor has no output or both share one, and correct if all of the first come before all of the second.
    """
    spans = bound.groupBy(key, anchor).agg(F.collect_set(position).alias("spots"))
    w = Window.partitionBy(key).orderBy(order)
    rows = anchors.join(spans, [key, anchor], "left").withColumn("after", F.lead("spots").over(w)).withColumn("next", F.lead(anchor).over(w)).where("next is not null")
    missing = F.col("spots").isNull() | F.col("after").isNull() | F.coalesce(F.arrays_overlap("spots", "after"), F.lit(False))
    correct = ~missing & (F.array_max("spots") < F.array_min("after"))
    return rows.groupBy(key).agg(count_if(correct).alias("correct"), count_if(~missing & ~correct).alias("incorrect"), count_if(missing).alias("missing"))


def page_metrics(units: DataFrame, bound: DataFrame, key: str, anchor: str) -> DataFrame:
    """How many of each page's units have an output: key, expected, matched."""
    known = bound.select(key, anchor).distinct().withColumn("hit", F.lit(1))
    return units.join(known, [key, anchor], "left").groupBy(key).agg(F.count("*").alias("expected"), F.count("hit").alias("matched"))


def union_distinct(*tables: DataFrame) -> DataFrame:
    """Rows that any of the tables has, once each."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


def distributed(options: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Options of a question in the rows that a layout shows: key, order, row, cell, inferred; questions where they don't fit are left out.

    Rows are (key, order, cells). If the cells are as many as the options each option has its cell; if the options divide by the rows, each row
    takes as many, and the cells are inferred.
    """
    n = options.groupBy(key).agg(F.count("*").alias("options"))
    w = Window.partitionBy(key)
    placed = rows.select(key, F.row_number().over(w.orderBy(order)).alias("row"), "cells", F.count("*").over(w).alias("rows"), F.sum("cells").over(w).alias("total")).join(n, key)
    exact = F.col("total") == F.col("options")
    sized = placed.where(exact | (F.col("options") % F.col("rows") == 0)).withColumn("count", F.when(exact, F.col("cells")).otherwise(F.col("options") / F.col("rows")).cast("long")).withColumn("inferred", ~exact)
    ends = sized.withColumn("last", F.sum("count").over(w.orderBy("row")))
    cells = ends.select(key, "row", "inferred", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("count") > 0, F.col("count")))).alias("cell"), (F.col("last") - F.col("count")).alias("before"))
    cells = cells.select(key, "row", "inferred", "cell", (F.col("before") + F.col("cell")).alias("place"))
    numbered = options.withColumn("place", F.row_number().over(w.orderBy(order)))
    return numbered.join(cells, [key, "place"]).select(key, order, F.col("row").cast("long").alias("row"), "cell", "inferred")


def worst(codes: DataFrame, *keys: str) -> DataFrame:
    """The worst exit code of all commands, which all run: key, commands, failed, code."""
    return codes.groupBy(*keys).agg(F.count("*").alias("commands"), count_if(F.col("code") != 0).alias("failed"), F.max("code").alias("code"))


def gate_faults(tickets: DataFrame, expected: dict[str, tuple[str, ...]], id_: str, needs: str) -> DataFrame:
    """Tickets whose needs are other than the fixed ones; tickets that are missing need nothing."""
    spark = tickets.sparkSession
    rules = spark.createDataFrame([(k, sorted(v)) for k, v in expected.items()], f"{id_} string, wanted array<string>")
    own = tickets.groupBy(id_).agg(F.array_sort(F.collect_set(needs)).alias("found"))
    found = F.coalesce("found", F.array().cast("array<string>"))
    return F.broadcast(rules).join(own, id_, "left").where(found != F.col("wanted")).select(id_, F.array_join(found, ",").alias("found"))


def missing_mentions(texts: DataFrame, ids: list[str], key: str, text: str) -> DataFrame:
    """(key, id) of the required ids, a fixed list, that a text doesn't hold."""
    listed = F.filter(F.array(*map(F.lit, ids)), lambda i: ~F.contains(F.col(text), i))
    return texts.select(key, F.explode(listed).alias("id"))


def drift(declared: DataFrame, actual: DataFrame, key: str, fields: list[tuple[str, str]]) -> DataFrame:
    """The first of the fields' codes in which an item differs from its declaration, MISSING where it isn't there; null if all agree."""
    a = declared.select(key, *(F.col(f).alias(f"declared_{f}") for f, _ in fields))
    b = actual.select(key, *(F.col(f).alias(f"actual_{f}") for f, _ in fields), F.lit(True).alias("there"))
    codes = [F.when(~F.col(f"declared_{f}").eqNullSafe(F.col(f"actual_{f}")), code) for f, code in fields]
    return a.join(b, key, "left").select(key, F.coalesce(F.when(F.col("there").isNull(), "MISSING"), *codes).alias("drift"))


def run_faults(sealed: DataFrame, present: DataFrame, key: str, sha: str) -> DataFrame:
    """Files of a run that break its seal: missing, unsealed, or changed."""
    a, b = sealed.select(key, F.col(sha).alias("sealed")), present.select(key, F.col(sha).alias("present"))
    fault = F.when(F.col("present").isNull(), "MISSING").when(F.col("sealed").isNull(), "UNSEALED").when(F.col("sealed") != F.col("present"), "CHANGED")
    return a.join(b, key, "full").select(key, fault.alias("fault")).where("fault is not null")


def integrated(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """A new snapshot: new rows replace old ones of their key and have the next version; all others stay."""
    last = old.agg(F.max(version)).first()[0] or 0
    fresh = new.drop(version).withColumn(version, F.lit(last + 1).cast(old.schema[version].dataType))
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(fresh.select(old.columns))


def compared_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that one of two inventories has more often, and which: side a or b."""
    return first.exceptAll(second).withColumn("side", F.lit("a")).unionByName(second.exceptAll(first).withColumn("side", F.lit("b")))


def adopted(blocks: DataFrame, hints: DataFrame, key: str, id_: str) -> DataFrame:
    """Kinds of blocks after hints of another engine: a hint counts if it is for a block that isn't locked and leaves its text and box as they are.

    Hints that name no block give new ones, whose ids go on from the key's greatest.
    """
    named = hints.where(F.col(id_).isNotNull()).groupBy(key, id_).agg(F.min_by(F.struct("kind", "sha", "bbox"), "kind").alias("hint"))
    fits = ~F.col("locked") & (F.col("hint.sha") == F.col("sha")) & (F.col("hint.bbox") == F.col("bbox"))
    own = blocks.join(named, [key, id_], "left").withColumn("taken", F.coalesce(fits, F.lit(False)))
    own = own.select(key, id_, F.when(F.col("taken"), F.col("hint.kind")).otherwise(F.col("kind")).alias("kind"), "taken")
    last = blocks.groupBy(key).agg(F.max(id_).alias("last"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("kind", "sha"))
    fresh = hints.where(F.col(id_).isNull()).withColumn("place", place).join(last, key, "left")
    return own.unionByName(fresh.select(key, (F.coalesce("last", F.lit(0)) + F.col("place")).alias(id_), "kind", F.lit(True).alias("taken")))


def observed_models(responses: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Facts on lists of models: how many, how many distinct, and whether the provider's expected model is among them."""
    joined = responses.join(F.broadcast(expected), key, "left")
    there = F.array_contains("ids", F.coalesce("expected", F.lit("")))
    return joined.select(key, F.size("ids").cast("long").alias("n"), F.size(F.array_distinct("ids")).cast("long").alias("n_distinct"), there.alias("expected_present"))


def observed_response(status: Column, kind: Column, body: Column) -> list[Column]:
    """Facts on a response that hold none of its content: status, kind, size, and the hashes of the body and of what describes it."""
    size = F.octet_length(body).cast("long")
    return [status.alias("status"), kind.alias("content_type"), size.alias("bytes"), F.sha2(body, 256).alias("body_sha256"), F.sha2(F.concat_ws("|", status.cast("string"), kind, size.cast("string")), 256).alias("fact_sha256")]


def provider_faults(timeout: Column, name: Column, url: Column, retries: Column, least: int = 0) -> Column:
    """The first fault of a provider's settings, or null."""
    cases = ((~F.coalesce(timeout > 0, F.lit(False)), "TIMEOUT_NOT_POSITIVE"), (F.coalesce(F.trim(name), F.lit("")) == "", "NAME_EMPTY"), (url.isNull() | url.rlike("[?#]"), "BASE_URL_HAS_QUERY"), (~F.coalesce(retries >= least, F.lit(False)), "RETRIES_TOO_FEW"))
    return F.coalesce(*(F.when(bad, F.lit(code)) for bad, code in cases))


def public_summary(rows: DataFrame, allowed: list[str], *keys: str) -> DataFrame:
    """The keys and those of the allowed columns that are there and hold numbers; nothing else leaves."""
    numbers = {f.name for f in rows.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName() == "decimal"}
    return rows.select(*keys, *(c for c in allowed if c in numbers))


def saved_once(rows: DataFrame, path: str) -> None:
    """Writes a table as JSON where nothing is yet; files appear when all tasks have ended, and evidence is never overwritten."""
    rows.write.mode("errorifexists").json(path)

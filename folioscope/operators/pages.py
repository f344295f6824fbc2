"""Classification of observed pages: conditional aggregates over runs and objects, then one cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxes import union_area
from .kernels import abnormal_text


def any_of(c: Column) -> Column:
    return F.coalesce(F.bool_or(c), F.lit(False))


def visibility(mode: Column, alpha: Column, fill: Column) -> Column:
    """How a text object shows: not at all, painted in near white, painted, or unknown."""
    return F.when((mode == 3) | (alpha == 0), "invisible").when(fill.isNull(), "unknown").when(fill >= 245, "white_paint").otherwise("painted")


def classified(pages: DataFrame, runs: DataFrame, objects: DataFrame, key: str = "page_id") -> DataFrame:
    """Page type, content state and reason codes of each page (key, status, width, height).

    Runs have text, geometry_verified and sides; objects have type (1 text, 2 path, 3 image), visibility, level and sides. A page
    without either is blank, not unknown.
    """
    text, image = F.col("type") == 1, F.col("type") == 3
    r = runs.groupBy(key).agg(F.count("*").alias("n_runs"), any_of(abnormal_text(F.col("text"))).alias("abnormal"), any_of(~F.col("geometry_verified")).alias("unverified"), F.countDistinct("text", *(F.round(c, 2) for c in ("x0", "y0", "x1", "y1"))).alias("n_distinct"))
    o = objects.groupBy(key).agg(
        F.count("*").alias("n_objects"), any_of(text).alias("has_text"), any_of(image).alias("has_image"), any_of(text & (F.col("visibility") != "invisible")).alias("shown"),
        any_of(text & (F.col("visibility") == "white_paint")).alias("white"), any_of(F.col("level") > 0).alias("nested"),
    )
    covered = union_area(objects.where(image & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).select(key, "x0", "y0", "x1", "y1"), key)
    joined = pages.join(r, key, "left").join(o, key, "left").join(covered, key, "left").na.fill(0, ["n_runs", "n_objects", "n_distinct", "union_area"]).na.fill(False, ["abnormal", "unverified", "has_text", "has_image", "shown", "white", "nested"])
    hidden = F.col("has_text") & ~F.col("shown")
    rules = [
        (F.col("status") != "OK", "unknown", "native", "NATIVE_EXTRACTION_FAILED"),
        ((F.col("n_objects") == 0) & (F.col("n_runs") == 0), "native", "blank", None),
        ((F.col("n_runs") == 0) & F.col("has_image"), "scanned", "image_only", "NO_NATIVE_TEXT"),
        (F.col("n_runs") == 0, "unknown", "image_only", "NO_NATIVE_TEXT"),
        (F.col("abnormal"), "broken_encoding", "native", "ABNORMAL_UNICODE"),
        (F.col("has_image") & hidden, "hidden_text_scan", "native", "INVISIBLE_TEXT_WITH_IMAGE"),
        (hidden, "unknown", "native", "INVISIBLE_TEXT_WITHOUT_IMAGE"),
        (F.col("white"), "unknown", "native", "WHITE_PAINT_VISIBILITY_REVIEW"),
        (F.col("unverified"), "unknown", "native", "UNVERIFIED_NATIVE_GEOMETRY"),
        (F.col("has_image"), "mixed", "native", "IMAGE_PURPOSE_UNCONFIRMED"),
    ]
    verdict = F.coalesce(*(F.when(c, F.struct(F.lit(t).alias("type"), F.lit(s).alias("state"), F.lit(x).cast("string").alias("reason"))) for c, t, s, x in rules), F.struct(F.lit("native").alias("type"), F.lit("native").alias("state"), F.lit(None).cast("string").alias("reason")))
    reasons = F.array_compact(F.array(F.col("verdict.reason"), F.when(F.col("nested"), "NESTED_FORM_GEOMETRY_REVIEW"), F.when(F.col("n_runs") != F.col("n_distinct"), "DUPLICATE_NATIVE_RUNS")))
    share = F.least(F.lit(1.0), F.col("union_area") / (F.col("width") * F.col("height")))
    return joined.withColumn("verdict", verdict).select(key, F.col("verdict.type").alias("page_type"), F.col("verdict.state").alias("content_state"), reasons.alias("reason_codes"), share.alias("image_coverage"))

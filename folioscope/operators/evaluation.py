"""Scores of recognized content against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import count_if, ratio


def durations(requests: DataFrame, *keys: str) -> DataFrame:
    """Completed requests' number and their median, least and greatest duration, and how many failed."""
    done = F.col("status") == "COMPLETE"
    time = F.when(done, F.col("duration_ms"))
    return requests.groupBy(*keys).agg(
        count_if(done).alias("n"), F.median(time).alias("median_ms"), F.min(time).alias("min_ms"), F.max(time).alias("max_ms"), count_if(~done).alias("failed")
    )


def agreements(requests: DataFrame, run: str) -> DataFrame:
    """Pairs of requests of a run that may be compared: repeats in a format, formats of a provider, or providers on the same input."""
    a = requests.select(run, *(F.col(c).alias(f"a_{c}") for c in ("request_id", "provider", "variant", "repeat_index")))
    b = requests.select(run, *(F.col(c).alias(f"b_{c}") for c in ("request_id", "provider", "variant", "repeat_index")))
    pair = a.join(b, run).where("a_request_id < b_request_id")
    same_format, same_repeat = F.col("a_variant") == F.col("b_variant"), F.col("a_repeat_index") == F.col("b_repeat_index")
    own = F.when(same_format, "within_format_repeat").otherwise("cross_format")
    kind = F.when(F.col("a_provider") == F.col("b_provider"), own).when(same_format & same_repeat, "inter_provider_agreement")
    return pair.select(run, F.col("a_request_id").alias("a"), F.col("b_request_id").alias("b"), kind.alias("kind")).where("kind is not null")


def detection(truth: DataFrame, found: DataFrame, matches: DataFrame, *keys: str) -> DataFrame:
    """True and false positives, misses, precision over all found ones, recall, and the matches' mean and median overlap."""
    t, p = truth.groupBy(*keys).agg(F.count("*").alias("gt_count")), found.groupBy(*keys).agg(F.count("*").alias("prediction_count"))
    m = matches.groupBy(*keys).agg(F.count("*").alias("tp"), F.avg("iou").alias("iou_mean"), F.median("iou").alias("iou_median"))
    joined = t.join(p, list(keys), "full").join(m, list(keys), "left").na.fill(0, ["gt_count", "prediction_count", "tp"])
    counts = {"fp": F.col("prediction_count") - F.col("tp"), "fn": F.col("gt_count") - F.col("tp"), "precision": ratio(F.col("tp"), F.col("prediction_count")), "recall": ratio(F.col("tp"), F.col("gt_count"))}
    return joined.withColumns(counts)


def order_counts(pairs: DataFrame, *keys: str) -> DataFrame:
    """Correct, incorrect and missing pairs, and the share that could be judged."""
    each = {s: count_if(F.col("status") == s) for s in ("correct", "incorrect", "missing")}
    found = pairs.groupBy(*keys).agg(*(c.alias(s) for s, c in each.items()))
    return found.withColumn("coverage", ratio(F.col("correct") + F.col("incorrect"), F.col("correct") + F.col("incorrect") + F.col("missing")))


def edge_scores(found: DataFrame, expected: DataFrame, *keys: str) -> DataFrame:
    """How many of the expected edges are found, an edge counting as often as both sides have it."""
    a, b = (df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((found, "found"), (expected, "expected")))
    joined = a.join(b, list(keys), "full").na.fill(0, ["found", "expected"])
    return joined.withColumn("matched", F.least("found", "expected"))


def table_tiling(cells: DataFrame, *keys: str) -> DataFrame:
    """Whether a table's cells, with their spans, cover its grid exactly: rows, cols, and ok."""
    spots = cells.select(*keys, F.explode(F.sequence("row", F.col("row") + F.col("rowspan") - 1)).alias("r"), "col", "colspan")
    spots = spots.select(*keys, "r", F.explode(F.sequence("col", F.col("col") + F.col("colspan") - 1)).alias("c"))
    found = spots.groupBy(*keys).agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"), F.count("*").alias("covered"), F.countDistinct("r", "c").alias("places"))
    return found.withColumn("ok", (F.col("covered") == F.col("places")) & (F.col("covered") == F.col("rows") * F.col("cols")))


def necessary_content(units: DataFrame, *keys: str) -> DataFrame:
    """Units that are correct or preserved and not failed, over those that must be there."""
    kept = (F.col("correct") | F.col("preserved")) & ~F.col("failed")
    found = units.groupBy(*keys).agg(F.count("*").alias("necessary"), count_if(kept).alias("retained"))
    return found.withColumn("value", ratio(F.col("retained"), F.col("necessary")))


def document_status(metrics: DataFrame, *keys: str) -> DataFrame:
    """A document's status from its metrics': the worst, and NOT_SCORED if none is scored."""
    rank = F.when(F.col("status") == "FAIL", 3).when(F.col("status") == "REVIEW_REQUIRED", 2).when(F.col("status") == "PASS", 1).otherwise(0)
    worst = metrics.groupBy(*keys).agg(F.max(rank).alias("rank"))
    names = F.array(*map(F.lit, ("NOT_SCORED", "PASS", "REVIEW_REQUIRED", "FAIL")))
    return worst.select(*keys, F.get(names, F.col("rank")).alias("status"))


def status_counts(rows: DataFrame, statuses: list[str], column: str = "status") -> DataFrame:
    """How many rows have each of the given statuses, zeros too."""
    listed = rows.sparkSession.createDataFrame([(s,) for s in statuses], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return listed.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def observed_error(http: Column, code: Column) -> Column:
    """Whether an answer is an error by its HTTP status, or by its own code where HTTP says that all is well."""
    return F.coalesce(http.between(400, 599) | (http.between(200, 299) & F.coalesce(code != 0, F.lit(False))), F.lit(False))


def micro_average(rows: DataFrame, distance: str, length: str, *keys: str) -> DataFrame:
    """Summed distances over summed reference lengths."""
    found = rows.groupBy(*keys).agg(F.sum(distance).cast("long").alias("distance"), F.sum(length).cast("long").alias("reference_chars"))
    return found.withColumn("value", ratio(F.col("distance"), F.col("reference_chars")))


def best_two(rows: DataFrame, score: str, tie: str, *keys: str) -> DataFrame:
    """The best and second-best score of each group."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie)))
    return ranked.where("place <= 2")

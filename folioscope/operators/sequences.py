"""Operators on ordered rows: islands, row groups, last-seen values, neighbours, positional joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, position: str, *keys: str) -> DataFrame:
    """Runs of consecutive positions: island number from 1, its first and last position and n."""
    order = Window.partitionBy(*keys).orderBy(position)
    marked = rows.withColumn("offset_in_run", F.col(position) - F.row_number().over(order))
    runs = marked.groupBy(*keys, "offset_in_run").agg(F.min(position).alias("first_id"), F.max(position).alias("last_id"), F.count("*").alias("n"))
    return runs.withColumn("island", F.row_number().over(Window.partitionBy(*keys).orderBy("first_id")).cast("long")).drop("offset_in_run")


def shared_rows(boxes: DataFrame, *keys: str) -> DataFrame:
    """Row numbers from 1 by id: a box starts a row if it doesn't overlap its predecessor along y."""
    order = Window.partitionBy(*keys).orderBy("box_id")
    above = F.lag("y1").over(order)
    apart = above.isNull() | (F.least(F.col("y1"), above) - F.greatest(F.col("y0"), F.lag("y0").over(order)) <= 0)
    starts = boxes.withColumn("start", F.when(apart, 1).otherwise(0))
    return starts.withColumn("row_no", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def last_seen(rows: DataFrame, value: Column, name: str, order: str, *keys: str) -> DataFrame:
    """Adds the last value at or before each row, nulls left out."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(window))


def neighbours(rows: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """Adds the values of the rows before and after."""
    window = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumns({f"prev_{value}": F.lag(value).over(window), f"next_{value}": F.lead(value).over(window)})


def zipped(left: DataFrame, right: DataFrame, left_order: str, right_order: str, *keys: str) -> DataFrame:
    """Joins the n-th row of a group to the n-th of the other side's, only where both have as many: ordinal n from 1.

    Columns of the sides are prefixed a_ and b_.
    """
    def side(df: DataFrame, order: str, prefix: str) -> DataFrame:
        own = Window.partitionBy(*keys)
        named = df.withColumns({"ordinal": F.row_number().over(own.orderBy(order)).cast("long"), "total": F.count("*").over(own)})
        return named.select(*keys, "ordinal", "total", *(F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys))

    return side(left, left_order, "a_").join(side(right, right_order, "b_"), [*keys, "ordinal", "total"]).drop("total")


def reading_pairs(bound: DataFrame, anchor: str, position: str, *keys: str) -> DataFrame:
    """For consecutive anchors whether the first ends before the second begins: correct, incorrect, or missing if either has no position."""
    spans = bound.groupBy(*keys, anchor).agg(F.min(position).alias("low"), F.max(position).alias("high"))
    order = Window.partitionBy(*keys).orderBy(anchor)
    paired = spans.withColumns({"next_anchor": F.lead(anchor).over(order), "next_low": F.lead("low").over(order)}).where(F.col("next_anchor").isNotNull())
    missing = F.col("high").isNull() | F.col("next_low").isNull()
    return paired.withColumn("status", F.when(missing, "missing").when(F.col("high") < F.col("next_low"), "correct").otherwise("incorrect"))


def windows_of(parts: Column, most: int) -> Column:
    """All stretches of 1 to ``most`` neighbouring texts, joined by spaces, with their start; ``parts`` should be a plain column."""
    starts = F.sequence(F.lit(0), F.size(parts) - 1)
    each = lambda n: F.transform(F.filter(starts, lambda i: i + n <= F.size(parts)), lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice(parts, i + 1, F.lit(n)), " ").alias("text")))
    return F.when(F.size(parts) > 0, F.concat(*(each(n) for n in range(1, most + 1))))


def split_at(parts: DataFrame, offset: int, key: str, order: str, text: str) -> DataFrame:
    """Splits ordered texts at a character offset of the whole: each part's piece before and after it."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.greatest(F.lit(0), F.least(F.length(text), F.lit(offset) - before)).cast("int")
    return parts.withColumn("cut", cut).withColumns({"head": F.expr(f"substring({text}, 1, cut)"), "tail": F.expr(f"substring({text}, cut + 1)")}).drop("cut")

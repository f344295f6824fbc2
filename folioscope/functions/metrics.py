"""Quality metrics with explicit denominators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_if(c: Column) -> Column:
    """How often a condition holds; 0 for no rows."""
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def status(eligible: Column, scored: Column, correct: Column) -> Column:
    """Nothing scored, something wrong, something left unscored, or all well: the first that holds."""
    return F.when(scored == 0, "NOT_SCORED").when(correct < scored, "FAIL").when(scored < eligible, "REVIEW_REQUIRED").otherwise("PASS")


def metric(eligible: Column, scored: Column, correct: Column, uncertain: Column) -> list[Column]:
    """Aggregate columns of a metric over rows with these flags; the value is null where nothing is eligible."""
    e, s, c = (count_if(x) for x in (eligible, eligible & scored, eligible & scored & correct))
    return [
        e.alias("eligible_count"), s.alias("scored_count"), c.alias("correct_count"), count_if(uncertain).alias("uncertain_count"),
        (e - s).alias("not_scored_count"), F.try_divide(c.cast("double"), e.cast("double")).alias("value"), status(e, s, c).alias("status"),
    ]


def ratio(part: Column, whole: Column) -> Column:
    """A share as a double, null without a denominator."""
    return F.try_divide(part.cast("double"), whole.cast("double"))

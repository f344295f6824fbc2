"""Constraints on dataset manifests, ledgers, catalogues and seals: each returns the rows that break the rule, or counts by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def leaks(items: DataFrame, key: str, group: str) -> DataFrame:
    """Keys whose items are in several groups: n items in so many groups."""
    found = items.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(group).alias("groups"))
    return found.where("groups > 1")


def shortfalls(items: DataFrame, key: str, targets: DataFrame) -> DataFrame:
    """How far each target group is from its target, groups without items too."""
    counts = items.groupBy(key).agg(F.count("*").alias("n"))
    joined = targets.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return joined.withColumn("shortfall", F.greatest(F.lit(0).cast("long"), F.col("target") - F.col("n")))


def contiguous(rows: DataFrame, position: str, *keys: str) -> DataFrame:
    """Whether a group's distinct positions form a range."""
    return rows.groupBy(*keys).agg((F.max(position) - F.min(position) + 1 == F.countDistinct(position)).alias("ok"))


def dangling(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose key isn't known; null keys refer to nothing and are left out."""
    return rows.where(F.col(key).isNotNull()).join(known.select(F.col(known_key).alias("known_key")), F.col(key) == F.col("known_key"), "left_anti")


def allowed(rows: DataFrame, rules: DataFrame, *keys: str) -> DataFrame:
    """Rows that the rules list."""
    return rows.join(rules.select(*keys).distinct(), list(keys), "left_semi")


def compared(declared: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Where a declaration and what is there differ, by key: missing, unexpected or changed."""
    a, b = declared.select(key, F.col(value).alias("declared")), actual.select(key, F.col(value).alias("actual"))
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), key, "full")
    state = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "unexpected").when(~F.col("declared").eqNullSafe(F.col("actual")), "changed")
    return both.select(key, state.alias("diff")).where("diff is not null")


def three_ways(first: DataFrame, second: DataFrame, third: DataFrame, key: str, value: str) -> DataFrame:
    """Where three catalogues differ, by key: a missing entry, or fields that aren't the same in all."""
    a, b, c = (df.select(key, F.col(value).alias(f"v{i}"), F.lit(1).alias(f"in{i}")) for i, df in enumerate((first, second, third)))
    joined = a.join(b, key, "full").join(c, key, "full")
    gone = F.concat_ws(",", *(F.when(F.col(f"in{i}").isNull(), name) for i, name in enumerate(("first", "second", "third"))))
    same = F.col("v0").eqNullSafe(F.col("v1")) & F.col("v1").eqNullSafe(F.col("v2"))
    return joined.select(key, F.when(gone != "", F.concat(F.lit("missing:"), gone)).when(~same, "fields").alias("diff")).where("diff is not null")


def unequal_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, each as often as it is in excess."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def first_of(rows: DataFrame, value: str, name: str, order: str, *keys: str) -> DataFrame:
    """Adds the first row's value of each group: equal contents share one path."""
    return rows.withColumn(name, F.first(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def kept_once(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """The first row of each group, and how many there are."""
    own = Window.partitionBy(*keys)
    numbered = rows.withColumns({"place": F.row_number().over(own.orderBy(order)), "dup_count": F.count("*").over(own)})
    return numbered.where("place = 1").drop("place")


def matrix(spark, providers: list[tuple[str, int]], variants: tuple[str, str]) -> DataFrame:
    """The schedule of requests: each provider's repeats, with the first format alternating from repeat to repeat."""
    rows = spark.createDataFrame([(p, n, i) for i, (p, n) in enumerate(providers)], "provider string, repeats int, place int")
    rows = rows.select("provider", "place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats").cast("long"))).alias("repeat_index"))
    order = F.when(F.col("repeat_index") % 2 == 1, F.array(*map(F.lit, variants))).otherwise(F.array(*map(F.lit, variants[::-1])))
    rows = rows.select("provider", "place", "repeat_index", F.posexplode(order).alias("turn", "variant"))
    ordinal = F.row_number().over(Window.orderBy("place", "repeat_index", "turn")).cast("long")
    return rows.select(ordinal.alias("ordinal"), "provider", "variant", "repeat_index")


def protocol_prefix(requests: DataFrame, schedule: DataFrame, order: str, *fields: str) -> DataFrame:
    """Requests that aren't what the schedule has at their place; requests are numbered within one run."""
    numbered = requests.withColumn("ordinal", F.row_number().over(Window.partitionBy("run_id").orderBy(order)).cast("long"))
    names = {f: f"due_{f}" for f in fields}
    due = schedule.select("ordinal", *(F.col(f).alias(n) for f, n in names.items()))
    same = F.lit(True)
    for f, n in names.items():
        same = same & F.col(f).eqNullSafe(F.col(n))
    return numbered.join(due, "ordinal", "left").where(~same)


def at_most_once(requests: DataFrame, order: str, *keys: str) -> DataFrame:
    """The requests that are admitted: the first of each key; the others are repeats of one that was started."""
    return requests.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("attempt = 1").drop("attempt")


def reused(requests: DataFrame, cache: DataFrame, order: str, *keys: str) -> DataFrame:
    """Adds the first completed response to the same input, or null."""
    first = Window.partitionBy(*keys).orderBy(order)
    done = cache.where("status = 'COMPLETE'").withColumn("place", F.row_number().over(first)).where("place = 1")
    return requests.join(done.select(*keys, F.col(order).alias("response_id")), list(keys), "left")


def merged_events(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All old events and the new ones whose id isn't there yet."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def unreferenced(files: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Files that nothing refers to."""
    return files.join(references.select(key).distinct(), key, "left_anti")


def rolled_up(statuses: Column) -> Column:
    """One status for all if they agree, else PARTIAL."""
    return F.when(F.countDistinct(statuses) == 1, F.min(statuses)).otherwise("PARTIAL")

"""Associations between blocks, ledgers and relations, and scores that weigh evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boxes as box_ops


def beside(left: DataFrame, right: DataFrame, key: str, gap: float) -> DataFrame:
    """Labels to the left of figures: the gap is in [0, gap) and the label's middle is level with the figure; only where both have one partner."""
    near = lambda a, b: (b.x0 - a.x1 >= 0) & (b.x0 - a.x1 < gap) & ((a.y0 + a.y1) / 2 >= b.y0) & ((a.y0 + a.y1) / 2 <= b.y1)
    return _mutual(box_ops.pairs(left, right, key, near), key)


def below(upper: DataFrame, lower: DataFrame, key: str, gap: float) -> DataFrame:
    """Captions under figures: the step down is in [0, gap) and the caption's middle lies within the figure; only where both have one partner."""
    near = lambda a, b: (b.y0 - a.y1 >= 0) & (b.y0 - a.y1 < gap) & ((b.x0 + b.x1) / 2 >= a.x0) & ((b.x0 + b.x1) / 2 <= a.x1)
    return _mutual(box_ops.pairs(upper, lower, key, near), key)


def _mutual(found: DataFrame, key: str) -> DataFrame:
    count = lambda side: F.count("*").over(Window.partitionBy(key, f"{side}_box_id"))
    return found.withColumns({"n_a": count("a"), "n_b": count("b")}).where("n_a = 1 and n_b = 1").drop("n_a", "n_b")


def looked_up(rows: DataFrame, names: DataFrame, number: str, target: str, *keys: str) -> DataFrame:
    """Resolves numbers to targets: the target if there is just one, and the state unique, ambiguous or missing."""
    counted = names.groupBy(*keys, number).agg(F.count("*").alias("n"), F.min(target).alias("found"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("unique")
    joined = rows.join(counted, [*keys, number], "left")
    return joined.withColumns({"state": state, target: F.when(F.col("n") == 1, F.col("found"))}).drop("n", "found")


def ledger_map(outputs: DataFrame, sources: DataFrame, *keys: str) -> DataFrame:
    """How output leaves and source entries meet on their keys: bound, extra, lost, or doubled on either side."""
    a, b = (df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((outputs, "n_out"), (sources, "n_src")))
    joined = a.join(b, list(keys), "full")
    state = F.when(F.col("n_out").isNull(), "lost").when(F.col("n_src").isNull(), "extra").when((F.col("n_out") > 1) | (F.col("n_src") > 1), "doubled").otherwise("bound")
    return joined.select(*keys, state.alias("state"))


def texts_inside(parts: DataFrame, areas: DataFrame, key: str, share: float, text: str) -> DataFrame:
    """The texts of parts that lie in an area to at least a share, joined by line ends in reading order."""
    found = box_ops.owned(parts, areas, key, share)
    ordered = F.array_sort(F.collect_list(F.struct("a_y0", "a_x0", "a_box_id", F.col(f"a_{text}").alias("t"))))
    return found.groupBy(key, F.col("b_box_id").alias("area")).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("content"))


def relation_faults(edges: DataFrame, blocks: DataFrame, rules: dict[str, tuple[str, str]], key: str) -> DataFrame:
    """Edges (key, src, dst, type) whose ends don't exist, or aren't of the kinds that their type asks for."""
    kinds = lambda end: blocks.select(key, F.col("id").alias(end), F.col("kind").alias(f"{end}_kind"))
    joined = edges.join(kinds("src"), [key, "src"], "left").join(kinds("dst"), [key, "dst"], "left")
    due = F.create_map(*(F.lit(x) for t, (a, b) in rules.items() for x in (t, f"{a}>{b}")))
    gone = F.col("src_kind").isNull() | F.col("dst_kind").isNull()
    wrong = ~F.concat(F.col("src_kind"), F.lit(">"), F.col("dst_kind")).eqNullSafe(F.try_element_at(due, F.col("type")))
    return joined.withColumn("fault", F.when(gone, "DANGLING").when(wrong, "ROLE")).where("fault is not null").select(key, "src", "dst", "type", "fault")


def weighted(parts: dict[str, float], penalties: dict[str, float]) -> Column:
    """A score from named columns in [0, 1]: weights times evidence, less penalties; evidence that is null counts nothing."""
    out = F.lit(0.0)
    for name, weight in parts.items():
        out = out + weight * F.coalesce(F.col(name), F.lit(0.0))
    for name, weight in penalties.items():
        out = out - weight * F.coalesce(F.col(name), F.lit(0.0))
    return out


def banded(score: Column, automatic: float, review: float) -> Column:
    """What to do with a score: take it, look at it, or leave it."""
    return F.when(score >= automatic, "AUTO").when(score >= review, "REVIEW").otherwise("REJECT")


def rendered(blocks: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Blocks in reading order with a style by their kind; the order holds an array of ids."""
    places = order.select(key, F.posexplode("reading_order").alias("pos", "id"))
    style = F.when(F.col("kind") == "title", "Heading1").when(F.col("kind") == "visual", "Figure").otherwise("Normal")
    return places.join(blocks, [key, "id"]).select(key, (F.col("pos") + 1).cast("long").alias("ordinal"), "id", style.alias("style"))


def accepted(before: DataFrame, after: DataFrame, key: str, content: str, id_: str) -> DataFrame:
    """Whether a candidate page keeps the original's blocks: REORDERED, CONTENT_CHANGED, or null for each page."""
    a = before.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", id_, content))).alias("was"))
    b = after.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", id_, content))).alias("now"))
    ids = lambda c: F.transform(c, lambda x: x[id_])
    code = F.when(~ids(F.col("was")).eqNullSafe(ids(F.col("now"))), "READING_ORDER_CHANGED").when(~F.col("was").eqNullSafe(F.col("now")), "CONTENT_PRESERVATION_FAILED")
    return a.join(b, key, "full").select(key, code.alias("code"))


def bookmark_faults(marks: DataFrame, key: str) -> DataFrame:
    """Bookmarks (key, id, kind start or end, pos) that aren't paired once each, in order."""
    found = marks.groupBy(key, "id").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in ("start", "end")), F.min(F.when(F.col("kind") == "start", F.col("pos"))).alias("first"), F.max(F.when(F.col("kind") == "end", F.col("pos"))).alias("last"))
    return found.where("n_start <> 1 or n_end <> 1 or first > last").select(key, "id")


def forbidden(rows: DataFrame, rules: DataFrame, text: str) -> DataFrame:
    """Rows whose text holds a term that a rule (group, term) forbids for their group, whatever the case."""
    return rows.join(rules, "group").where(F.contains(F.lower(text), F.lower("term")))


def display_width(width: Column, height: Column) -> Column:
    """The width at which a picture of a natural size is shown: within the column and the page."""
    return F.least(F.lit(505.28), width, 650.0 * width / height)

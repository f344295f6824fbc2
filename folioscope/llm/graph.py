"""Connected components of a link table, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, HOT_SHARE, spread, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label, the least node that links lead to, for all nodes of the links; null ends are left out.

    Each round every node takes the least label among its neighbours, and then its label's label, so that long chains
    halve; a round is written to the shared folder and the next reads it. Labels of nodes with very many links, and of those that very many
    nodes point to, come to the rows that ask for them. Only counts reach the driver.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    pairs = written(ends.union(ends.select("b", "a")), "links")
    labels = written(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    most = max(HOT_ROWS, pairs.count() // HOT_SHARE)
    hubs = written(pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("b").alias("node")), "hubs")
    nodes = labels.count()
    few = not hubs.limit(1).count()
    to_hubs = pairs.join(F.broadcast(hubs), F.col("b") == F.col("node"), "left_semi")
    others = pairs if few else pairs.join(F.broadcast(hubs), F.col("b") == F.col("node"), "left_anti")
    while True:
        own = labels.select(F.col("node").alias("b"), "label")
        seen = others.join(own, "b").select("a", "label")
        if not few:
            seen = seen.union(to_hubs.join(F.broadcast(own.join(F.broadcast(hubs), F.col("b") == F.col("node"), "left_semi")), "b").select("a", "label"))
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        far = met.join(up, "label", "left") if nodes <= HOT_ROWS else spread(written(met, "met"), up, ["label"], "left")
        now = written(far.select("node", F.least("label", "up").alias("label"), "old"), "labels")
        labels = now.select("node", "label")
        if not now.where("label <> old").limit(1).count():
            return labels

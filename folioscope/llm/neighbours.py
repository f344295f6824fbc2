"""Nearest neighbours by inner product: a forest of random-projection trees, one priority queue over all of it, exact reranking.

The trees are fitted on a bounded sample of the rows; every row is put into a leaf of each. A search takes the leaves
of all trees in the order of their least margin, which one queue keeps, until they hold a given share of the rows. How large a
share a wanted recall takes is measured on the table itself: for a bounded number of queries the exact neighbours among all rows
tell how far the queue had to go. Rows and queries then meet in the leaves, by a shuffle on the leaf, and the rows there are
candidates and are ranked by their exact inner products. For the largest inner product to be
nearness, vectors get one component more that makes all norms equal; queries get 0 there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, written

#: Rows that trees are fitted on, and rows of a leaf among them; queries that the share is measured on.
SAMPLE, LEAF, PROBES = 16_384, 128, 64

#: Rows of a leaf that are gathered together; products that are held at a time; results that a task gathers before it sorts them out.
GROUP, PRODUCTS, RESULTS = 1 << 15, 1 << 22, 1 << 20


@dataclass
class Tree:
    """Planes of the inner nodes; a child is an inner node's number or, below 0, minus one less a leaf's number."""

    planes: np.ndarray  # nodes x dimension
    cuts: np.ndarray
    children: np.ndarray  # nodes x 2: below the cut, at or above it
    sizes: np.ndarray  # rows of the sample in each leaf

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.full(len(rows), 0 if len(self.planes) else -1, np.int64)
        own = np.flatnonzero(out >= 0)
        while len(own):
            node = out[own]
            for k in np.unique(node):
                at = own[node == k]
                out[at] = self.children[k][(rows[at] @ self.planes[k] >= self.cuts[k]).astype(np.int64)]
            own = own[out[own] >= 0]
        return -1 - out


def grow(rows: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> Tree:
    """A tree whose nodes split their rows at the median of the projection on the difference of two of them."""
    planes, cuts, children, sizes = [], [], [], []

    def add(own: np.ndarray) -> int:
        if len(own) > leaf:
            for _ in range(4):
                a, b = rows[rng.choice(own, 2, replace=False)]
                if (length := np.linalg.norm(a - b)) > 0:
                    plane = (a - b) / length
                    on = rows[own] @ plane
                    cut = np.median(on)
                    below = on < cut
                    if below.any():
                        k = len(planes)
                        planes.append(plane)
                        cuts.append(cut)
                        children.append([0, 0])
                        children[k] = [add(own[below]), add(own[~below])]
                        return k
        sizes.append(len(own))
        return -len(sizes)

    add(np.arange(len(rows)))
    n = rows.shape[1]
    return Tree(np.array(planes).reshape(-1, n), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), np.array(sizes))


class Forest:
    """Trees that are searched together, for vectors of one size."""

    def __init__(self, rows: np.ndarray, trees: int, seed: int, norm: float):
        rng = np.random.default_rng(seed)
        self.norm = norm
        own = self.extended(rows)
        self.trees = [grow(own, rng) for _ in range(trees)]
        self.first = np.cumsum([0, *(len(t.sizes) for t in self.trees)])  # numbers of leaves over all trees
        self.counts = np.zeros(int(self.first[-1]), np.int64)  # of all rows
        self.wanted = 0.0

    def extended(self, rows: np.ndarray) -> np.ndarray:
        """The rows with the component that gives them all the same norm."""
        rest = np.maximum(self.norm**2 - np.einsum("ij,ij->i", rows, rows), 0)
        return np.concatenate([rows, np.sqrt(rest)[:, None]], axis=1)

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The number of each row's leaf in each tree."""
        own = self.extended(rows)
        return np.stack([t.leaves(own) + a for t, a in zip(self.trees, self.first, strict=False)], axis=1)

    def search(self, queries: np.ndarray, wanted: float) -> Iterator[list[int]]:
        """For each query the leaves that it reaches first, until they hold so many rows, counted by tree.

        One queue holds the nodes of all trees by the least margin on the way to them, which for the side that the query is
        on is positive.
        """
        own = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
        margins = [own @ t.planes.T - t.cuts for t in self.trees]
        links = [t.children.tolist() for t in self.trees]
        first, counts = self.first.tolist(), self.counts.tolist()
        for q in range(len(own)):
            margin = [m[q].tolist() for m in margins]
            queue = [(-np.inf, t, 0 if links[t] else -1) for t in range(len(self.trees))]
            heapq.heapify(queue)
            found: list[int] = []
            total = 0
            while queue and total < wanted:
                cost, t, node = heapq.heappop(queue)
                if node < 0:
                    leaf = first[t] - 1 - node
                    if counts[leaf]:
                        found.append(leaf)
                        total += counts[leaf]
                    continue
                m = margin[t][node]
                below, above = links[t][node]
                heapq.heappush(queue, (max(cost, m), t, below))
                heapq.heappush(queue, (max(cost, -m), t, above))
            yield found

    def measure(self, queries: np.ndarray, leaves: list[np.ndarray], recall: float) -> None:
        """Sets how many rows a search has to reach so that it meets the wanted part of the queries' true neighbours, given by their leaves."""
        far: list[float] = []
        for order, own in zip(self.search(queries, np.inf), leaves, strict=True):
            sums = np.full(len(self.counts), np.inf)
            sums[order] = np.cumsum(self.counts[order])
            far += sums[own].min(axis=1).tolist()
        far.sort()
        # the row that is met last lies in a leaf that the search has to take
        self.wanted = far[min(len(far) - 1, int(np.ceil(recall * len(far))) - 1)] if far else float(self.counts.sum())

    @property
    def share(self) -> float:
        """The part of all rows, counted by tree, that a search reaches."""
        return self.wanted / max(1, int(self.counts.sum()))


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector, size) of rows whose vector is neither null nor zero and holds neither nulls nor non-finite numbers."""
    own = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("key").isNotNull() & F.col("vector").isNotNull() & fine & F.exists("vector", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors as rows; all have one size."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def packs(cells: np.ndarray, keys: np.ndarray, rows: np.ndarray, kind: int) -> pa.RecordBatch:
    """Keys and vectors by cell, packed."""
    order = np.argsort(cells, kind="stable")
    cells, keys, rows = cells[order], keys[order], rows[order]
    heads = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
    tails = [*heads[1:], len(cells)][: len(heads)]
    columns = [pa.array(cells[heads]), pa.array([kind] * len(heads), pa.int32()), pa.array([rows.shape[1]] * len(heads), pa.int32()), pa.array([keys[a:b].tobytes() for a, b in zip(heads, tails, strict=True)], pa.binary()), pa.array([rows[a:b].tobytes() for a, b in zip(heads, tails, strict=True)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["cell", "kind", "size", "keys", "held"])


PACKS = "cell long, kind int, size int, keys binary, held binary"


class Index:
    """A forest for each size of vectors, the rows that are searched, and the number of groups of each leaf."""

    def __init__(self, forests: dict[int, Forest], number: str):
        self.forests, self.number = forests, number
        #: Leaves are numbered over all sizes; a cell is a leaf and one of its groups.
        self.first = dict(zip(forests, np.cumsum([0, *(len(f.counts) for f in forests.values())]).tolist(), strict=False))

    def groups(self, size: int) -> np.ndarray:
        return np.maximum(1, -(-self.forests[size].counts // GROUP))


def by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, keys and vectors of the rows, for each size of vectors."""
    sizes = pa.compute.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        own = batch.filter(pa.array(sizes == size))
        yield int(size), own.column("key").to_numpy(), matrix(own.column("vector"))


def survey(held, k: int):
    """A mapInArrow function: how many rows each leaf holds, and each probe's nearest rows, exactly, with their leaves."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, probes = held.value
        counts = {size: np.zeros(len(f.counts), np.int64) for size, f in index.forests.items()}
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            for size, keys, rows in by_size(batch):
                leaves = index.forests[size].leaves(rows)
                counts[size] += np.bincount(leaves.ravel(), minlength=len(counts[size]))
                for i, key, vector in probes.get(size, ()):
                    exact = (rows * vector).sum(axis=1)
                    at = np.flatnonzero(keys != key)
                    at = at[np.lexsort((keys[at], -exact[at]))[:k]]
                    near = best.get(i, []) + [(-exact[j], int(keys[j]), leaves[j].tolist()) for j in at]
                    best[i] = sorted(near)[:k]
        rows = [(size, leaf, n, None, None, None, None) for size, own in counts.items() for leaf, n in enumerate(own.tolist()) if n]
        rows += [(None, None, None, i, key, -score, leaves) for i, near in best.items() for score, key, leaves in near]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["size", "leaf", "n", "probe", "vec_id", "score", "leaves"])

    return look


SURVEY = "size int, leaf int, n long, probe int, vec_id long, score double, leaves array<int>"


def row_packs(held):
    """A mapInArrow function: the rows in the cells of their leaves, one of each tree."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            for size, keys, rows in by_size(batch):
                leaves = index.forests[size].leaves(rows)
                groups = index.groups(size)
                spot = (keys.view("<u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                narrow = rows.astype(index.number)
                for t in range(leaves.shape[1]):
                    own = leaves[:, t]
                    salt = (spot % groups[own].astype(np.uint64)).astype(np.int64)
                    yield packs((own + index.first[size] << 24) | salt, keys, narrow, 0)

    return put


def query_packs(held):
    """A mapInArrow function: the queries in all cells of the leaves that they reach."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            for size, keys, rows in by_size(batch):
                forest, groups = index.forests[size], index.groups(size)
                narrow = rows.astype(index.number)
                for lo in range(0, len(rows), 512):
                    found = list(forest.search(rows[lo : lo + 512], forest.wanted))
                    leaf = np.array([x for own in found for x in own], np.int64)
                    who = np.repeat(np.arange(lo, lo + len(found)), [len(x) for x in found])
                    n = groups[leaf] if len(leaf) else leaf
                    salt = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    leaf, who = np.repeat(leaf, n), np.repeat(who, n)
                    yield packs((leaf + index.first[size] << 24) | salt, keys[who], narrow[who], 1)

    return put


def ranked(held, most: int):
    """A mapInArrow function over cells, rows before queries: each query's best rows of the partition's cells, in double precision."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value.number
        cell, parts, rows, keys = None, [], None, None
        results: list[tuple[np.ndarray, ...]] = []

        def best() -> pa.RecordBatch:
            who, key, score = (np.concatenate([r[i] for r in results]) for i in range(3))
            results.clear()
            order = np.lexsort((key, -score, who))
            who, key, score = who[order], key[order], score[order]
            fresh = np.ones(len(who), bool)  # a row that several trees lead to counts once
            fresh[1:] = (who[1:] != who[:-1]) | (key[1:] != key[:-1]) | (score[1:] != score[:-1])
            who, key, score = who[fresh], key[fresh], score[fresh]
            heads = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
            own = np.arange(len(who)) - np.repeat(heads, np.diff(np.append(heads, len(who)))) < most
            return pa.RecordBatch.from_arrays([pa.array(who[own]), pa.array(key[own]), pa.array(score[own])], ["number", "vec_id", "score"])

        for batch in batches:
            for c, kind, size, ids, held_ in zip(*(batch.column(x).to_pylist() for x in ("cell", "kind", "size", "keys", "held")), strict=True):
                if c != cell:
                    cell, parts, rows = c, [], None
                ids, vectors = np.frombuffer(ids, "<i8"), np.frombuffer(held_, number).reshape(-1, size)
                if not kind:
                    parts.append((ids, vectors))
                    continue
                if not parts and rows is None:
                    continue
                if rows is None:
                    keys, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.float64)
                    short = rows.astype(np.float32)
                    norm = float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max()))
                    parts = []
                step = max(1, PRODUCTS // len(rows))
                for lo in range(0, len(ids), step):
                    asked = vectors[lo : lo + step].astype(np.float64)
                    at = np.repeat(np.arange(len(asked)), len(rows)), np.tile(np.arange(len(rows)), len(asked))
                    if len(rows) > most:
                        # single precision sorts out what is surely too far
                        near = asked.astype(np.float32) @ short.T
                        least = np.partition(near, len(rows) - most, axis=1)[:, len(rows) - most]
                        at = np.nonzero(near >= (least - (size + 16) * 2.4e-7 * norm * np.linalg.norm(asked, axis=1))[:, None])
                    score = (rows[at[1]] * asked[at[0]]).sum(axis=1)
                    results.append((ids[lo : lo + step][at[0]], keys[at[1]], score))
                    if sum(len(r[0]) for r in results) >= RESULTS:
                        yield best()
        if results:
            yield best()

    return rank


def index_of(rows: DataFrame, queries: DataFrame, k: int, trees: int, recall: float, seed: int, number: str) -> Index | None:
    """The forests for rows and queries (key, vector), with the leaves' counts and the measured share; None without rows."""
    spark = rows.sparkSession
    norms = F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    sizes = {r["size"]: (r["n"], r["most"]) for r in rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"), norms.alias("most")).orderBy("size").collect()}
    if not sizes:
        return None
    per = max(LEAF, SAMPLE // len(sizes))
    spot = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30))
    share = F.coalesce(*(F.when(F.size("vector") == size, F.lit(min(1.0, 2 * per / n))) for size, (n, _) in sizes.items()))
    place = F.row_number().over(Window.partitionBy(F.size("vector")).orderBy(spot, "key"))
    some = rows.where(spot <= share * (1 << 30)).withColumn("place", place).where(F.col("place") <= per).orderBy("place").select("vector").collect()
    vectors = {size: np.array([r["vector"] for r in some if len(r["vector"]) == size]).reshape(-1, size) for size in sizes}
    forests = {size: Forest(vectors[size], trees, seed, float(np.sqrt(sizes[size][1]))) for size in sizes}
    index = Index(forests, number)
    probes: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for i, r in enumerate(queries.orderBy(F.xxhash64("key", F.lit("probe")), "key").limit(PROBES).collect()):
        if len(r["vector"]) in sizes:
            probes.setdefault(len(r["vector"]), []).append((i, r["key"], np.array(r["vector"])))
    seen = written(rows.mapInArrow(survey(spark.sparkContext.broadcast((index, probes)), k), SURVEY), "survey")
    for r in seen.where("n is not null").groupBy("size", "leaf").agg(F.sum("n").alias("n")).collect():
        forests[r["size"]].counts[r["leaf"]] = r["n"]
    order = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))
    near: dict[int, list[list[int]]] = {}
    for r in seen.where("probe is not null").withColumn("place", order).where(F.col("place") <= k).collect():
        near.setdefault(r["probe"], []).append(r["leaves"])
    for size, own in probes.items():
        met = [(vector, np.array(near[i])) for i, _, vector in own if i in near]
        if met:
            forests[size].measure(np.array([v for v, _ in met]), [x for _, x in met], recall)
    for size, forest in forests.items():
        if size not in probes or not forest.wanted:
            forest.wanted = float(forest.counts.sum())
    return Index(forests, number)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, trees: int = 8, recall: float = 0.95, key: str = "vec_id", vector: str = "embedding", seed: int = 11) -> DataFrame:
    """Each query's ``k`` nearest rows found: query_id, rank from 1, vec_id and score, the inner product in double precision.

    Queries aren't their own neighbours; ties go to the smaller key. Vectors that are null, zero, or hold
    null or non-finite components take no part, nor do rows without a key; an inner product needs two vectors of one size, so that each
    size is searched by itself. Rows that repeat a key with the same vector count once, with another one each. An empty table gives none; other columns aren't read.

    The trees are fitted on SAMPLE rows, those with the least hashes of their keys. The number of rows that a query reaches
    is the least that finds the part ``recall`` of the true neighbours of PROBES queries. Of rows that share a vector only the k + 1 least keys
    can be among anyone's neighbours, and queries that share one are searched for once; so neither gathers in a task.
    """
    spark = rows.sparkSession
    number = "<f4" if rows.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    least = F.row_number().over(Window.partitionBy("vector").orderBy("key"))
    pool = written(usable(rows, key, vector).distinct().withColumn("least", least).where(F.col("least") <= k + 1).drop("least"), "pool")
    asked = written(usable(queries, key, vector).distinct(), "asked")
    index = index_of(pool, asked, k, trees, recall, seed, number)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = spark.sparkContext.broadcast(index)
    distinct = written(asked.select("vector").distinct().withColumn("key", F.monotonically_increasing_id()), "distinct")
    fitting = distinct.where(F.size("vector").isin(list(index.forests)))
    cells = pool.mapInArrow(row_packs(held), PACKS).union(fitting.select("key", "vector").mapInArrow(query_packs(held), PACKS))
    found = cells.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(ranked(held, k + 1), "number long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    best = found.distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    listed = best.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    numbered = written(spread(asked, distinct.select("vector", F.col("key").alias("number")), ["vector"]).select("key", "number"), "numbered")
    own = spread(numbered, listed, ["number"])
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("key")), F.lit(1), F.lit(k))
    out = own.select(F.col("key").alias("query_id"), F.posexplode(others).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))

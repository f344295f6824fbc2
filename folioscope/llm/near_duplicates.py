"""Near-duplicate documents by bottom-k sketches from one hash function.

Hashes give all shingles one order, and a document's sketch is the least k of its set in that order. For a Jaccard
similarity of at least t, k = n - ceil(t n) + 1 of n shingles makes it certain that two linked documents share a
retained value, so inverted lists of retained values meet every link. Shingles that more than a few documents hold come last
in the order: a passage that many documents share is then retained only by documents that are little else.
The lists of all other values are short by that definition, and their pairs are generated. The documents
that share a frequent retained value form families, which are joined in blocks of bounded size.

Estimates from the union of two sketches sort out most pairs; all others are verified on the full sets.
Exact copies of a set are one class: lists hold classes, by 64 bits of their sets' signatures, and the copy with the
least key represents it afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, settle, sieved, spread, written
from .graph import components
from .shingles import FACTOR, mixed, shingle_set, signature

#: Bytes of text held at a time, and classes that a task remembers.
BLOCK, MOST_SEEN = 8 << 20, 1 << 17

#: Bits of the number of buckets that hashes are dealt to, at least, and the bytes of text whose hashes a bucket holds on average where more are needed.
BITS, BUCKET_BYTES = 11, 32 << 20

#: A value is frequent if more documents than this hold it, and more than all documents' values over the second number.
FREQUENT, FREQUENT_SHARE = 16, 1 << 22

#: Members in a block of a family, the least and the most, the blocks of a family for which it grows between, and the bytes of their sets.
LEAST_MEMBERS, MOST_MEMBERS, BLOCKS, MOST_BYTES = 128, 2048, 16, 16 << 20

#: Values of a sketch that estimates, and the chance that it misses a link.
SKETCH, MISS = 64, 1e-12


@lru_cache(maxsize=1 << 16)
def least_common(k: int, t: float) -> int:
    """The fewest values that the sketches of a link share: fewer have a chance below MISS (a binomial's lower tail)."""
    total, p = 0.0, (1 - t) ** k
    for c in range(k + 1):
        total += p
        if total > MISS:
            return c
        p *= (k - c) / (c + 1) * t / (1 - t)
    return k


def needed(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """The least intersection of linked sets of n and m values."""
    return -(-percent * (n + m) // (100 + percent))


def retained(n: int, percent: int) -> int:
    """How many of n values a sketch retains."""
    return n - -(-percent * n // 100) + 1


def bits_for(size: int) -> int:
    """The bits of the number of buckets for so many bytes of text."""
    return max(BITS, int(-(-size // BUCKET_BYTES) - 1).bit_length() if size else 0)


def identity(mark: bytes) -> int:
    """64 bits of a signature; should two sets share them, both stand for each other's pairs until the full sets are compared."""
    return int.from_bytes(mark[:8], "little", signed=True)


class Facts:
    """A mapInArrow function: for each document its set's size and signature, and for each block the values it holds."""

    schema = "key long, n long, signature binary, bucket int, held binary"

    def __init__(self, width: int, bits: int):
        self.width, self.bits = width, bits

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BLOCK):
            sets = [shingle_set(t, self.width) for t in batch.column("text").to_pylist()]
            marks = [signature(s) for s in sets]
            # documents are dealt to the buckets too; their places keep copies apart
            yield self.rows(batch.column("key"), [len(s) for s in sets], marks, [(int.from_bytes(x[:4], "little") + i) % (1 << self.bits) for i, x in enumerate(marks)], [None] * len(sets))
            values = np.sort(np.concatenate(sets) >> np.uint64(32 - self.bits))  # the bucket's bits and 32 more
            if len(values):
                bucket = (values >> np.uint64(32)).astype(np.int64)
                heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                held = [x.astype("<u4").tobytes() for x in np.split(values, heads[1:])]
                yield self.rows(pa.nulls(len(held), pa.int64()), [None] * len(held), [None] * len(held), bucket[heads], held)

    @staticmethod
    def rows(key, n, sig, bucket, held) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([key, pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(bucket, pa.int32()), pa.array(held, pa.binary())], ["key", "n", "signature", "bucket", "held"])


def split(batches: Iterator[pa.RecordBatch], found: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """Gathers a partition's byte strings by their bucket, and gives the rows without one."""
    for batch in batches:
        mine = pa.compute.is_valid(batch.column("held"))
        own = batch.filter(mine)
        for k, x in zip(own.column("bucket").to_pylist(), own.column("held").to_pylist(), strict=True):
            found.setdefault(k, []).append(x)
        if own.num_rows < batch.num_rows:
            yield batch.filter(pa.compute.invert(mine))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents' rows as they are, and the values, by bucket and 32 bits, that more than FREQUENT documents hold."""
    names = ["key", "n", "signature", "value"]
    found: dict[int, list[bytes]] = {}
    for rest in split(batches, found):
        yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in names[:3]), pa.nulls(rest.num_rows, pa.int64())], names)
    while found:
        bucket, parts = found.popitem()
        values, counts = np.unique(np.frombuffer(b"".join(parts), "<u4"), return_counts=True)
        own = counts > FREQUENT
        value = (np.int64(bucket) << np.int64(32)) | values[own].astype(np.int64)
        n = len(value)
        if n:
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(counts[own].astype(np.int64)), pa.nulls(n, pa.binary()), pa.array(value)], names)
    settle()


POSTING = np.dtype([("value", "<u8"), ("key", "<i8"), ("n", "<i4"), ("rest", "<i4")])


def packed(rows: np.ndarray) -> bytes:
    """Postings column by column, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in POSTING.names), 1)


def unpacked(held: bytes) -> np.ndarray:
    raw = zstandard.decompress(held)
    rows, at = np.empty(len(raw) // POSTING.itemsize, POSTING), 0
    for c in POSTING.names:
        size = POSTING[c].itemsize * len(rows)
        rows[c] = np.frombuffer(raw[at : at + size], POSTING[c])
        at += size
    return rows


def postings(held, width: int, percent: int, bits: int):
    """A mapInArrow function: retained values of a task's classes, infrequent ones in buckets, others one by one.

    ``rest`` is how many of the set's values don't come before the retained one, which bounds the intersection.
    """

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(held.value, "<u8")
        seen: set[bytes] = set()
        for batch in by_bytes(batches, "text", BLOCK):
            plain, hot = [], []
            if len(seen) >= MOST_SEEN:
                seen.clear()
            for text in batch.column("text").to_pylist():
                own = shingle_set(text, width)
                mark = signature(own)
                if not len(own) or mark in seen:
                    continue
                seen.add(mark)
                key, short = identity(mark), own >> np.uint64(32 - bits)
                if len(frequent):
                    at = np.searchsorted(frequent, short)
                    common = frequent[np.minimum(at, len(frequent) - 1)] == short
                else:
                    common = np.zeros(len(own), bool)
                n, k = len(own), retained(len(own), percent)
                rare = own[~common][:k]
                last = own[common][: k - len(rare)]
                rows = np.empty(len(rare) + len(last), POSTING)
                rows["value"], rows["key"], rows["n"] = np.concatenate([rare, last]), key, n
                # values before a retained one: those retained before it
                rows["rest"] = n - np.arange(len(rows))
                plain.append(rows[: len(rare)])
                # no partner of a fitting size could hold enough of the rest: the value links nothing
                few = needed(n, -(-percent * n // 100), percent)
                hot.append(rows[len(rare) :][rows["rest"][len(rare) :] >= few])
            rows = np.concatenate(plain) if plain else np.empty(0, POSTING)
            # retained values are least ones, so their hashes are spread anew
            own = (mixed(rows["value"] ^ FACTOR) >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            rows, own = rows[order], own[order]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
            parts = [(int(own[x]), packed(rows[x:y])) for x, y in zip(heads, [*heads[1:], len(own)][: len(heads)], strict=True)]
            hot = np.concatenate(hot) if hot else np.empty(0, POSTING)
            m, n = len(parts), len(hot)
            bucket = pa.array([*(i for i, _ in parts), *(mixed(hot["value"] ^ hot["key"].view("<u8")) >> np.uint64(64 - bits)).tolist()], pa.int32())
            strings = pa.array([*(x for _, x in parts), *[None] * n], pa.binary())
            own = [pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(hot[c].view("<i8") if c == "value" else hot[c])]) for c in ("value", "key")]
            yield pa.RecordBatch.from_arrays([bucket, strings, *own], ["bucket", "held", "value", "key"])

    return retain


POSTINGS = "bucket int, held binary, value long, key long"
MEETINGS = "a long, b long, value long, key long"


def list_pairs(percent: int):
    """A mapInArrow function: the pairs of each inverted list that sizes and ranks leave possible; other rows as they are."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "value", "key"]
        found: dict[int, list[bytes]] = {}
        for rest in split(batches, found):
            yield pa.RecordBatch.from_arrays([*[pa.nulls(rest.num_rows, pa.int64())] * 2, rest.column("value"), rest.column("key")], names)
        while found:
            _, parts = found.popitem()
            rows = np.concatenate([unpacked(x) for x in parts])
            rows = rows[np.lexsort((rows["key"], rows["value"]))]
            again = np.zeros(len(rows), bool)  # copies that other tasks met
            again[1:] = (rows["value"][1:] == rows["value"][:-1]) & (rows["key"][1:] == rows["key"][:-1])
            rows = rows[~again]
            values = rows["value"]
            heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            sizes = np.diff(np.append(heads, len(rows)))
            left, right = [], []
            for size in np.unique(sizes[sizes > 1]):
                first = heads[sizes == size]
                for i, j in combinations(range(int(size)), 2):
                    left.append(first + i)
                    right.append(first + j)
            if not left:
                continue
            a, b = rows[np.concatenate(left)], rows[np.concatenate(right)]
            n, m = a["n"].astype(np.int64), b["n"].astype(np.int64)
            fits = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(a["rest"], b["rest"]) >= needed(n, m, percent)) & (a["key"] != b["key"])
            keys = np.stack([np.minimum(a["key"], b["key"])[fits], np.maximum(a["key"], b["key"])[fits]])
            keys = np.unique(keys, axis=1) if keys.size else keys
            for i in range(0, keys.shape[1], 10_000):
                own = keys[:, i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1]), *[pa.nulls(own.shape[1], pa.int64())] * 2], names)
        settle()

    return pair


def filtered(keep):
    """A mapInArrow function: the pairs whose two value arrays pass a test."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("a", "b", "left", "right"))
            out = [(a, b) for a, b, x, y in zip(*columns, strict=True) if keep(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
        settle()

    return check


def may_link(percent: int):
    """Whether two sketches share as many values as a link's would."""

    def test(x: np.ndarray, y: np.ndarray) -> bool:
        k = min(len(x), len(y))
        return len(np.intersect1d(x[:k], y[:k], assume_unique=True)) >= least_common(k, percent / 100)

    return test


def links(percent: int):
    """Whether two full sets are similar enough."""

    def test(x: np.ndarray, y: np.ndarray) -> bool:
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common)

    return test


def tested(pairs: DataFrame, values: DataFrame, keep) -> DataFrame:
    """The pairs whose values, joined to both ends, pass the test."""
    left, right = (values.select(F.col("key").alias(end), F.col("held").alias(name)) for end, name in (("a", "left"), ("b", "right")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(filtered(keep), "a long, b long")


def block_links(percent: int):
    """An applyInArrow function: links that join the members of one or two blocks of a family, as a spanning forest.

    Members that links already join aren't compared again. For each member the values of its sketch first count the others'
    shared ones by the block's inverted lists; if any other may be a link, all values count the exact intersections.
    """
    t = percent / 100

    def lists(values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Members by value, and for each member its values' places."""
        owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
        flat = np.concatenate(values)
        order = np.argsort(flat, kind="stable")
        heads = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
        number = np.empty(len(flat), np.int64)
        number[order] = np.cumsum(heads) - 1
        starts = np.append(np.flatnonzero(heads), len(flat))
        return owner[order], starts, np.split(number, np.cumsum([len(v) for v in values])[:-1])

    def shared(index, member: int, size: int) -> np.ndarray:
        owner, starts, own = index
        lo, hi = starts[own[member]], starts[own[member] + 1]
        n = hi - lo
        at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        return np.bincount(owner[at], minlength=size)

    def join(group: pa.Table) -> pa.Table:
        keys, blocks = group.column("key").to_numpy(), group.column("block").to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in group.column("held").to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        order = np.argsort(n, kind="stable")
        keys, blocks, sets, n = keys[order], blocks[order], [sets[i] for i in order], n[order]
        sketches, full = lists([s[:SKETCH] for s in sets]), lists(sets)
        root = np.arange(len(sets))  # of each member's part of the forest
        out, two = [], blocks.min() != blocks.max()
        few = np.array([least_common(min(SKETCH, int(x)), t) for x in n])
        for u in range(len(sets)):
            may = (shared(sketches, u, len(sets)) >= np.minimum(few, few[u])) & (root != root[u]) & (100 * np.minimum(n, n[u]) >= percent * np.maximum(n, n[u]))
            if two:
                may &= blocks != blocks[u]
            if not may.any():
                continue
            common = shared(full, u, len(sets))
            for v in np.flatnonzero(may & (100 * common >= percent * (n + n[u] - common))):
                if root[v] != root[u]:
                    out.append((int(keys[u]), int(keys[v])))
                    root[root == root[v]] = root[u]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return join


def sets_of(width: int):
    """A mapInArrow function: each document's set and sketch as bytes, where its signature is the one asked for."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BLOCK):
            rows = [(k, s.astype("<u8").tobytes()) for k, t, g in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "signature")), strict=True) if signature(s := shingle_set(t, width)) == g]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary()), pa.array([x[1][: 8 * SKETCH] for x in rows], pa.binary())], ["key", "held", "sketch"])

    return make


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Links documents whose shingle sets have a Jaccard similarity of at least ``percent`` and finds their components.

    Returns a row per document: the key, n_shingles, component_id (the least key that links lead to, its own included) and
    kept (whether that is its own). Null, empty and blank texts have no shingles and no links. Keys are 64-bit and
    name documents: rows that repeat one are in one component, whatever their texts. Rows without a key have no component
    and aren't kept. An empty table gives none. Other columns aren't read.

    Links between different texts are all met; equal sets are linked by their class and not by pairs. In a family only
    as many links are written as join its members.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    bits = bits_for(own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    dealt = own.mapInArrow(Facts(width, bits), Facts.schema).repartition("bucket")
    table = written(dealt.mapInArrow(counted, "key long, n long, signature binary, value long"), "facts")
    facts = table.where("value is null").select("key", "n", "signature")
    classes = written(facts.where("key is not null and n > 0").groupBy("n", "signature").agg(F.min("key").alias("rep")), "classes")
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # more documents than a bounded part of all values hold each of these, so their number is bounded
    found = table.where(F.col("value").isNotNull() & (F.col("n") > total // FREQUENT_SHARE)).select("value").toArrow()
    held = spark.sparkContext.broadcast(np.sort(found.column(0).to_numpy().astype("<u8")).tobytes())

    dealt = own.where("key is not null").select("text").mapInArrow(postings(held, width, percent, bits), POSTINGS).repartition("bucket")
    lists = written(dealt.mapInArrow(list_pairs(percent), MEETINGS), "lists")
    met = lists.where("a is not null").select("a", "b").distinct()

    hot = lists.where("value is not null").select("value", "key")
    hubs = hot.groupBy("value").agg(F.min("key").alias("hub"), F.max("key").alias("last")).where("hub < last").select("value", "hub")
    groups = components(spread(hot, hubs, ["value"]).select(F.col("hub").alias("a"), F.col("key").alias("b")))

    # from here on the copy with the least key stands for its class
    ids = met.select(F.col("a").alias("id")).union(met.select("b")).union(groups.select("node")).distinct()
    chosen = written(classes.withColumn("id", numbered(F.col("signature"))).join(ids, "id").select("id", F.col("rep").alias("key"), "signature"), "chosen")
    named = lambda table, end: table.join(chosen.select(F.col("id").alias(end), F.col("key").alias(f"{end}_key")), end)
    pairs = written(named(named(met, "a"), "b").select(F.col("a_key").alias("a"), F.col("b_key").alias("b")).where("a <> b"), "pairs")
    families = written(groups.join(chosen, groups["node"] == chosen["id"]).select("key", F.col("label").alias("family")), "families")
    likely = sieved(own, F.col("key"), chosen.select("key"), "asked").where("asked").select("key", "text")
    sets = written(likely.join(chosen, "key").select("key", "text", "signature").mapInArrow(sets_of(width), "key long, held binary, sketch binary"), "sets")

    likely = tested(pairs, sets.select("key", F.col("sketch").alias("held")), may_link(percent))
    between = tested(likely, sets, links(percent))

    measured = families.join(sets.select("key", F.octet_length("held").alias("size")), "key")
    parts = lambda most: F.ceil(F.count("*") / F.lit(most)).cast("int")
    heavy = F.ceil(F.sum("size") / F.lit(MOST_BYTES)).cast("int")
    sizes = measured.groupBy("family").agg(F.greatest(heavy, F.least(parts(LEAST_MEMBERS), F.greatest(F.lit(BLOCKS), parts(MOST_MEMBERS)))).alias("blocks"))
    members = spread(families, sizes, ["family"]).join(sets.drop("sketch"), "key").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.withColumn("other", other).select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "key", "block", "held")
    inside = dealt.groupBy("family", "low", "high").applyInArrow(block_links(percent), "a long, b long")

    classed = written(spread(facts.where("key is not null"), classes, ["n", "signature"], "left").select("key", "n", "rep"), "classed")
    by_key = written(classed.groupBy("key").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")), "keys")
    # rows that repeat a key link their classes, and the key to them
    several = by_key.where("rep < last").select("key", F.col("rep").alias("first"))
    own_links = classed.join(several, "key").where("rep is not null").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    joined = components(between.union(inside).union(own_links))
    labels = joined.select(F.col("node").alias("rep"), "label")
    labelled = spread(by_key.select("key", "rep"), labels, ["rep"], "left").select("key", F.coalesce("label", "rep", "key").alias("component_id"))
    out = facts.join(labelled, "key", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("key"), F.lit(False)).alias("kept"))


def numbered(mark: F.Column) -> F.Column:
    """The number that :func:`identity` gives a signature."""
    byte = lambda i: F.conv(F.hex(F.substring(mark, i, 1)), 16, 10).cast("long")
    out = byte(1)
    for i in range(2, 9):
        out = out.bitwiseOR(F.shiftleft(byte(i), 8 * (i - 1)))
    return out


def representatives(docs: DataFrame, percent: int = 85, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are kept, one of each component, with all their columns.

    Rows without a key all stay; of rows that repeat a kept key one stays. The rows that go are found by a shuffled join with
    their keys; a sieve keeps most others out of it.
    """
    found = written(near_duplicates(docs, percent, width, key, text).select(F.col(key).alias("key"), "kept"), "kept")
    gone = written(found.where("key is not null and not kept").select("key").distinct(), "gone")
    again = written(found.where("kept").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "again")

    def without(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows whose keys aren't among these, and those whose keys are."""
        marked = sieved(rows, F.col(key).cast("long"), keys, "sieve_of_keys")
        maybe = marked.where("sieve_of_keys").drop("sieve_of_keys")
        on = F.col(key).cast("long") == F.col("sieved_key")
        own = keys.select(F.col("key").alias("sieved_key"))
        return marked.where("not sieve_of_keys").drop("sieve_of_keys").union(maybe.join(own, on, "left_anti")), maybe.join(own, on, "left_semi")

    left, _ = without(docs, gone)
    if not again.limit(1).count():
        return left
    once, more = without(left, again)
    return once.union(more.dropDuplicates([key]))

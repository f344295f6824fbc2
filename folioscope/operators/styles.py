"""Properties that styles inherit: the chain of each style from itself to its root, and what holds at its end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

#: Rows that a block of documents has at least, if there are as many.
BLOCK = 1 << 15


def coded(*columns: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values of columns, one column after another, in order of their first place; nulls have a number, too."""
    found = pa.concat_arrays([x for c in columns for x in c.chunks]).dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def by_documents(rows: DataFrame, key: str, schema: StructType, kernel: Callable[[pa.Table], Iterator[pa.Table]]) -> DataFrame:
    """Runs a kernel on blocks of whole documents: many small ones at once, so that a document costs no call of its own.

    Documents are brought together by one shuffle and sorted by all columns. Only the document that a block's end cuts is held over, so memory is
    bounded by the largest document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < BLOCK:
                continue
            keys, _ = coded(pa.chunked_array([batch.column(0)]))
            last = int(np.searchsorted(keys, keys[-1]))
            if not last:  # the document may go on
                continue
            for table in kernel(pa.Table.from_batches([*held[:-1], batch.slice(0, last)])):
                yield from table.to_batches(max_chunksize=BLOCK)
            held, n = [batch.slice(last)], batch.num_rows - last
        if held:
            for table in kernel(pa.Table.from_batches(held)):
                yield from table.to_batches(max_chunksize=BLOCK)

    others = [c for c in rows.columns if c != key]
    return rows.select(key, *others).repartition(key).sortWithinPartitions(key, *others).mapInArrow(run, schema)


class Named:
    """The names that a block of documents has in two columns, as numbers from 0 to n - 1: at (of each row), and linked, which has the number
    of the other name for each row of pairs."""

    def __init__(self, rows: pa.Table, key: str, one: str, other: str):
        document, self.keys = coded(rows[key])
        names, self.names = coded(rows[one], rows[other])
        self.width = len(self.names) + 1
        ids = np.tile(document, 2) * self.width + names
        self.pairs = np.flatnonzero(rows[other].is_valid().to_numpy())
        count = rows.num_rows
        self.ids, place = np.unique(np.concatenate([ids[:count], ids[count:][self.pairs]]), return_inverse=True)
        self.n, self.at, self.linked = len(self.ids), place[:count], place[count:]

    def key_of(self, numbers: np.ndarray) -> pa.Array:
        return self.keys.take(pa.array(self.ids[numbers] // self.width))

    def name_of(self, numbers: np.ndarray) -> pa.Array:
        return self.names.take(pa.array(self.ids[numbers] % self.width))


class Trees(Named):
    """The styles of a block of documents: above (the one that each builds on; n: none), own (whether a style has a row)."""

    def __init__(self, rows: pa.Table, key: str):
        super().__init__(rows, key, "style", "based_on")
        self.above = np.full(self.n + 1, self.n)
        self.above[self.at[self.pairs]] = self.linked
        self.own = np.zeros(self.n, bool)
        self.own[self.at] = True

    def ends(self, to: np.ndarray) -> np.ndarray:
        """Where steps lead after at least n of them, which double each time; to[n] is n."""
        for _ in range(self.n.bit_length()):
            further = to[to]
            if (further == to).all():
                break
            to = further
        return to

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """Of each style the sum of weights over the rows that its chain has."""
        total, to = np.append(weight, 0).astype(np.int64), self.above.copy()
        last = self.ends(to)
        ring = np.unique(last[last < self.n])  # styles that come to build on themselves
        if len(ring):
            least, step = np.arange(self.n + 1), self.above
            for _ in range(self.n.bit_length()):
                least, step = np.minimum(least, least[step]), step[step]
            around = np.zeros(self.n + 1, np.int64)
            np.add.at(around, least[ring], total[ring])
            total[ring] += around[least[ring]]
            to[ring] = self.n
        while (to < self.n).any():
            total, to = total + total[to], to[to]
        return total[:-1]


def named(parents: DataFrame, *more: str) -> DataFrame:
    """Rows with a style's name; the one above has the same type."""
    kind = parents.schema["style"].dataType
    return parents.where("style is not null").select(*(c for c in parents.columns if c not in ("style", "based_on", *more)), "style", F.col("based_on").cast(kind).alias("based_on"), *more)


def chains(parents: DataFrame, key: str) -> DataFrame:
    """Each style with all it builds on: key, style, ancestor, distance (0: itself).

    Parents are rows (key, style, based_on). A chain ends at a style without a parent or where it would come back to a style that it
    holds; that style is its last row again. The rows grow with the square of a chain's length: ``inherited`` and ``hidden`` need none of them.
    """

    def walk(rows: pa.Table) -> Iterator[pa.Table]:
        trees = Trees(rows, key)
        length = trees.sums(np.ones(trees.n))
        start = np.flatnonzero(trees.own)
        at, distance = start, 0
        while len(start):
            yield pa.Table.from_arrays([trees.key_of(start), trees.name_of(start), trees.name_of(at), pa.array(np.full(len(start), distance, np.int32))], names)
            distance += 1
            on = length[start] > distance
            start, at = start[on], trees.above[at[on]]

    kind = parents.schema["style"].dataType
    schema = StructType([parents.schema[key], StructField("style", kind), StructField("ancestor", kind), StructField("distance", IntegerType())])
    names = schema.names
    return by_documents(named(parents.select(key, "style", "based_on")), key, schema, walk)


def inherited(parents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What each style ends up with: key, style, and each column's value in the nearest style of its chain that sets it, null if none does.

    Parents are rows (key, style, based_on) with these columns, null where a style doesn't set one. Time is in proportion to the styles (and
    the logarithm of the longest chain), whatever their chains hold together.
    """

    def run(rows: pa.Table) -> Iterator[pa.Table]:
        trees = Trees(rows, key)
        own = np.flatnonzero(trees.own)
        found = [trees.key_of(own), trees.name_of(own)]
        for c in columns:
            there = np.flatnonzero(rows[c].is_valid().to_numpy())
            row = np.full(trees.n + 1, -1)
            row[trees.at[there]] = there
            got = row[trees.ends(np.where(row >= 0, np.arange(trees.n + 1), trees.above))[own]]
            found.append(rows[c].take(pa.array(got, mask=got < 0)))
        yield pa.Table.from_arrays(found, names)

    own = parents.select(key, "style", "based_on", *columns)
    schema = StructType([own.schema[key], own.schema["style"], *(StructField(c, own.schema[c].dataType) for c in columns)])
    names = schema.names
    return by_documents(named(own, *columns), key, schema, run)


def hidden(parents: DataFrame, key: str) -> DataFrame:
    """Whether text of each style is hidden: key, style, hidden; as ``hidden_styles``, without the pairs of a style and what it builds on.

    Parents are rows (key, style, based_on, enabled): enabled where the style switches ``vanish`` on.
    """

    def run(rows: pa.Table) -> Iterator[pa.Table]:
        trees = Trees(rows, key)
        own = np.flatnonzero(trees.own)
        on = np.zeros(trees.n, np.int64)
        on[trees.at[np.flatnonzero(rows["enabled"].fill_null(False).to_numpy())]] = 1
        yield pa.Table.from_arrays([trees.key_of(own), trees.name_of(own), pa.array(trees.sums(on)[own] % 2 == 1)], names)

    own = parents.select(key, "style", "based_on", "enabled")
    schema = StructType([own.schema[key], own.schema["style"], StructField("hidden", BooleanType())])
    names = schema.names
    return by_documents(named(own, "enabled"), key, schema, run)


def cycles(parents: DataFrame, key: str) -> DataFrame:
    """Styles that come to build on themselves."""
    return chains(parents, key).where("distance > 0 and ancestor = style").select(key, "style").distinct()


def nearest_property(chain: DataFrame, properties: DataFrame, key: str) -> DataFrame:
    """The value that a style ends up with: that of the nearest style that sets it; properties are (key, style, property, value)."""
    named = properties.select(key, F.col("style").alias("ancestor"), "property", "value")
    found = chain.join(named, [key, "ancestor"])
    return found.groupBy(key, "style", "property").agg(F.min_by("value", "distance").alias("value"))


def hidden_styles(chain: DataFrame, toggles: DataFrame, key: str) -> DataFrame:
    """Whether text of a style is hidden: each style on the chain that switches ``vanish`` on turns it over; toggles are (key, style, enabled)."""
    on = toggles.where("enabled").select(key, F.col("style").alias("ancestor"), F.lit(1).alias("turn")).distinct()
    return chain.join(on, [key, "ancestor"], "left").groupBy(key, "style").agg((F.coalesce(F.sum("turn"), F.lit(0)) % 2 == 1).alias("hidden"))


def font_closure(fonts: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """Fonts that are symbol fonts by any chain of alternate names, however long; aliases are (key, font, other) and hold both ways.

    An alias with a null name links nothing.
    """
    kind = fonts.schema["font"].dataType
    found = fonts.select(key, "font", F.lit(None).cast(kind).alias("other"))
    rows = found.unionByName(aliases.where("other is not null").select(key, F.col("font").cast(kind).alias("font"), F.col("other").cast(kind).alias("other")))

    def close(own: pa.Table) -> Iterator[pa.Table]:
        linked = Named(own, key, "font", "other")
        group, one, other = np.arange(linked.n), linked.at[linked.pairs], linked.linked
        while len(one):  # each group's number is its least font; groups that are linked join the lesser one
            a, b = group[one], group[other]
            apart = a != b
            one, other, a, b = one[apart], other[apart], a[apart], b[apart]
            np.minimum.at(group, np.maximum(a, b), np.minimum(a, b))
            while (group[group] != group).any():
                group = group[group]
        symbols = np.zeros(linked.n, bool)
        symbols[group[np.delete(linked.at, linked.pairs)]] = True
        closed = np.flatnonzero(symbols[group])
        yield pa.Table.from_arrays([linked.key_of(closed), linked.name_of(closed)], names)

    schema = StructType([rows.schema[key], rows.schema["font"]])
    names = schema.names
    return by_documents(rows.where("font is not null"), key, schema, close)


def first_fault(properties: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """The first code, by the rules' order, of each document: rules are (rank, property, least, most, code) for numeric values."""
    value = F.col("value").cast("double")
    hits = properties.join(rules, "property").where((value < F.col("least")) | (value > F.col("most")))
    return hits.groupBy(key).agg(F.min_by("code", "rank").alias("code"))

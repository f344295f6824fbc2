"""Best-fit packing of token sequences: best-two-fit over the histogram of piece lengths.

No piece is longer than a sequence, so a corpus of any size has at most ``size`` distinct lengths. The heuristic packs
that histogram on the driver and gives patterns with their numbers of uses; each piece then finds its sequence from
its length and its rank among the pieces of that length, which prefix sums over partitions give.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, written
from .encoding import encoder, spec_of

BLOCK = 4 << 20


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Packs ``counts[n]`` documents of each length n into bins of ``size``: patterns of lengths, and uses of each.

    A bin takes the longest document left, then again and again the longest that fits. After that its smallest
    document gives way to the two unpacked ones that together fill the expanded gap most tightly, if they fill it
    better than it did; that repeats on the new smallest until nothing improves. A pattern is used as often as the
    lengths left allow, so there are few patterns whatever the counts.
    """
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] += c
    lengths = np.arange(size + 1)
    patterns: list[tuple[list[int], int]] = []

    def floors() -> np.ndarray:
        """The longest length left that is at most each number, 0 for none."""
        return np.maximum.accumulate(np.where(left > 0, lengths, 0))

    while True:
        floor = floors()
        n = int(floor[size])
        if not n:
            return patterns
        own: list[int] = []
        gap = size
        while n:
            own.append(n)
            left[n] -= 1
            gap -= n
            if not left[n]:
                floor = floors()
            n = int(floor[gap])
        while gap and len(own) > 1:
            least = own[-1]
            room = gap + least
            first = np.flatnonzero(left[1:room] > 0) + 1
            second = floor[room - first]
            twice = (second == first) & (left[first] < 2)
            if twice.any():  # one document isn't two: the next shorter length stands in
                second[twice] = floor[np.maximum(first[twice] - 1, 0)]
            sums = np.where(second > 0, first + second, 0)
            if not len(sums) or sums.max() <= least:
                break
            k = int(sums.argmax())
            a, b = sorted((int(first[k]), int(second[k])), reverse=True)
            left[least] += 1
            left[a] -= 1
            left[b] -= 1
            own[-1:] = [a, b]
            own.sort(reverse=True)
            gap = room - a - b
            floor = floors()
        need = Counter(own)
        more = min(int(left[n]) // q for n, q in need.items())
        for n, q in need.items():
            left[n] -= more * q
        patterns.append((own, 1 + more))


def places(patterns: list[tuple[list[int], int]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the first rank of each stretch of ranks, the sequence it starts at, pieces a sequence, and offsets."""
    rows: dict[int, list[tuple[int, int, int, list[int]]]] = {}
    taken, base = Counter(), 0
    for own, uses in patterns:
        at: dict[int, list[int]] = {}
        offset = 0
        for n in own:
            at.setdefault(n, []).append(offset)
            offset += n
        for n, offsets in at.items():
            rows.setdefault(n, []).append((taken[n], base, len(offsets), offsets))
            taken[n] += uses * len(offsets)
        base += uses
    out = {}
    for n, xs in rows.items():
        starts = np.cumsum([0, *(x[2] for x in xs)])
        out[n] = (*(np.array([x[k] for x in xs], np.int64) for k in range(3)), starts[:-1], np.concatenate([x[3] for x in xs]).astype(np.int64))
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """The documents' ids in pieces of at most ``size``: key, piece, start, length, ids_crc32, and with ``ids`` the ids.

    Only a document of more than ``size`` ids is cut; its last pieces are full and its first holds the rest. ``part``
    and ``rank`` number the pieces of each length in their partition.
    """
    held = docs.sparkSession.sparkContext.broadcast(spec_of(tokenizer))
    kind = docs.schema[key].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = None, np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in by_bytes(batches, "text", BLOCK):
            enc = enc or encoder(held.value)
            rows: list[tuple] = []
            for i, found in enumerate(enc.encode(batch.column("text").to_pylist())):
                found += end
                n = len(found) // 4
                lo, hi, k = 0, n if n <= size else n % size or size, 0
                while lo < n:
                    own = found[4 * lo : 4 * hi]
                    rows.append((i, k, lo, hi - lo, zlib.crc32(own), seen[hi - lo], own))
                    seen[hi - lo] += 1
                    lo, hi, k = hi, hi + size, k + 1
            at, k, lo, n, crc, rank, own = zip(*rows, strict=True)
            columns = [batch.column("key").take(pa.array(at)), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (lo, n, crc, rank)), pa.array([part] * len(at), pa.int32())]
            names = ["key", "piece", "start", "length", "ids_crc32", "rank", "part"]
            if ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in own], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        if enc:
            enc.trim()

    schema = f"key {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, rank long, part int" + ", ids array<long>" * ids
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``size`` tokens: a row per piece with its sequence and offset there.

    Null and empty texts are documents of the end id alone; rows that repeat are packed each; an empty table gives no rows;
    columns other than the key and the text are not read. The pieces are written to the shared folder, so that each keeps
    its rank if an executor is lost; the driver gets one number for each distinct length.
    """
    cut = written(pieces(docs, tokenizer, end_id, size, key, text, ids), "pieces")
    local = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = local.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(best_two_fit(counts, size), size)
    held = docs.sparkSession.sparkContext.broadcast(table)
    ranked = cut.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    names = [c for c in ranked.columns if c != "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for length in np.unique(n):
                own = np.flatnonzero(n == length)
                first, base, each, starts, offsets = held.value[int(length)]
                k = np.searchsorted(first, rank[own], side="right") - 1
                t = rank[own] - first[k]
                sequence[own] = base[k] + t // each[k]
                offset[own] = offsets[starts[k] + t % each[k]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    placed = ranked.mapInArrow(place, ", ".join([*(f"{c} {kinds[c]}" for c in names), "sequence_id long", "offset long"]))
    return placed.withColumnRenamed("key", key).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] * ids))

"""Removal of byte strings that repeat across a corpus, by suffix sorting of the places where a repeat is possible.

Any window of a text's short grams has a gram of least hash. A string of ``length`` bytes holds just one window, so
equal strings have their least gram, the anchor, at the same place in them. A task's texts make units; for each unit
the grams of its anchors meet those of all others, counted beforehand, and come back with how often they occur. Anchors whose gram occurs once in
the corpus are out. For the others the bytes around the anchor go to the bucket of its gram, where the
starts of all strings that have this anchor are suffix-sorted by hash-compared merge sort: a string repeats if it
agrees with a neighbour in all ``length`` bytes.

The anchors of a gram that very many documents share go to groups of bounded size. There some anchors are compared with all others
first, which settles the passage that they share; what is left is sorted in parts. Strings that repeat in none of a gram's groups
meet those of the other groups by two hashes, and those that meet are sent there as bytes and compared. So no gathering grows with
a passage's documents, and bytes decide everywhere. Exact copies of a text are one class: a long text with copies is covered as a
whole, and in a task one of them stands for all. Documents meet their anchors and their spans by shuffled joins on the class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, settle, written
from .shingles import mixed
from .suffix_sort import BASE, Suffixes, powers, prefix_hashes

#: Bytes of a gram; bytes of text hashed at a time; anchors of a unit.
GRAM, BLOCK, UNIT = 50, 2 << 20, 1 << 19

#: The least number of buckets, and the bytes that one holds on average where more are needed for it.
BUCKETS, BUCKET_BYTES = 1024, 16 << 20

#: Anchors that are sorted together, anchors of one gram that are gathered in one group, and those compared with all others of a group.
CROWD, GROUP, PIVOTS = 64, 8192, 4

#: Strings that a task gathers before they go to where all groups' strings meet.
MEETINGS = 1 << 20

#: Classes that a task remembers; copies from which a class's rows don't join by shuffling, and its share of all rows for that.
MOST_SEEN, HOT, HOT_SHARE = 1 << 17, 1000, 1 << 16

#: Of the groups that know a string for repeated, those that show its bytes to groups that ask.
SHOWN = 4

INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
OTHER_BASE = np.uint64(0xD6E8FEB86659FD93)


def buckets_for(size: int) -> int:
    """How many buckets so many bytes are dealt to: a power of two that keeps each at BUCKET_BYTES on average."""
    return max(BUCKETS, 1 << max(0, int(-(-size // BUCKET_BYTES) - 1).bit_length()))


def leftmost_least(value: np.ndarray, window: int) -> np.ndarray:
    """Where the least value of each window stands, the leftmost of equal ones.

    A window consists of the later part of one stretch of ``window`` places and the earlier part of the next; the least
    values of all such parts, and their places, come from running minima.
    """
    n = len(value)
    count = n - window + 1
    rows = -(-n // window)
    padded = np.full(rows * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = value
    padded = padded.reshape(rows, window)
    columns = np.arange(window, dtype=np.int32)
    ahead = np.minimum.accumulate(padded, axis=1)
    fresh = np.ones(padded.shape, bool)  # less than all before it in its stretch
    fresh[:, 1:] = padded[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(fresh, columns, 0), axis=1)
    turned = padded[:, ::-1]
    behind = np.minimum.accumulate(turned, axis=1)
    fresh[:, 1:] = turned[:, 1:] <= behind[:, :-1]  # of equal ones that further left
    behind_at = window - 1 - np.maximum.accumulate(np.where(fresh, columns, 0), axis=1)[:, ::-1]
    behind = behind[:, ::-1]
    base = (np.arange(rows) * window)[:, None]
    later, early = (behind.ravel()[:count], (behind_at + base).ravel()[:count]), (ahead.ravel()[window - 1 : window - 1 + count], (ahead_at + base).ravel()[window - 1 : window - 1 + count])
    return np.where(later[0] <= early[0], later[1], early[1])


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """The anchors of all strings of ``length`` bytes: text number, place, gram hash, first and last start that it serves."""
    sizes = np.array([len(t) for t in texts], np.int64)
    empty = tuple(np.empty(0, k) for k in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    total = int(sizes.sum())
    window = length - GRAM + 1
    if total < length:
        return empty
    flat = np.frombuffer(b"".join(texts), np.uint8)
    power = powers(total + 1)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[:total], out=sums[1:])
    n = total - GRAM + 1
    value = mixed((sums[GRAM:] - sums[:n]) * powers(n, INVERSE))
    del sums, power
    count = n - window + 1
    if count <= 0:
        return empty
    least = leftmost_least(value, window)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # starts whose string lies in one text
    doc = np.repeat(np.arange(len(texts)), sizes)[:count]
    valid = np.flatnonzero(np.arange(count) + length <= ends[doc])
    if not len(valid):
        return empty
    place, doc = least[valid], doc[valid]
    heads = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    tails = np.append(heads[1:], len(valid)) - 1
    base = starts[doc[heads]]
    return doc[heads], place[heads] - base, value[place[heads]], valid[heads] - base, valid[tails] - base


#: An anchor: gram hash, class, place, and distances to its first and last start.
ANCHOR = np.dtype([("gram", "<u8"), ("cls", "V16"), ("place", "<u4"), ("first", "<u2"), ("last", "<u2")])

#: A unit's gram: the class that alone holds it there, once, or 0, and how often it occurs.
HELD = np.dtype([("gram", "<u8"), ("who", "<u8"), ("n", "<u4")])

#: A gram that occurs again, and how often; an anchor of a class with one.
AGAIN = np.dtype([("gram", "<u8"), ("n", "<u4")])
FOUND = np.dtype([("gram", "<u8"), ("place", "<u4"), ("first", "<u2"), ("last", "<u2"), ("n", "<u4")])

#: A string's hashes, the group that holds it, and whether that group doesn't know it for repeated.
MEETING = np.dtype([("a", "<u8"), ("b", "<u8"), ("group", "<i8"), ("open", "u1")])


def around_kind(length: int) -> np.dtype:
    """An anchor's record with its group among those of the gram, and the bytes around it."""
    return np.dtype([*((n, ANCHOR[n]) for n in ANCHOR.names), ("salt", "<u4"), ("split", "u1"), ("bytes", "u1", (2 * length - GRAM,))])


def shown_kind(length: int) -> np.dtype:
    """A string that another group's may equal: hashes, class, start, whether it is open, and its bytes."""
    return np.dtype([("a", "<u8"), ("b", "<u8"), ("cls", "V16"), ("start", "<u4"), ("open", "u1"), ("bytes", f"V{length}")])


def dealt(rows: np.ndarray, spread: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """The records, packed, by their buckets. Grams of anchors are least ones, so that their hashes are spread anew."""
    bucket = (mixed(spread ^ OTHER_BASE) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    own = bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else []
    for k, part in zip(own[heads] if len(own) else (), np.split(rows[order], heads[1:]) if len(own) else (), strict=True):
        yield int(k), zstandard.compress(part.tobytes(), 1)


def gathered(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """The records of each of a partition's buckets."""
    found: dict[int, list[bytes]] = {}
    for batch in batches:
        for k, x in zip(batch.column("bucket").to_pylist(), batch.column("held").to_pylist(), strict=True):
            found.setdefault(k, []).append(x)
    while found:
        _, parts = found.popitem()
        yield np.frombuffer(b"".join(zstandard.decompress(x) for x in parts), kind)
    settle()


def packed_rows(parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([x for _, x in parts], pa.binary())], ["bucket", "held"])


DEALT = "bucket long, held binary"


def one_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows, of copies the first; it forgets all once it remembers very many classes."""
    seen: set[bytes] = set()
    for batch in batches:
        mask = []
        for c in batch.column("cls").to_pylist():
            mask.append(c not in seen)
            seen.add(c)
        if len(seen) >= MOST_SEEN:
            seen.clear()
        yield batch.filter(pa.array(mask, pa.bool_()))


def find_anchors(length: int):
    """A mapInArrow function: the anchors of each text, in units of whole texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        unit = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(parts)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([len(rows)], pa.int64()), pa.array([zstandard.compress(rows.tobytes(), 1)], pa.binary())], ["unit", "n", "held"])

        for batch in by_bytes(one_of_each(batches), "text", BLOCK):
            fresh = {c: t.encode() for c, t in zip(batch.column("cls").to_pylist(), batch.column("text").to_pylist(), strict=True)}
            doc, place, gram, first, last = anchors(list(fresh.values()), length)
            rows = np.zeros(len(doc), ANCHOR)
            cls = np.frombuffer(b"".join(fresh), "V16")
            rows["gram"], rows["cls"], rows["place"], rows["first"], rows["last"] = gram, cls[doc], place, place - first, place - last
            parts.append(rows)
            if sum(map(len, parts)) >= UNIT:
                yield flush()
                unit += 1
        if parts:
            yield flush()

    return find


def unit_grams(buckets: int):
    """A mapInArrow function: each unit's distinct grams, dealt to buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, held in zip(batch.column("unit").to_pylist(), batch.column("held").to_pylist(), strict=True):
                rows = np.frombuffer(zstandard.decompress(held), ANCHOR)
                rows = rows[np.argsort(rows["gram"], kind="stable")]
                heads = np.flatnonzero(np.concatenate([[True], rows["gram"][1:] != rows["gram"][:-1]])) if len(rows) else np.zeros(0, np.int64)
                out = np.zeros(len(heads), HELD)
                out["gram"], out["n"] = rows["gram"][heads], np.diff(np.append(heads, len(rows)))
                who = np.ascontiguousarray(rows["cls"]).view("<u8").reshape(-1, 2)[:, 0][heads]
                out["who"] = np.where(out["n"] > 1, np.uint64(0), np.maximum(who, 1))
                parts = list(dealt(out, out["gram"], buckets))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([unit] * len(parts), pa.int64()), pa.array([x for _, x in parts], pa.binary())], ["bucket", "unit", "held"])

    return count


def grams_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each unit those of a bucket's grams that two places hold, in texts that aren't copies, and how often they occur."""
    found: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for k, unit, x in zip(*(batch.column(c).to_pylist() for c in ("bucket", "unit", "held")), strict=True):
            found.setdefault(k, []).append((unit, x))
    while found:
        _, parts = found.popitem()
        own = [np.frombuffer(zstandard.decompress(x), HELD) for _, x in parts]
        unit = np.repeat(np.array([u for u, _ in parts], np.int64), [len(x) for x in own])
        rows = np.concatenate(own)
        order = np.argsort(rows["gram"], kind="stable")
        rows, unit = rows[order], unit[order]
        heads = np.flatnonzero(np.concatenate([[True], rows["gram"][1:] != rows["gram"][:-1]])) if len(rows) else np.zeros(0, np.int64)
        if not len(heads):
            continue
        size = np.diff(np.append(heads, len(rows)))
        total = np.add.reduceat(rows["n"].astype(np.int64), heads)
        # one class alone, in several units: copies of one text
        low, high = np.minimum.reduceat(rows["who"], heads), np.maximum.reduceat(rows["who"], heads)
        again = np.repeat((low == 0) | (low != high), size)
        out = np.zeros(len(rows), AGAIN)
        out["gram"], out["n"] = rows["gram"], np.minimum(np.repeat(total, size), 2**32 - 1)
        out, unit = out[again], unit[again]
        order = np.argsort(unit, kind="stable")
        out, unit = out[order], unit[order]
        cuts = np.flatnonzero(unit[1:] != unit[:-1]) + 1
        names = unit[np.concatenate([[0], cuts])] if len(unit) else unit
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.tobytes() for x in np.split(out, cuts)][: len(names)], pa.binary())], ["unit", "again"])


def chosen_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors, by class, whose gram occurs again."""
    for batch in batches:
        for held, again in zip(batch.column("held").to_pylist(), batch.column("again").to_pylist(), strict=True):
            rows = np.frombuffer(zstandard.decompress(held), ANCHOR)
            known = np.sort(np.frombuffer(again, AGAIN), order="gram")
            at = np.minimum(np.searchsorted(known["gram"], rows["gram"]), len(known) - 1)
            own = known["gram"][at] == rows["gram"]
            rows, n = rows[own], known["n"][at[own]]
            out = np.zeros(len(rows), FOUND)
            for c in ("gram", "place", "first", "last"):
                out[c] = rows[c]
            out["n"] = n
            cls = np.ascontiguousarray(rows["cls"]).view("<u8").reshape(-1, 2)
            cuts = np.flatnonzero((cls[1:] != cls[:-1]).any(axis=1)) + 1  # a class's anchors stand together
            names = [x.tobytes() for x in cls[np.concatenate([[0], cuts])]] if len(cls) else []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([len(x) for x in np.split(out, cuts)][: len(names)], pa.int64()), pa.array([x.tobytes() for x in np.split(out, cuts)][: len(names)], pa.binary())], ["cls", "n", "found"])


def around(length: int, buckets: int):
    """A mapInArrow function: the bytes around repeated anchors, packed, in the buckets of their gram and group."""
    kind = around_kind(length)
    reach, width = length - GRAM, 2 * length - GRAM

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BLOCK):
            parts, last = [], None
            for text, cls, found in zip(*(batch.column(c).to_pylist() for c in ("text", "cls", "found")), strict=True):
                if cls == last:  # copies stand together after the join
                    continue
                last = cls
                own = np.frombuffer(found, FOUND)
                padded = np.frombuffer(bytes(reach) + text.encode() + bytes(length), np.uint8)
                rows = np.zeros(len(own), kind)
                rows["cls"] = np.frombuffer(cls, "V16")[0]
                for c in ("gram", "place", "first", "last"):
                    rows[c] = own[c]
                groups = -(-own["n"].astype(np.int64) // GROUP)
                rows["salt"] = mixed(own["place"].astype(np.uint64) ^ np.frombuffer(cls[:8], "<u8")[0]) % groups.astype(np.uint64)
                rows["split"] = groups > 1
                rows["bytes"] = padded[own["place"].astype(np.int64)[:, None] + np.arange(width)]
                parts.append(rows)
            rows = np.concatenate(parts) if parts else np.zeros(0, kind)
            yield packed_rows(list(dealt(rows, rows["gram"] + mixed(rows["salt"].astype(np.uint64)), buckets)))

    return cut


def starts_of(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All strings that the anchors serve: the anchor's number, and the offset in its bytes."""
    reach = length - GRAM
    first, last = reach - rows["first"].astype(np.int64), reach - rows["last"].astype(np.int64)
    n = last - first + 1
    return np.repeat(np.arange(len(rows)), n), np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def hashes_of(held: np.ndarray, row: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each whole string."""
    out = []
    for base in (BASE, OTHER_BASE):
        sums = prefix_hashes(held, base)
        out.append(mixed((sums[row, at + length] - sums[row, at]) * powers(held.shape[1] - length + 1, base)[::-1][at]))
    return out[0], out[1]


def settle_crowd(rows: np.ndarray, row: np.ndarray, at: np.ndarray, hit: np.ndarray, length: int) -> np.ndarray:
    """Which strings of a large group's anchors repeat in it, beside those known for it.

    A few anchors, each the one with most open strings, are compared with all others: the bytes agree from the last difference before the gram
    to the first one after it, and every string in between is equal. The open strings that are left and share a hash are
    suffix-sorted, CROWD anchors at a time, and those of different parts are compared by hash and bytes.
    """
    held = np.ascontiguousarray(rows["bytes"])
    reach, width = length - GRAM, held.shape[1]
    first, last = reach - rows["first"].astype(np.int64), reach - rows["last"].astype(np.int64)
    n = last - first + 1
    base = np.cumsum(n) - n
    hit, tried = hit.copy(), np.zeros(len(rows), bool)
    for _ in range(PIVOTS):
        free = np.bincount(row[~hit], minlength=len(rows)) * ~tried
        p = int(free.argmax())
        if not free[p]:
            break
        tried[p] = True
        differ = held != held[p]
        low = np.where(differ[:, :reach].any(axis=1), reach - np.argmax(differ[:, :reach][:, ::-1], axis=1), 0)
        high = np.where(differ[:, reach + GRAM :].any(axis=1), reach + GRAM + np.argmax(differ[:, reach + GRAM :], axis=1), width) - length
        low, high = np.maximum(np.maximum(low, first), first[p]), np.minimum(np.minimum(high, last), last[p])
        fine = (low <= high) & ~differ[:, reach : reach + GRAM].any(axis=1)
        fine[p] = False
        turns = np.zeros(len(row) + 1, np.int64)
        own = np.flatnonzero(fine)
        np.add.at(turns, base[own] + low[own] - first[own], 1)
        np.add.at(turns, base[own] + high[own] - first[own] + 1, -1)
        np.add.at(turns, base[p] + low[own] - first[p], 1)
        np.add.at(turns, base[p] + high[own] - first[p] + 1, -1)
        hit |= np.cumsum(turns)[:-1] > 0
    a, b = hashes_of(held, row, at, length)
    order = np.argsort(a, kind="stable")
    same = a[order][1:] == a[order][:-1]
    shared = np.zeros(len(a), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    k = np.flatnonzero(shared & ~hit)
    if len(k):
        hit[k] |= Suffixes(held, length).repeated(row[k], at[k], row[k] // CROWD * (reach + 1) + at[k])
    open_ = np.flatnonzero(shared & ~hit)
    if len(open_):
        mine = shared & np.isin(a, a[open_])
        known = np.flatnonzero(mine & hit)
        _, once = np.unique(a[known], return_index=True)  # of strings that are known, one stands for all with its hash
        k = np.concatenate([open_, known[once]])
        hit[k] |= equal_strings(held, row[k], at[k], a[k], b[k], length)
    return hit


def equal_strings(held: np.ndarray, row: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which strings equal another: those whose two hashes are the same, compared by their bytes."""
    out = np.zeros(len(row), bool)
    order = np.lexsort((b, a))
    same = np.zeros(len(order), bool)
    same[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = np.flatnonzero(same)
    span = np.arange(length)
    for lo in range(0, len(later), 8192):
        k = later[lo : lo + 8192]
        x, y = order[k], order[head[k]]
        sound = (held[row[x][:, None], at[x][:, None] + span] == held[row[y][:, None], at[y][:, None] + span]).all(axis=1)
        out[x[sound]] = out[y[sound]] = True
        for h in np.unique(head[k[~sound]]):  # hashes that collide: the bytes alone decide
            own = order[np.flatnonzero(head == h)]
            raw = [held[row[i], at[i] : at[i] + length].tobytes() for i in own]
            out[own] |= [raw.count(s) > 1 for s in raw]
    return out


def settled(length: int, groups: int):
    """A mapInArrow function: the bytes that strings cover which repeat in their group, and what split groups don't know.

    In a group anchors with the same bytes around them count as one. The others are suffix-sorted, or settled as a crowd. Of a gram in
    several groups the strings go on, one of equal ones, to where all groups' strings meet by their hashes
    (``bucket``), and the rows as they are, under the group's number.
    """
    kind = around_kind(length)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        leaving: list[np.ndarray] = []

        def leave() -> pa.RecordBatch:
            rows = np.concatenate(leaving)
            leaving.clear()
            return emitted(list(dealt(rows, rows["a"], groups)))

        for rows in gathered(batches, kind):
            cls = np.ascontiguousarray(rows["cls"]).view("<u8").reshape(-1, 2)
            order = np.lexsort((rows["place"], cls[:, 1], cls[:, 0], rows["salt"], rows["gram"]))
            rows, cls = rows[order], cls[order]
            same = (rows["gram"][1:] == rows["gram"][:-1]) & (rows["salt"][1:] == rows["salt"][:-1])
            again = np.zeros(len(rows), bool)  # copies of one text
            again[1:] = same & (rows["place"][1:] == rows["place"][:-1]) & (cls[1:] == cls[:-1]).all(axis=1)
            group = np.cumsum(np.concatenate([[True], ~same]))[~again] - 1 if len(rows) else np.zeros(0, np.int64)
            rows = rows[~again]
            if not len(rows):
                continue
            alike, number_of, many = contexts(rows, group)
            own, group = rows[alike], group[alike]
            row, at = starts_of(own, length)
            hit = many[row]
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            tails = np.append(heads[1:], len(own))
            starts = np.searchsorted(row, np.append(heads, len(own)))
            few = np.repeat(tails - heads <= CROWD, tails - heads)
            k = np.flatnonzero(few[row])
            if len(k):
                hit[k] |= Suffixes(np.ascontiguousarray(own["bytes"]), length).repeated(row[k], at[k], group[row[k]] * (length - GRAM + 1) + at[k])
            for i in np.flatnonzero(tails - heads > CROWD):
                mine = slice(starts[i], starts[i + 1])
                hit[mine] = settle_crowd(own[heads[i] : tails[i]], row[mine] - heads[i], at[mine], hit[mine], length)
            yield covered(rows, number_of, row, at, hit, length)
            for i in np.flatnonzero(own["split"][heads] > 0):
                mine = slice(starts[i], starts[i + 1])
                some = own[heads[i] : tails[i]]
                a, b = hashes_of(np.ascontiguousarray(some["bytes"]), row[mine] - heads[i], at[mine], length)
                out = np.zeros(len(a), MEETING)
                out["a"], out["b"], out["group"], out["open"] = a, b, number, ~hit[mine]
                order = np.lexsort((out["open"], b, a))
                fresh = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
                leaving.append(out[order[fresh | (out["open"][order] > 0)]])
                yield kept_group(number, some, np.packbits(hit[mine]))
                number += 1
                if sum(map(len, leaving)) >= MEETINGS:
                    yield leave()
        if leaving:
            yield leave()

    return settle


def contexts(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors that differ in group, bytes or starts: one of each, its number for each anchor, and whether several are alike."""
    raw = np.concatenate([group.astype("<u4")[:, None].view(np.uint8).reshape(len(rows), -1), rows["first"][:, None].view(np.uint8).reshape(len(rows), -1), rows["last"][:, None].view(np.uint8).reshape(len(rows), -1), rows["bytes"]], axis=1)
    raw[:, :4] = raw[:, 3::-1]  # big-endian: groups stay in order
    _, first, inverse, counts = np.unique(np.ascontiguousarray(raw).view(f"V{raw.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True)
    return first, inverse, counts > 1


def covered(rows: np.ndarray, number_of: np.ndarray, row: np.ndarray, at: np.ndarray, hit: np.ndarray, length: int) -> pa.RecordBatch:
    """The runs of bytes that hit strings cover, for all anchors that are alike."""
    reach = length - GRAM
    k = np.flatnonzero(hit)
    own, lo, hi = runs(row[k], at[k])
    first = np.searchsorted(own, np.arange(int(number_of.max()) + 2))  # the runs of each distinct anchor
    n = (first[1:] - first[:-1])[number_of]
    member = np.repeat(np.arange(len(rows)), n)
    run = np.arange(int(n.sum())) + np.repeat(first[number_of] - (np.cumsum(n) - n), n)
    start = rows["place"].astype(np.int64)[member] - reach
    m = len(member)
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in rows["cls"][member]], pa.binary()), pa.array(start + lo[run], pa.int64()), pa.array(start + hi[run] + length, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], SETTLED_NAMES)


SETTLED_NAMES = ["cls", "start", "end", "bucket", "group", "held"]
SETTLED = "cls binary, start long, end long, bucket long, group long, held binary"


def emitted(parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    m = len(parts)
    return pa.RecordBatch.from_arrays([pa.nulls(m, pa.binary()), *[pa.nulls(m, pa.int64())] * 2, pa.array([k for k, _ in parts], pa.int64()), pa.nulls(m, pa.int64()), pa.array([x for _, x in parts], pa.binary())], SETTLED_NAMES)


def kept_group(group: int, rows: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    held = len(rows).to_bytes(4, "little") + rows.tobytes() + bits.tobytes()
    return pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), *[pa.nulls(1, pa.int64())] * 3, pa.array([group], pa.int64()), pa.array([zstandard.compress(held, 1)], pa.binary())], SETTLED_NAMES)


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group its strings that an open string of another group may equal: all open ones, and some that are known for repeated."""
    for rows in gathered(batches, MEETING):
        order = np.lexsort((rows["group"], 1 - rows["open"], rows["b"], rows["a"]))
        rows = rows[order]
        same = np.zeros(len(rows), bool)
        same[1:] = (rows["a"][1:] == rows["a"][:-1]) & (rows["b"][1:] == rows["b"][:-1])
        heads = np.flatnonzero(~same)
        size = np.diff(np.append(heads, len(rows)))
        opened = np.add.reduceat(rows["open"].astype(np.int64), heads) if len(rows) else size
        place = np.arange(len(rows)) - np.repeat(heads, size)
        wanted = np.repeat((size > 1) & (opened > 0), size) & (place < np.repeat(opened, size) + SHOWN)
        out = rows[wanted]
        out = out[np.argsort(out["group"], kind="stable")]
        cuts = np.flatnonzero(out["group"][1:] != out["group"][:-1]) + 1
        parts = np.split(out, cuts) if len(out) else []
        yield pa.RecordBatch.from_arrays([pa.array([int(x["group"][0]) for x in parts], pa.int64()), pa.array([np.ascontiguousarray(np.stack([x["a"], x["b"]], axis=1)).tobytes() for x in parts], pa.binary())], ["group", "pairs"])


def shown(length: int, buckets: int):
    """A mapInArrow function: the wanted strings of each group as bytes, dealt to the buckets of their hashes."""
    kind, out_kind = around_kind(length), shown_kind(length)

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, pairs in zip(batch.column("held").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                raw = zstandard.decompress(held)
                n = int.from_bytes(raw[:4], "little")
                rows = np.frombuffer(raw[4 : 4 + n * kind.itemsize], kind)
                row, at = starts_of(rows, length)
                a, b = hashes_of(np.ascontiguousarray(rows["bytes"]), row, at, length)
                hit = np.unpackbits(np.frombuffer(raw[4 + n * kind.itemsize :], np.uint8), count=len(row)).astype(bool)
                own = np.stack([a, b], axis=1).astype("<u8").view("V16").ravel()
                mine = np.flatnonzero(np.isin(own, np.frombuffer(pairs, "V16")))
                _, once = np.unique(own[mine], return_index=True)  # of strings that are known one is enough
                mine = np.union1d(mine[once], mine[~hit[mine]])
                out = np.zeros(len(mine), out_kind)
                out["a"], out["b"], out["cls"], out["open"] = a[mine], b[mine], rows["cls"][row[mine]], ~hit[mine]
                out["start"] = rows["place"].astype(np.int64)[row[mine]] - (length - GRAM) + at[mine]
                bytes_ = np.ascontiguousarray(rows["bytes"])[row[mine][:, None], at[mine][:, None] + np.arange(length)]
                out["bytes"] = np.ascontiguousarray(bytes_).view(f"V{length}").ravel()
                yield packed_rows(list(dealt(out, out["a"], buckets)))

    return show


def compared(length: int):
    """A mapInArrow function: the open strings that equal a string of another group, as spans."""
    kind = shown_kind(length)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches, kind):
            _, inverse, counts = np.unique(rows["bytes"], return_inverse=True, return_counts=True)
            out = rows[(counts[inverse] > 1) & (rows["open"] > 0)]
            start = out["start"].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in out["cls"]], pa.binary()), pa.array(start), pa.array(start + length)], ["cls", "start", "end"])

    return compare


def runs(cls: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts of one class, in the order given: class, first and last."""
    if not len(start):
        return cls, start, start
    cut = np.concatenate([[True], (start[1:] != start[:-1] + 1) | (cls[1:] != cls[:-1])])
    heads = np.flatnonzero(cut)
    return cls[heads], start[heads], start[np.append(heads[1:], len(start)) - 1]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that any span covers; spans that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's bytes that lie in a string of ``length`` bytes which also starts elsewhere: key, text and spans.

    Texts are UTF-8 bytes, null ones empty; strings never cross documents, and overlapping occurrences in one document count.
    Spans are the maximal covered runs, ends exclusive; texts shorter than ``length`` have none. Rows that
    repeat a text, with the same key or another, are copies of each other and wholly covered if they are long enough. An empty table
    gives none; other columns aren't read.
    """
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    long = own.where(F.octet_length("text") >= length).withColumn("cls", F.unhex(F.md5("text")))
    copies = written(long.groupBy("cls").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    units = written(long.select("cls", "text").mapInArrow(find_anchors(length), "unit long, n long, held binary"), "units")
    total = units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = buckets_for(HELD.itemsize * total)
    again = units.select("unit", "held").mapInArrow(unit_grams(buckets), "bucket long, unit long, held binary").repartition("bucket").mapInArrow(grams_again, "unit long, again binary")
    joint = lambda c: F.aggregate(F.collect_list(c), F.lit(b""), lambda x, y: F.concat(x, y))
    known = again.groupBy("unit").agg(joint("again").alias("again"))
    chosen = units.join(known, "unit").select("held", "again").mapInArrow(chosen_anchors, "cls binary, n long, found binary")
    chosen = written(chosen.groupBy("cls").agg(F.first("n").alias("n"), F.first("found").alias("found")), "anchors")
    total = chosen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = buckets_for(around_kind(length).itemsize * total)
    texts = long.select("cls", "text").mapInArrow(one_of_each, "cls binary, text string")
    near = texts.join(chosen, "cls").select("cls", "text", "found").mapInArrow(around(length, buckets), DEALT)
    found = written(near.repartition("bucket").mapInArrow(settled(length, buckets), SETTLED), "settled")
    spans = found.where("cls is not null").select("cls", "start", "end")
    if found.where("group is not null").limit(1).count():
        asked = found.where("bucket is not null").select("bucket", "held").repartition("bucket").mapInArrow(met, "group long, pairs binary").groupBy("group").agg(joint("pairs").alias("pairs"))
        groups = found.where("group is not null").select("group", "held")
        bytes_ = groups.join(asked, "group").select("held", "pairs").mapInArrow(shown(length, buckets), DEALT)
        spans = spans.union(bytes_.repartition("bucket").mapInArrow(compared(length), "cls binary, start long, end long"))
    # texts with copies are covered as a whole, and their rows need no spans
    spans = spans.join(copies, "cls", "left_anti").groupBy("cls").agg(F.collect_list(F.struct("start", "end")).alias("parts"))
    spans = written(spans, "spans")
    none = F.lit(None).cast("array<struct<start: bigint, end: bigint>>")
    named = lambda df, parts, whole: df.select(F.col("key").alias(key), F.col("text").alias(text), parts.alias("parts"), whole.alias("whole"))
    hot = F.broadcast(copies.where(F.col("copies") > max(HOT, long.count() // HOT_SHARE)).select("cls"))
    marks = spans.withColumn("whole", F.lit(False)).unionByName(copies.join(hot, "cls", "left_anti").select("cls", none.alias("parts"), F.lit(True).alias("whole")))
    joined = long.join(hot, "cls", "left_anti").join(marks, "cls", "left")
    short = named(own.where(F.octet_length("text") < length), none, F.lit(False))
    return short.unionByName(named(long.join(hot, "cls", "left_semi"), none, F.lit(True))).unionByName(named(joined, F.col("parts"), F.coalesce("whole", F.lit(False))))


def removed(found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What stays of each document: the key, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay.

    ``kept`` holds those bytes; they need not be valid UTF-8, as spans may begin or end inside a character.
    """

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 * BLOCK):
            out = []
            for t, parts, whole in zip(*(batch.column(c).to_pylist() for c in ("text", "parts", "whole")), strict=True):
                raw = t.encode()
                spans = [(0, len(raw))] if whole else union([(x["start"], x["end"]) for x in parts or ()])
                edges = [0, *(x for s in spans for x in s), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else raw
                out.append((len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
            columns = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns, pa.array([x[3] for x in out], pa.string()), pa.array([x[4] for x in out], pa.binary())], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    own = found.select(F.col(key).alias("key"), F.col(text).alias("text"), "parts", "whole")
    kind = own.schema["key"].dataType.simpleString()
    return own.mapInArrow(remove, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("key", key)

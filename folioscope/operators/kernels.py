"""Order-dependent and recursive kernels on one page or one text, and their DataFrame forms.

The kernels are plain functions on small inputs: a page's boxes, a text, a formula. Their DataFrame forms group by page or work
by batch and never hold more than a page or a batch.
"""

from __future__ import annotations

import ast
import json
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ["x0", "y0", "x1", "y1"]


def overlaps(a: np.ndarray, b: np.ndarray, gap: float = 0.0) -> np.ndarray:
    """For all pairs of boxes whether they share area once those of the first side are grown by a gap."""
    left, right = np.maximum(a[:, None, :2] - gap, b[None, :, :2]), np.minimum(a[:, None, 2:] + gap, b[None, :, 2:])
    return (right > left).all(axis=2)


def closure(boxes: np.ndarray, gap: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Envelopes of boxes that grow together until none overlaps another, from top to bottom, and how many boxes each holds."""
    counts = np.ones(len(boxes), np.int64)
    while len(boxes):
        label = np.arange(len(boxes))
        near = overlaps(boxes, boxes, gap)
        near |= near.T
        while True:
            least = np.where(near, label[None, :], len(boxes)).min(axis=1)
            least = np.minimum(least, label)
            if (least == label).all():
                break
            label = least
        names, group = np.unique(label, return_inverse=True)
        if len(names) == len(boxes):
            break
        fresh = np.empty((len(names), 4))
        for k in range(len(names)):
            own = boxes[group == k]
            fresh[k] = [*own[:, :2].min(axis=0), *own[:, 2:].max(axis=0)]
        boxes, counts = fresh, np.bincount(group, counts).astype(np.int64)
    order = np.lexsort((boxes[:, 0], boxes[:, 1])) if len(boxes) else np.empty(0, np.int64)
    return boxes[order], counts[order]


def grown_over(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """A box, grown until it holds every other box that it touches."""
    while len(others):
        own = others[overlaps(box[None], others)[0]]
        fresh = np.concatenate([np.minimum(box[:2], own[:, :2].min(axis=0, initial=np.inf)), np.maximum(box[2:], own[:, 2:].max(axis=0, initial=-np.inf))])
        if (fresh == box).all():
            break
        box = fresh
    return box


def row_numbers(boxes: np.ndarray, share: float = 0.35) -> np.ndarray:
    """The row of each box, rows numbered from top to bottom: a box joins the first row it overlaps enough along y."""
    order = np.lexsort((boxes[:, 0], boxes[:, 1]))
    tops, bottoms, row = [], [], np.zeros(len(boxes), np.int64)
    for i in order:
        y0, y1 = boxes[i, 1], boxes[i, 3]
        t, b = np.array(tops), np.array(bottoms)
        fits = np.flatnonzero((np.minimum(b, y1) - np.maximum(t, y0)) / np.minimum(b - t, y1 - y0) > share) if tops else []
        if len(fits):
            k = int(fits[0])
            tops[k], bottoms[k] = min(tops[k], y0), max(bottoms[k], y1)
        else:
            k = len(tops)
            tops.append(y0)
            bottoms.append(y1)
        row[i] = k
    rank = np.empty(len(tops), np.int64)
    rank[np.argsort(tops, kind="stable")] = np.arange(len(tops))
    return rank[row] if len(boxes) else row


def line_numbers(centres: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The line of each run, given from top to bottom: the last line whose first run's centre is near enough."""
    firsts: list[float] = []
    line = np.zeros(len(centres), np.int64)
    for i, (c, s) in enumerate(zip(centres, sizes, strict=True)):
        near = [k for k, f in enumerate(firsts) if abs(c - f) < max(2.0, 0.35 * s)]
        if not near:
            firsts.append(c)
        line[i] = near[-1] if near else len(firsts) - 1
    return line


def greedy_matches(edges: list[tuple[float, str, str]]) -> list[tuple[str, str, float]]:
    """One-to-one matches, the best score first and ties by the names."""
    left, right, out = set(), set(), []
    for score, a, b in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b, score))
    return out


def maximum_matching(edges: dict[str, list[str]]) -> dict[str, str]:
    """As many one-to-one matches as there can be: shortest augmenting paths, one breadth-first search each."""
    of: dict[str, str] = {}
    for start in edges:
        came: dict[str, str] = {}
        queue, end = [start], None
        while queue and end is None:
            fresh = []
            for a in queue:
                for b in edges[a]:
                    if b not in came:
                        came[b] = a
                        if b not in of:
                            end = b
                            break
                        fresh.append(of[b])
                if end is not None:
                    break
            queue = fresh
        mate = {a: b for b, a in of.items()}
        while end is not None:
            a = came[end]
            of[end], end = a, mate.get(a)
    return {a: b for b, a in of.items()}


def edit_counts(reference: str, actual: str) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of a least edit; of equal ones that which substitutes, then deletes, later."""
    a, b = (np.frombuffer(s.encode("utf-32-le"), "<u4") for s in (reference, actual))
    n, m = len(a), len(b)
    spots = np.arange(m + 1)
    above = spots
    # of each cell two bits are kept: whether a least edit may end in a pair of characters, or in a deletion
    paired, deleted = (np.empty((n, (m + 7) // 8), np.uint8) for _ in range(2))
    for i in range(1, n + 1):
        pair = above[:-1] + (b != a[i - 1])
        # insertions run along the row: a running minimum of what is left after their cost
        row = np.minimum.accumulate(np.concatenate([[i], np.minimum(pair, above[1:] + 1)]) - spots) + spots
        paired[i - 1], deleted[i - 1] = np.packbits(row[1:] == pair), np.packbits(row[1:] == above[1:] + 1)
        above = row
    bit = lambda rows: rows[i - 1, (j - 1) // 8] >> (7 - (j - 1) % 8) & 1
    s = d = k = 0
    i, j = n, m
    while i or j:
        if i and j and bit(paired):
            s += int(a[i - 1] != b[j - 1])
            i, j = i - 1, j - 1
        elif i and (not j or bit(deleted)):
            d, i = d + 1, i - 1
        else:
            k, j = k + 1, j - 1
    return s, d, k


def abnormal(text: str) -> bool:
    """Whether a text holds characters that a broken mapping leaves: replacement, private, surrogate or unprintable ones."""
    return any(c == "�" or unicodedata.category(c) in ("Co", "Cs") or not (c.isprintable() or c in "\r\n\t") for c in text)


def display_units(text: str) -> float:
    """The width of a text: wide characters count 1, others a half."""
    return sum(1.0 if unicodedata.east_asian_width(c) in "WF" else 0.5 for c in text)


def column_widths(rows: list[list[str]], width: float) -> list[float]:
    """Widths of a grid's columns by their widest texts; equal ones where the texts don't fit anyway."""
    count = max(map(len, rows))
    needs = [max((display_units(r[k]) * 11 + 12 for r in rows if k < len(r)), default=0.0) for k in range(count)]
    equal = width / count
    if sum(needs) >= width:
        return [equal] * count
    wished = [max(equal, n) for n in needs]
    over, spare = sum(wished) - width, sum(w - n for w, n in zip(wished, needs, strict=True))
    return [w - (over * (w - n) / spare if spare else 0.0) for w, n in zip(wished, needs, strict=True)]


def best_window(text: str, paragraphs: list[str], most: int = 3, least: float = 0.55) -> tuple[float, str] | None:
    """The stretch of 1 to ``most`` paragraphs that is most like a text, if it is like enough and not the same."""
    found = [" ".join(paragraphs[i : i + n]) for n in range(1, most + 1) for i in range(len(paragraphs) - n + 1)]
    best = max(((SequenceMatcher(None, text, w).ratio(), w) for w in found), default=None)
    return best if best and best[0] > least and best[1] != text else None


def literal_blocks(content: str | None) -> tuple[str, list[dict] | None]:
    """How a list of records is written, as JSON or as a Python literal, and the records; ``unknown`` and none otherwise."""
    for name, read in (("json", json.loads), ("python_literal_list", lambda s: ast.literal_eval(s.strip()))):
        try:
            value = read(content or "")
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            continue
        if isinstance(value, list) and all(isinstance(x, dict) for x in value):
            return name, value
        if name == "json":
            return name, None
    return "unknown", None


def shape(value) -> dict:
    """The types of a JSON value without its contents: properties, and lists' lengths with the distinct shapes of their items."""
    names = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}
    out: dict = {"type": names[type(value)]}
    if isinstance(value, dict):
        out["properties"] = {k: shape(v) for k, v in value.items()}
    elif isinstance(value, list):
        kinds = {json.dumps(s, sort_keys=True): s for s in map(shape, value)}
        out |= {"count": len(value), "items": list(kinds.values())}
    return out


# Keys that hold media, and what stands in for media and image links.
MEDIA_KEYS = {"images", "outputimages", "inputimage", "image", "base64"}
REMOVED, NO_IMAGE = "[MEDIA_REMOVED]", "[IMAGE_REFERENCE_REMOVED]"


def without_media(value):
    """A JSON value without pictures: media keys go, addresses and long base64 texts are replaced."""
    if isinstance(value, dict):
        return {k: without_media(v) for k, v in value.items() if k.lower() not in MEDIA_KEYS}
    if isinstance(value, list):
        return list(map(without_media, value))
    if not isinstance(value, str):
        return value
    encoded = len(value) > 256 and re.fullmatch(r"[A-Za-z0-9+/=\r\n]+", value)
    return REMOVED if encoded or re.match(r"https?://|data:", value) else re.sub(r"!\[[^\]]*\]\([^)]*\)", NO_IMAGE, value)


def table_grid(rows: list[list[tuple[int, int, str]]]) -> list[tuple[int, int, int, int, str]] | None:
    """Where the cells of a table's rows, given as (rowspan, colspan, text), come to stand; None where they leave holes or collide."""
    taken: dict[tuple[int, int], int] = {}
    cells = []
    for r, row in enumerate(rows):
        c = 0
        for down, across, text in row:
            while (r, c) in taken:
                c += 1
            spots = [(y, x) for y in range(r, r + down) for x in range(c, c + across)]
            if not (1 <= down <= len(rows) - r and 1 <= across <= 1000) or any(s in taken for s in spots):
                return None
            taken.update(dict.fromkeys(spots, len(cells)))
            cells.append((r, c, down, across, text))
            c += across
    width = 1 + max((x for _, x in taken), default=-1)
    return cells if width and len(taken) == width * len(rows) else None


def html_grid(markup: str) -> list[tuple[int, int, int, int, str]] | None:
    """The grid of a plain HTML table; None for other markup."""
    if not re.fullmatch(r"\s*<table>(?s:.*)</table>\s*", markup) or re.search(r"<(?!/?(?:table|tbody|tr|td|br)\b)", markup):
        return None
    rows = []
    for row in re.findall(r"(?s)<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|</table>)", markup):
        cells = re.findall(r"(?s)<td\b([^>]*)>(.*?)(?=</td>|<td\b|$)", row)
        span = lambda attrs, name: int(m[1]) if (m := re.search(rf'{name}\s*=\s*"?(\d+)', attrs)) else 1
        rows.append([(span(a, "rowspan"), span(a, "colspan"), re.sub(r"<br\s*/?>", "\n", t).strip()) for a, t in cells])
    return table_grid(rows)


# Kernels as DataFrame operators


def by_page(rows: DataFrame, key: str, columns: list[str], schema: str, kernel) -> DataFrame:
    """Runs a kernel on each page's columns: a list of arrays in, a list of arrays out, the key put in front.

    Pages are brought together by one shuffle and sorted, and a batch then holds many of them: a page costs no more than its kernel.
    Only a page that a batch cuts is held over, so memory is bounded by the largest page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = table.column(0).to_numpy()
            arrays = [table.column(c).to_numpy() for c in columns]
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            found = [kernel(*part) for part in zip(*(np.split(x, cuts) for x in arrays), strict=True)]
            sizes = [len(f[0]) for f in found]
            first = keys[np.concatenate([[0], cuts])]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(first, sizes)), *(pa.array(np.concatenate(c)) for c in zip(*found, strict=True))], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            keys = batch.column(0).to_numpy()
            if keys[0] == keys[-1]:  # the page may go on
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            yield from flush(pa.Table.from_batches([*held[:-1], batch.slice(0, last)]))
            held = [batch.slice(last)]
        if held:
            yield from flush(pa.Table.from_batches(held))

    names = [key, *(c.split(" ")[0] for c in schema.split(", "))]
    own = rows.select(F.col(key).cast("long").alias(key), *columns).where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *columns)
    return own.mapInArrow(run, f"{key} long, {schema}")


def clustered(boxes: DataFrame, key: str, gap: float = 10.0) -> DataFrame:
    """The envelopes of each page's boxes that lie within a gap of each other: key, ordinal, sides and n."""

    def run(*sides: np.ndarray) -> list[np.ndarray]:
        found, counts = closure(np.stack(sides, axis=1), gap)
        return [np.arange(1, len(found) + 1), *found.T, counts]

    return by_page(boxes, key, SIDES, "ordinal long, x0 double, y0 double, x1 double, y1 double, n long", run)


def in_rows(boxes: DataFrame, key: str) -> DataFrame:
    """Each box with the number of its row, from 1."""

    def run(ids: np.ndarray, *sides: np.ndarray) -> list[np.ndarray]:
        return [ids, row_numbers(np.stack(sides, axis=1)) + 1]

    return by_page(boxes, key, ["box_id", *SIDES], "box_id long, row long", run)


def matched(edges: DataFrame, key: str) -> DataFrame:
    """Greedy one-to-one matches of each page from rows (key, gt_id, prediction_id, iou)."""

    def run(gt: np.ndarray, found: np.ndarray, iou: np.ndarray) -> list[np.ndarray]:
        rows = greedy_matches(list(zip(iou.tolist(), gt.tolist(), found.tolist(), strict=True)))
        return [np.array([r[i] for r in rows], kind) for i, kind in enumerate((object, object, float))]

    return by_page(edges, key, ["gt_id", "prediction_id", "iou"], "gt_id string, prediction_id string, iou double", run)


def _mapped(kind: str, function):
    """An Arrow-batched column function; nulls stay null."""

    @F.pandas_udf(kind)
    def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([None if any(v is None for v in row) else function(*row) for row in zip(*columns, strict=True)], dtype=object)

    return apply


def edit_struct(reference: Column, actual: Column) -> Column:
    """Substitutions, deletions, insertions and distance as a struct."""

    @F.pandas_udf("substitutions long, deletions long, insertions long, distance long")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            rows = [edit_counts(x or "", y or "") for x, y in zip(a, b, strict=True)]
            yield pd.DataFrame([(*r, sum(r)) for r in rows], columns=["substitutions", "deletions", "insertions", "distance"], dtype="int64")

    return apply(reference, actual)


def similarity(a: Column, b: Column) -> Column:
    """The ratio of matching characters of two texts."""
    return _mapped("double", lambda x, y: SequenceMatcher(None, x, y).ratio())(a, b)


def abnormal_text(c: Column) -> Column:
    """:func:`abnormal` of a column, in one pass of a pattern."""
    return c.rlike(r"[\x{FFFD}\p{C}\p{Z}&&[^ \r\n\t]]")


def _unary(kind: str, function):
    @F.pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series([None if v is None else function(v) for v in column], dtype=object)

    return apply


def mapped_text(kind: str, function, c: Column) -> Column:
    """A function of each text, null for null: for rules that built-in functions can't express."""
    return _unary(kind, function)(c)


def json_shape(c: Column) -> Column:
    """The shape of a JSON text, as JSON with sorted keys; null for other texts."""

    def read(text: str) -> str | None:
        try:
            return json.dumps(shape(json.loads(text)), sort_keys=True)
        except ValueError:
            return None

    return _unary("string", read)(c)


def json_without_media(c: Column) -> Column:
    """A JSON text without media; null for other texts."""

    def read(text: str) -> str | None:
        try:
            return json.dumps(without_media(json.loads(text)), sort_keys=True, ensure_ascii=False)
        except ValueError:
            return None

    return _unary("string", read)(c)


def best_regions(figures: np.ndarray, regions: np.ndarray, least: float = 0.45, ambiguity: float = 0.8) -> list[int | None]:
    """For each figure in order the unused region that it overlaps best, if it does enough and no other nearly as well."""
    used: set[int] = set()
    out: list[int | None] = []
    for f in figures:
        inner = np.maximum(np.minimum(f[2:], regions[:, 2:]) - np.maximum(f[:2], regions[:, :2]), 0).prod(axis=1) if len(regions) else np.empty(0)
        joint = (f[2:] - f[:2]).prod() + (regions[:, 2:] - regions[:, :2]).prod(axis=1) - inner if len(regions) else inner
        score = np.where(joint > 0, inner / np.where(joint > 0, joint, 1), 0.0)
        order = np.argsort(-score, kind="stable")
        best = int(order[0]) if len(order) else -1
        clear = len(order) and score[best] >= least and (len(order) < 2 or score[order[1]] <= ambiguity * score[best])
        if clear and best not in used:
            used.add(best)
            out.append(best)
        else:
            out.append(None)
    return out


def grid_columns(boxes: np.ndarray) -> int | None:
    """Columns of a grid of figures given in reading order; None where the order differs or a row but the last is short."""
    rows = row_numbers(boxes)
    order = np.lexsort((boxes[:, 0], rows))
    counts = np.bincount(rows)
    regular = (order == np.arange(len(boxes))).all() and (counts[:-1] == counts.max()).all()
    return int(counts.max()) if regular else None


def component_numbers(units: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units that share parts, by whatever chain, get one number: the distinct units and their components' least units."""
    names, unit = np.unique(units, return_inverse=True)
    part = np.unique(parts, return_inverse=True)[1]
    label = np.arange(len(names))
    while True:
        least = np.full(part.max(initial=-1) + 1, len(names))
        np.minimum.at(least, part, label[unit])
        fresh = label.copy()
        np.minimum.at(fresh, unit, least[part])
        if (fresh == label).all():
            return names, names[label]
        label = fresh

"""Benchmark decontamination: each shard of documents gets an FM-index, in which benchmark phrases are looked up."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, filesystem, new_dir
from .fm_index import FMIndex

#: Bytes of text in a shard.
SHARD = 6 << 20

#: Bytes of benchmark text in a block, on average; a task holds one block at a time.
BLOCK = 16 << 20

#: A word is a run of digits, letters a-z and bytes above 127 after A-Z are lowered; all other bytes are spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

#: Occurrences located at a time.
MOST = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as bytes."""
    return (text or "").encode().translate(WORD_BYTES).split()


class Phrases:
    """The distinct windows of the benchmark's items as rows of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.ids: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[int]] = {}
        self.names = [name for name, _ in items]
        for k, (_, text) in enumerate(items):
            own = [self.ids.setdefault(w, len(self.ids) + 2) for w in words_of(text)]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                seen.setdefault(tuple(own[i : i + window]), set()).add(k)
        self.lengths = np.array([len(p) for p in seen], np.int64)
        self.rows = np.zeros((len(seen), window), np.int64)
        for i, p in enumerate(seen):
            self.rows[i, : len(p)] = p
        self.items = np.array(list(chain.from_iterable(seen.values())), np.int64)
        self.starts = np.cumsum([0, *map(len, seen.values())])
        self.shortest = int(self.lengths.min(initial=window))


class Shard:
    """The words of some documents, indexed.

    Words that no phrase holds are one symbol, and of neighbouring ones a single mark stays, as does one for a stretch of
    phrase words that is shorter than any phrase: no phrase can occur there, so nothing is lost. ``place`` leads
    back to the word in its document.
    """

    def __init__(self, texts: list[str | None], phrases: Phrases):
        ids = phrases.ids
        words = [words_of(t) for t in texts]
        self.counts = np.array([len(w) for w in words], np.int64)
        total = int(self.counts.sum())
        symbols = np.fromiter(map(ids.get, chain.from_iterable(words), repeat(1)), np.int64, total)
        del words
        ends = np.cumsum(self.counts)
        starts = ends - self.counts
        place = np.arange(total) - np.repeat(starts, self.counts)
        doc = np.repeat(np.arange(len(texts)), self.counts)
        known = symbols > 1
        first = known.copy()
        first[1:] &= ~known[:-1] | (doc[1:] != doc[:-1])
        run = np.cumsum(first) - 1
        sizes = np.bincount(run[known], minlength=1) if known.any() else np.zeros(1, np.int64)
        kept = np.flatnonzero(known & (sizes[np.maximum(run, 0)] >= phrases.shortest))
        marks = np.concatenate([[False], (run[kept][1:] != run[kept][:-1])]) if len(kept) else np.zeros(0, bool)
        at = np.arange(len(kept)) + np.cumsum(marks)
        size = int(at[-1]) + 1 if len(kept) else 0
        self.symbols = np.ones(size, np.int64)
        self.doc, self.place = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.symbols[at], self.doc[at], self.place[at] = symbols[kept], doc[kept], place[kept]

    def matches(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Hit flags of the shard's symbols, and the distinct (document, item) pairs as rows."""
        hit = np.zeros(len(self.symbols) + 1, np.int64)
        pairs: list[np.ndarray] = []
        if len(self.symbols) and len(phrases.lengths):
            index = FMIndex(self.symbols)
            lo, hi = index.search(phrases.rows, phrases.lengths)
            found = np.flatnonzero(hi > lo)
            sizes = np.cumsum(hi[found] - lo[found])
            cuts = np.searchsorted(sizes, np.arange(MOST, int(sizes[-1]) + MOST if len(sizes) else 0, MOST), side="right") if len(sizes) else []
            for part in np.split(found, np.unique(cuts)):
                for a, b, p in _spread(lo[part], hi[part], part):
                    at = index.locate(_ranges(a, b))
                    phrase = np.repeat(p, b - a)
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + phrases.lengths[phrase], -1)
                    owners = np.unique(self.doc[at] * len(phrases.lengths) + phrase)
                    doc, phrase = np.divmod(owners, len(phrases.lengths))
                    n = phrases.starts[phrase + 1] - phrases.starts[phrase]
                    items = phrases.items[_ranges(phrases.starts[phrase], phrases.starts[phrase + 1])]
                    pairs.append(np.unique(np.repeat(doc, n) * len(phrases.names) + items))
        owners = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        return np.cumsum(hit)[:-1] > 0, np.stack(np.divmod(owners, max(1, len(phrases.names))), axis=1)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [lo, hi) in a row."""
    n = hi - lo
    return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)


def _spread(lo: np.ndarray, hi: np.ndarray, phrase: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ranges, with any of over MOST rows in pieces of its own."""
    small = hi - lo <= MOST
    if small.any():
        yield lo[small], hi[small], phrase[small]
    for a, b, p in zip(lo[~small], hi[~small], phrase[~small], strict=True):
        for x in range(int(a), int(b), MOST):
            yield np.array([x]), np.array([min(x + MOST, int(b))]), np.array([p])


def word_spans(hit_words: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of consecutive word numbers, ends exclusive."""
    if not len(hit_words):
        return []
    cuts = np.flatnonzero(np.diff(hit_words) > 1) + 1
    return [(int(r[0]), int(r[-1]) + 1) for r in np.split(hit_words, cuts)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The words of each document that lie in an occurrence of a benchmark window, merged to spans.

    Words are runs of digits, letters and all non-ASCII characters after A-Z are lowered. A window is ``window`` consecutive
    words of an item, or all words of a shorter item. Returns a row per document: the key, the columns
    named in ``keep``, n_words, spans (word numbers, end exclusive; adjoining hits are one span) and items (their ids
    as strings, in order). Null and empty
    texts have no words, spans or items; items without words never occur; the words of items without an id are found, but name no
    item; an empty benchmark finds nothing; repeated rows are judged each; items that repeat an id count once. No row moves:
    the benchmark's distinct items are written to the shared folder in blocks of bounded size, and a task reads one block after another for each
    of its shards. Nothing of the benchmark reaches the driver.
    """
    spark = docs.sparkSession
    held = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null").distinct()
    total = held.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).cast("long")).first()[0]
    blocks = max(1, -(-total // BLOCK))
    uri = f"{new_dir(spark, 'benchmark')}/items"
    held.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))).repartition(int(min(blocks, 4096)), "block").write.partitionBy("block").parquet(uri)
    extra = {f"keep_{i}": c for i, c in enumerate(keep)}
    own = docs.select(F.col(text).alias("text"), F.col(key).alias("key"), *(F.col(c).alias(n) for n, c in extra.items()))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name != "text"]
    schema = ", ".join([*kinds, "spans array<struct<start: long, end: long>>", "items array<string>", "n_words long"])
    out = own.mapInArrow(_matcher(uri, window), schema)
    return out.select(F.col("key").alias(key), *(F.col(n).alias(c) for n, c in extra.items()), "n_words", "spans", "items")


@lru_cache(maxsize=1)
def _phrases(uri: str, window: int) -> Phrases:
    """The phrases of one block of the benchmark; a worker keeps the last one."""
    fs, path = filesystem(uri)
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet")]
    rows = [r for f in files for r in pq.ParquetFile(fs.open_input_file(f)).read(["item", "text"]).to_pylist()]
    return Phrases([(r["item"], r["text"]) for r in rows], window)


def _matcher(uri: str, window: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(uri)
        blocks = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(path)) if f.base_name.startswith("block="))
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in by_bytes(batches, "text", SHARD):
            texts = batch.column("text").to_pylist()
            hits: list[tuple[np.ndarray, np.ndarray]] = []
            items: list[set[str]] = [set() for _ in texts]
            counts = None
            for block in blocks:
                phrases = _phrases(f"{uri}/{block}", window)
                shard = Shard(texts, phrases)
                counts = shard.counts
                hit, pairs = shard.matches(phrases)
                hits.append((shard.doc[hit], shard.place[hit]))
                for d, k in pairs.tolist():
                    if phrases.names[k] is not None:
                        items[d].add(phrases.names[k])
            if counts is None:
                counts = np.array([len(words_of(t)) for t in texts], np.int64)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            del columns["text"]
            columns |= {"spans": pa.array(_merged(hits, len(texts)), spans_type), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())), "n_words": pa.array(counts)}
            yield pa.RecordBatch.from_pydict(columns)

    return match


def _merged(hits: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[list[dict]]:
    """The spans of each of n documents from the hit words that the blocks found: documents and word numbers."""
    spans: list[list[dict]] = [[] for _ in range(n)]
    if hits:
        doc, place = (np.concatenate([h[i] for h in hits]) for i in range(2))
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        owners, firsts = np.unique(doc, return_index=True)
        for d, own in zip(owners, np.split(place, firsts[1:]), strict=False):
            spans[d] = [{"start": a, "end": b} for a, b in word_spans(np.unique(own))]
    return spans


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated: hit words make at least a twentieth of all."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)}).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    spaced = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], spaced, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*parts, raw[at:]]).decode()

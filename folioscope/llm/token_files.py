"""Token-ID output: flat files of unsigned integers with 64-bit document offsets.

A dataset is a folder of parts. A part holds a contiguous range of the documents in ascending ``doc_id`` order, as
``<part>.bin``, the ids of all its documents in a row (16 bits each where the vocabulary allows, else 32), and
``<part>.idx``, little-endian 64-bit integers: the n document ids, then n + 1 offsets in ids from the part's start.
``manifest.json`` lists the parts that count, in order, with the prefix sums of their documents and ids; a part that a
lost task left behind is in no manifest. Readers map the files into memory.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, filesystem, local_path
from .encoding import encoder, spec_of

#: Bytes of text encoded at a time.
BLOCK = 4 << 20


@dataclass(frozen=True)
class Part:
    """One part's place and sizes; nulls: leading documents without an id; bases: documents and ids before it."""

    name: str
    docs: int
    tokens: int
    nulls: int
    doc_base: int = 0
    token_base: int = 0


class TokenFiles:
    """Random access to a dataset's documents by their place."""

    def __init__(self, uri: str):
        self.uri = uri
        fs, path = filesystem(f"{uri}/manifest.json")
        with fs.open_input_stream(path) as f:
            manifest = json.loads(f.read())
        self.dtype = np.dtype(manifest["dtype"])
        self.parts = [Part(**p) for p in manifest["parts"]]
        self.bases = np.array([p.doc_base for p in self.parts], dtype=np.int64)
        self.opened: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return sum(p.docs for p in self.parts)

    def part(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document ids, offsets and ids of a part."""
        if k not in self.opened:
            self.opened[k] = open_part(self.uri, self.parts[k], self.dtype)
        return self.opened[k]

    def __getitem__(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        k = int(np.searchsorted(self.bases, i, side="right")) - 1
        while not self.parts[k].docs:
            k -= 1
        _, offsets, ids = self.part(k)
        j = i - self.parts[k].doc_base
        return ids[offsets[j] : offsets[j + 1]]


def open_part(uri: str, part: Part, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A part's document ids, offsets and ids: mapped into memory where the folder is mounted, else read."""

    def load(suffix: str, kind: np.dtype, n: int) -> np.ndarray:
        name = f"{uri}/{part.name}.{suffix}"
        if not n:
            return np.empty(0, kind)
        if path := local_path(name):
            return np.memmap(path, dtype=kind, mode="r", shape=(n,))
        fs, path = filesystem(name)
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read(), dtype=kind)

    index = load("idx", np.dtype("<i8"), 2 * part.docs + 1)
    return index[: part.docs], index[part.docs :], load("bin", dtype, part.tokens)


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> list[Part]:
    """Encodes each whole text, appends ``end_id``, and writes the parts and the manifest below ``uri``.

    Null texts are empty: they hold the end id alone. Rows without a key come first; rows that repeat a key are all
    written, in any order. An empty table gives a manifest without documents. Other columns are not read. One shuffle by ranges of the
    key; a task holds one block of text and 16 bytes a document, and the driver one line a part.
    """
    spark = docs.sparkSession
    spec = spec_of(tokenizer)
    held = spark.sparkContext.broadcast(spec)
    vocabulary = json.loads(spec)
    top = max([end_id, *vocabulary["model"]["vocab"].values(), *(x["id"] for x in vocabulary["added_tokens"])])
    dtype = "<u2" if top < 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        fs, path = filesystem(f"{uri}/{name}")
        enc, end, wide = None, np.array([end_id], "<u4").tobytes(), np.dtype("<u4")
        keys, counts, nulls, out = [], [], 0, None
        for batch in by_bytes(batches, "text", BLOCK):
            enc = enc or encoder(held.value)
            out = out or fs.open_output_stream(f"{path}.bin")
            ids = [x + end for x in enc.encode(batch.column("text").to_pylist())]
            out.write(np.frombuffer(b"".join(ids), wide).astype(dtype).tobytes())
            counts.append(np.array([len(x) // 4 for x in ids], np.int64))
            keys.append(batch.column("key").fill_null(0).to_numpy(zero_copy_only=False))
            nulls += batch.column("key").null_count
        if out is None:
            return
        out.close()
        enc.trim()
        counts = np.concatenate(counts)
        with fs.open_output_stream(f"{path}.idx") as f:
            f.write(np.concatenate([*keys, [0], np.cumsum(counts)]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "name": [name], "docs": [len(counts)], "tokens": [int(counts.sum())], "nulls": [nulls]})

    ranged = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key")
    rows = ranged.mapInArrow(write, "part long, name string, docs long, tokens long, nulls long").collect()
    parts, doc_base, token_base = [], 0, 0
    for r in sorted(rows, key=lambda r: r["part"]):
        parts.append(Part(r["name"], r["docs"], r["tokens"], r["nulls"], doc_base, token_base))
        doc_base, token_base = doc_base + r["docs"], token_base + r["tokens"]
    fs, path = filesystem(f"{uri}/manifest.json")
    with fs.open_output_stream(path) as f:
        f.write(json.dumps({"dtype": dtype, "end_id": end_id, "documents": doc_base, "tokens": token_base, "parts": [asdict(p) for p in parts]}).encode())
    return parts


def read_tokens(spark: SparkSession, uri: str, digest: bool = False) -> DataFrame:
    """The documents of a dataset: doc_id, start, n_tokens and their ids, or with ``digest`` the ids' CRC-32.

    ``start`` counts the ids of all documents before, over all parts; the checksum is over 32-bit little-endian ids.
    """
    files = TokenFiles(uri)
    parts, dtype = files.parts, files.dtype
    last = pa.field("ids_crc32", pa.int64()) if digest else pa.field("ids", pa.list_(pa.int64()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            keys, offsets, ids = open_part(uri, parts[k], dtype)
            for lo in range(0, parts[k].docs, 4096):
                hi = min(lo + 4096, parts[k].docs)
                at = np.asarray(offsets[lo : hi + 1])
                block = np.asarray(ids[at[0] : at[-1]]).astype("<u4")
                own = [block[a:b] for a, b in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]
                found = [None if i < parts[k].nulls else int(x) for i, x in enumerate(keys[lo:hi], lo)]
                out = pa.array([zlib.crc32(x) for x in own], pa.int64()) if digest else pa.array([x.astype(np.int64) for x in own], last.type)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(at[:-1] + parts[k].token_base), pa.array(np.diff(at)), out], schema=schema)

    n = len(parts)
    return spark.range(0, n, 1, max(1, min(n, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(read, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<long>'}")

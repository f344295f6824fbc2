"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

One network reads forwards and one backwards, and their two states at a byte give the probability of each language at
that byte; a document's probabilities are the means over all its bytes. Long texts are read in parts, side by side; before its
part each network reads the bytes that lead up to it, so that no byte but a text's first and last is judged without context.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes

#: Bytes that a network reads in a row, in training and afterwards, and how many of them only lead up to a part.
WINDOW, LEAD = 256, 32

#: Parts read at a time, divided by the number of languages: their states stay in the processor's cache.
BATCH = 4096

#: Bytes of text held at a time.
BLOCK = 4 << 20

#: The sample that is learned from: documents of a language and of all, the least of a language, and windows of a document.
SAMPLE_DOCS, SAMPLE_TOTAL, SAMPLE_LEAST, SAMPLE_WINDOWS = 256, 16_384, 8, 6

#: Languages whose numbers of documents come to the rows, the largest ones; of all others every row competes for the sample.
MOST_LARGE = 1 << 14


@dataclass
class Direction:
    """One reading direction: input rows for each byte, recurrent weights, and output weights."""

    inputs: np.ndarray  # 256 x 3H: update, reset, candidate
    recurrent: np.ndarray  # H x 3H
    output: np.ndarray  # H x K

    @staticmethod
    def new(rng: np.random.Generator, hidden: int, kinds: int) -> Direction:
        scale = 1 / np.sqrt(hidden)
        draw = lambda *shape: rng.uniform(-scale, scale, shape).astype(np.float32)
        return Direction(draw(256, 3 * hidden), draw(hidden, 3 * hidden), draw(hidden, kinds))

    def arrays(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.output]

    def states(self, symbols: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """States after each step, and what the gradient needs; symbols: steps x windows."""
        hidden = self.recurrent.shape[0]
        h = np.zeros((symbols.shape[1], hidden), np.float32)
        out, kept = np.empty((*symbols.shape, hidden), np.float32), []
        for t, row in enumerate(symbols):
            x, u = self.inputs[row], h @ self.recurrent
            gates = 0.5 + 0.5 * np.tanh(0.5 * (x[:, : 2 * hidden] + u[:, : 2 * hidden]))
            z, r = gates[:, :hidden], gates[:, hidden:]
            n = np.tanh(x[:, 2 * hidden :] + r * u[:, 2 * hidden :])
            kept.append((h, z, r, n, u[:, 2 * hidden :]))
            h = n + z * (h - n)
            out[t] = h
        return out, kept

    def gradients(self, symbols: np.ndarray, kept: list[tuple], given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the input and recurrent weights, back through time, for gradients given at each state."""
        hidden = self.recurrent.shape[0]
        inputs, recurrent = np.zeros_like(self.inputs), np.zeros_like(self.recurrent)
        dh, steps = np.zeros_like(given[0]), np.empty((*symbols.shape, 3 * hidden), np.float32)
        for t in range(len(symbols) - 1, -1, -1):
            h, z, r, n, un = kept[t]
            dh = dh + given[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            dx = np.concatenate([dz, dr, dn], axis=1)
            du = np.concatenate([dz, dr, dn * r], axis=1)
            steps[t] = dx
            recurrent += h.T @ du
            dh = dh * z + du @ self.recurrent.T
        flat, rows = symbols.ravel(), steps.reshape(-1, 3 * hidden)
        for k in range(3 * hidden):
            inputs[:, k] = np.bincount(flat, rows[:, k], 256)
        return inputs, recurrent

    def scores(self, symbols: np.ndarray, skip: int = 0) -> np.ndarray:
        """Output scores after each step from a given one, without what training needs: steps x languages x windows.

        Update, reset and candidate are planes of their own, so that all arithmetic goes over unbroken memory. Gates are kept at
        twice their value, with halved weights beside them; halves of floats are exact.
        """
        hidden, n = self.recurrent.shape[0], symbols.shape[1]
        inputs, weights = (np.ascontiguousarray(a.reshape(-1, 3, hidden).transpose(1, 0, 2)) for a in (self.inputs, self.recurrent))
        inputs[:2] *= 0.5
        weights *= 0.5
        output = np.ascontiguousarray(self.output.T)
        h, out = np.zeros((n, hidden), np.float32), np.empty((len(symbols) - skip, len(output), n), np.float32)
        x, u = np.empty((3, n, hidden), np.float32), np.empty((3, n, hidden), np.float32)
        gates, (update, reset, new), own = x[:2], x, u[2]
        for t, row in enumerate(symbols.astype(np.intp)):
            for table, plane in zip(inputs, x, strict=True):
                np.take(table, row, axis=0, out=plane, mode="clip")  # unchecked: bytes fit
            np.matmul(h, weights, out=u)
            gates += u[:2]
            np.tanh(gates, out=gates)
            gates += 1
            own *= reset
            new += own
            np.tanh(new, out=new)
            h -= new
            h *= update
            h *= 0.5
            h += new
            if t >= skip:
                np.matmul(output, h.T, out=out[t - skip])
        return out


class Network:
    """The two directions, the languages' names and their biases."""

    def __init__(self, names: list[str], hidden: int, rng: np.random.Generator):
        self.names = names
        self.forward, self.backward = (Direction.new(rng, hidden, len(names)) for _ in range(2))
        self.bias = np.zeros(len(names), np.float32)

    def train(self, windows: np.ndarray, labels: np.ndarray, rng: np.random.Generator, steps: int = 300, batch: int = 192, rate: float = 0.012) -> None:
        """Adam on the cross entropy of the language at each byte of whole windows, a row each."""
        own = [*self.forward.arrays(), *self.backward.arrays(), self.bias]
        first, second = [np.zeros_like(a) for a in own], [np.zeros_like(a) for a in own]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), batch)
            ahead = np.ascontiguousarray(windows[pick].T)
            back = ahead[::-1]
            hf, kf = self.forward.states(ahead)
            hb, kb = self.backward.states(back)
            scores = hf @ self.forward.output + (hb @ self.backward.output)[::-1] + self.bias
            scores -= scores.max(axis=2, keepdims=True)
            p = np.exp(scores)
            p /= p.sum(axis=2, keepdims=True)
            p[:, np.arange(batch), labels[pick]] -= 1
            p /= p.shape[0] * batch
            flat = p.reshape(-1, p.shape[2])
            turned = np.ascontiguousarray(p[::-1])
            gf = self.forward.gradients(ahead, kf, p @ self.forward.output.T)
            gb = self.backward.gradients(back, kb, turned @ self.backward.output.T)
            grads = [*gf, hf.reshape(len(flat), -1).T @ flat, *gb, hb.reshape(len(flat), -1).T @ turned.reshape(len(flat), -1), flat.sum(axis=0)]
            now = rate * (1 - step / (steps + 1))
            for a, g, m, v in zip(own, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The mean over all bytes of each text of the languages' probabilities; zeros for an empty text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        step = WINDOW - LEAD
        per = -(-sizes // step)
        owner = np.repeat(np.arange(len(texts)), per)
        ends = np.cumsum(sizes)
        first, past = (ends - sizes)[owner], ends[owner]
        start = first + (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * step
        length = np.minimum(past - start, step)
        lead = np.minimum(start - first, LEAD)  # bytes read before the part, and after it by the other network
        tail = np.minimum(past - start - length, LEAD)
        buffer = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
        total = np.zeros((len(texts), len(self.names)), np.float64)
        order = np.lexsort((tail, lead, -length))
        steps = np.arange(WINDOW)[:, None]
        batch = max(16, BATCH // max(4, len(self.names)))
        # parts that are alike in all sizes are read without regard to single ones
        kind = (length * WINDOW + lead) * WINDOW + tail
        turns = np.flatnonzero(np.concatenate([[True], kind[order][1:] != kind[order][:-1], [True]])) if len(order) else np.zeros(0, np.int64)
        cuts = {0, len(order)}
        for a, b in zip(turns[:-1].tolist(), turns[1:].tolist(), strict=True):
            if b - a >= batch // 4:
                cuts |= {a, b}
        cuts = sorted(cuts)
        spans = [(i, min(i + batch, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for i in range(a, b, batch)]
        for lo, hi in spans:
            own = order[lo:hi]
            at, n, before, after = start[own], length[own], lead[own], tail[own]
            most = int(n.max())
            far, back = int((n + before).max()), int((n + after).max())
            forth, turned = at - before + steps[:far], np.maximum(at + n + after - 1 - steps[:back], 0)
            if kind[own[0]] == kind[own[-1]]:
                scores = self.forward.scores(buffer[forth], int(before[0]))
                scores += self.backward.scores(buffer[turned], int(after[0]))[::-1]
            else:
                # the networks' places of each byte of the part
                there, here = np.minimum(before + steps[:most], far - 1), np.maximum(n + after - 1 - steps[:most], 0)
                scores = np.take_along_axis(self.forward.scores(buffer[forth]), there[:, None], axis=0)
                scores += np.take_along_axis(self.backward.scores(buffer[turned]), here[:, None], axis=0)
            scores += self.bias[:, None]
            scores -= scores.max(axis=1, keepdims=True)
            np.exp(scores, out=scores)
            scores /= scores.sum(axis=1, keepdims=True)
            if n.min() < most:
                scores *= (steps[:most] < n)[:, None]
            np.add.at(total, owner[own], scores.sum(axis=0).T)
        return total / np.maximum(sizes, 1)[:, None]


def training_windows(rows: list[tuple[bytes, str]], names: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows of one size and their languages: a piece may lose up to three of its first bytes, as parts of texts do, and repeats where it is short."""
    windows, labels = [], []
    for piece, lang in rows:
        cut = int(rng.integers(0, min(3, max(0, len(piece) - WINDOW)) + 1))
        windows.append(np.resize(np.frombuffer(piece[cut : cut + WINDOW], np.uint8), WINDOW))
        labels.append(names.index(lang))
    return np.array(windows, np.uint8).reshape(-1, WINDOW), np.array(labels, np.int64)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", hidden: int = 12, seed: int = 7) -> Network | None:
    """Trains on a bounded sample of the labelled rows: those of each language with the least hashes of their keys.

    Each language gives SAMPLE_DOCS documents, fewer if all would give over SAMPLE_TOTAL, but SAMPLE_LEAST at least; all that are there
    if it has fewer. Of each document up to SAMPLE_WINDOWS pieces from anywhere in its whole text reach the driver. Every
    language that labels a text with a letter is learned. Null keys, texts and languages are left out; None without any labelled text that has a letter.
    """
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null and key is not null")
    counts = own.groupBy("lang").agg(F.count("*").alias("n"))
    kinds = counts.count()
    if not kinds:
        return None
    most = max(SAMPLE_LEAST, min(SAMPLE_DOCS, SAMPLE_TOTAL // kinds))
    # of large languages a few times the share that is wanted, by hash, of which the least are taken
    large = F.broadcast(counts.where(F.col("n") > 3 * most).orderBy(F.desc("n"), "lang").limit(MOST_LARGE))
    spot = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("language sample")), F.lit(1 << 30))
    chosen = F.col("n").isNull() | (F.col("spot") * F.col("n") < F.lit(3.0 * most * (1 << 30)))
    near = own.withColumn("spot", spot).join(large, "lang", "left").where(chosen).where(F.col("text").rlike(r"\p{L}"))
    # pieces from anywhere in the text, chosen by hash
    pieces = F.least(F.lit(SAMPLE_WINDOWS), F.floor(F.length("text") / WINDOW) + 1).cast("int")
    spots = F.transform(F.sequence(F.lit(1), pieces), lambda i: F.pmod(F.xxhash64("key", i), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))))
    cut = near.select("lang", "spot", "key", F.transform(spots, lambda p: F.encode(F.substring("text", (p + 1).cast("int"), F.lit(WINDOW)), "UTF-8")).alias("pieces"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("spot", "key", "pieces"))
    least = cut.withColumn("place", place).where(F.col("place") <= most)
    rows = [(bytes(piece), r["lang"]) for r in sorted(least.collect(), key=lambda r: (r["lang"], r["place"])) for piece in r["pieces"]]
    names = sorted({lang for _, lang in rows})
    if not names:
        return None
    rng = np.random.default_rng(seed)
    network = Network(names, hidden, rng)
    windows, labels = training_windows(rows, names, rng)
    network.train(windows, labels, rng)
    return network


def held_out(key: str = "doc_id") -> F.Column:
    """Whether a row is kept from training: its key's CRC-32 leaves 1 when divided by 3; rows without a key aren't."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The language of each whole text: the key, the columns in ``keep``, lang_pred and score.

    Null, empty and letterless texts are ``und`` with score 0, as are all without a network. Repeated rows are judged each,
    an empty table gives none, and columns not named aren't read. No row moves.
    """
    extra = {f"keep_{i}": c for i, c in enumerate(keep)}
    own = docs.select(F.col(text).alias("text"), F.col(key).alias("key"), *(F.col(c).alias(n) for n, c in extra.items()))
    held = docs.sparkSession.sparkContext.broadcast(network)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = held.value
        for batch in by_bytes(batches, "text", BLOCK):
            texts = batch.column("text").to_pylist()
            asked = [i for i, t in enumerate(texts) if network and t and any(map(str.isalpha, t))]
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if asked:
                p = network.pooled([texts[i].encode() for i in asked])
                best = p.argmax(axis=1)
                scores[asked] = np.clip(p[np.arange(len(asked)), best], 0, 1)
                for i, k in zip(asked, best, strict=True):
                    names[i] = network.names[k]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            del columns["text"]
            yield pa.RecordBatch.from_pydict(columns | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)})

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name != "text"]
    found = own.mapInArrow(judge, ", ".join([*kinds, "lang_pred string", "score double"]))
    return found.select(F.col("key").alias(key), *(F.col(n).alias(c) for n, c in extra.items()), "lang_pred", "score")

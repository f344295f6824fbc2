"""Token counts by greedy longest-match word pieces, read off a linear-time automaton that builds no pieces.

The vocabulary's trie gets a failure link at each node: where reading can't go on there, some whole tokens are done
(their number is precomputed) and reading goes on at the node of what is left over. Each byte moves down once and
failure links only move up, so a word takes linear time whatever its length.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes
from .encoding import byte_letters, spec_of

#: Bytes of text held at a time, and words whose counts a worker keeps, of at most so many bytes each.
BLOCK, MOST_WORDS, LONGEST = 4 << 20, 300_000, 64


class Automaton:
    """Counts the pieces that greedy longest match cuts a byte string into.

    Bytes that start no token make a string unmatchable; with all single bytes in the vocabulary there are none.
    """

    def __init__(self, tokens: Iterable[bytes]):
        self.next: dict[int, int] = {}  # node * 256 + byte
        final, children = [False], [[]]
        for token in tokens:
            node = 0
            for byte in token:
                key = node * 256 + byte
                if key not in self.next:
                    self.next[key] = len(final)
                    children[node].append((byte, len(final)))
                    final.append(False)
                    children.append([])
                node = self.next[key]
            final[node] = node > 0
        self.fail: list[int] = [-1] * len(final)  # -1: nothing ends here
        self.popped = [0] * len(final)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in children[parent]:
                queue.append(node)
                if final[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                back, done = self.fail[parent], self.popped[parent]
                while back >= 0 and back * 256 + byte not in self.next:
                    done += self.popped[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[node], self.popped[node] = self.next[back * 256 + byte], done

    def count(self, word: bytes) -> int | None:
        """The number of pieces; None where the vocabulary can't cover the word."""
        step, fail, popped = self.next.get, self.fail, self.popped
        node = total = 0
        for byte in word:
            while (to := step(node * 256 + byte)) is None:
                if fail[node] < 0:
                    return None
                total += popped[node]
                node = fail[node]
            node = to
        while node:
            if fail[node] < 0:
                return None
            total += popped[node]
            node = fail[node]
        return total


def vocabulary_bytes(spec: str) -> list[bytes]:
    """The tokens of a byte-level vocabulary as bytes; a space in front marks those that start a word."""
    back = {ord(c): b for b, c in byte_letters().items()}
    special = {x["content"] for x in json.loads(spec)["added_tokens"]}
    return [bytes(back[ord(c)] for c in token) for token in json.loads(spec)["model"]["vocab"] if token not in special]


class Counts(dict):
    """Pieces of each word, counted when first asked for; long words are counted each time."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.count = automaton.count

    def __missing__(self, word: str) -> int:
        raw = b" " + word.encode()
        n = self.count(raw)
        n = 1 if n is None else n
        if len(raw) <= LONGEST and len(self) < MOST_WORDS:
            self[word] = n
        return n


_made: dict[int, Counts] = {}


def counts_of(spec: str) -> Counts:
    """The worker's counts for a vocabulary."""
    if (key := hash(spec)) not in _made:
        _made.clear()
        _made[key] = Counts(Automaton(vocabulary_bytes(spec)))
    return _made[key]


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """n_words and n_tokens of each whole text: words are what white space separates, tokens their greedy pieces.

    The vocabulary is a byte-level one, whose tokens that start a word begin with a space; a word that it can't cover is one
    unknown token. Null, empty and blank texts have 0 of both; repeated rows are counted each; an empty table gives none; other
    columns aren't read. No row moves.
    """
    held = docs.sparkSession.sparkContext.broadcast(spec_of(tokenizer))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BLOCK):
            known = counts_of(held.value)
            words = [(t or "").split() for t in batch.column("text").to_pylist()]
            tokens = [sum(map(known.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(w) for w in words], pa.int64()), pa.array(tokens, pa.int64())], ["key", "n_words", "n_tokens"])

    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return own.mapInArrow(count, f"key {own.schema['key'].dataType.simpleString()}, n_words long, n_tokens long").withColumnRenamed("key", key)

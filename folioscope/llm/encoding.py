"""Token ids of whole texts by the tokenizers library, with each distinct chunk of text encoded once per worker."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable
from contextlib import suppress
from functools import lru_cache
from itertools import islice

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks, and pieces of them, that a worker has at hand, and that it keeps from one task to the next.
MOST_CHUNKS, MOST_PIECES, KEPT = 200_000, 300_000, 20_000

#: White space to Python's str and re but not to the tokenizers' patterns.
SEPARATORS = re.compile("[\x1c-\x1f]")

#: A byte-level pattern never joins what stands in different matches of this.
SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")

#: Below this, characters are in the same class for every library and are their own normal form.
PLAIN = "\u0250"

#: Marks that are a piece of their own after a word.
MARKS = frozenset(".,;:!?)")

# The pattern of byte-level pre-tokenizers.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one above 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Rule:
    """How a recognised tokenizer cuts text: into chunks at white space, and a plain chunk into the model's pieces."""

    def __init__(self, chunks: Callable[[str], list[str]], pattern: str, spaced: bool):
        self.chunks, self.spaced, self.lower, self.cut = chunks, spaced, not spaced, regex.compile(pattern).findall


def rule(spec: dict) -> Rule | None:
    """The rule by which a text's ids are those of its pieces in a row; None where that isn't known to hold.

    Two kinds are recognised: byte-level ones without a normalizer, whose pattern keeps a space only before a
    word, and ones whose normalizer works on single words and whose pattern drops white space.
    """
    steps = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is None and steps.get("type") == "ByteLevel" and steps.get("use_regex") and not steps.get("add_prefix_space"):
        return Rule(SPACED.findall, BYTE_LEVEL, True)
    normal = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    parts = steps.get("pretokenizers", [])
    if (
        normal == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in parts] == ["Split", "ByteLevel"]
        and parts[0]["behavior"] == "Removed"
        and parts[0]["invert"]
        and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"].get("Regex", "")
        and not parts[1]["add_prefix_space"]
        and not parts[1]["use_regex"]
    ):
        return Rule(str.split, parts[0]["pattern"]["Regex"], False)
    return None


def added_marks(spec: dict) -> set[str] | None:
    """Signs of which a text holds one wherever it names an added token, in any case; None if a token has no such signs."""
    marks = {re.match(r"[!-/:-@\[-`{-~]*", t["content"])[0] for t in spec.get("added_tokens") or ()}
    return None if "" in marks else marks


class Uneven(Exception):
    """White space other than single spaces and line ends."""


class Chunks(dict):
    """The ids of chunks, which are made when first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self.make(chunk)
        return ids


class Encoder:
    """Encodes texts to the library's ids, as little-endian 32-bit integers; special tokens in a text are theirs.

    The library's model encodes each distinct piece once; chunks and pieces are then looked up. Texts and chunks that the
    rule doesn't cover go through the whole tokenizer, as do texts that may name a token which was added to the model.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.rule = rule(json.loads(spec))
        self.added = added_marks(json.loads(spec))
        if self.added is None:
            self.rule = None
        self.letters = byte_letters()
        self.space = self.letters[32]
        self.small = Chunks(self.piece)
        self.known, self.before = Chunks(self.chunk), {}
        self.after, self.after_before = Chunks(self.word), {}  # words after a space, without it

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, encoded in one piece."""
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece(self, piece: str) -> bytes:
        """Ids of one of the model's pieces."""
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that isn't at hand."""
        if (ids := self.before.get(chunk)) is not None:
            return ids
        if not chunk.isascii() and max(chunk) >= PLAIN:
            return self.whole([chunk])[0]
        if self.rule.lower:
            chunk = chunk.lower()
        body, last = chunk[:-1], chunk[-1]
        if (body[1:] if body[:1] == " " else body).isalpha():  # a word, alone or with one mark after it
            if last.isalpha():
                return self.small[chunk]
            if last in MARKS:
                return self.small[body] + self.small[last]
        return b"".join(map(self.small.__getitem__, self.rule.cut(chunk)))

    def plain(self, word: str) -> bytes:
        """Ids of a space and a word of letters, which are one piece."""
        found = self.model.tokenize(self.space + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def word(self, word: str) -> bytes:
        """Ids of a space and a word that aren't at hand; a word of letters may have one mark after it."""
        ids = self.after_before.get(word)
        if ids is not None:
            return ids
        if word and (word.isascii() or max(word) < PLAIN):
            if word.isalpha():
                return self.plain(word)
            body, last = word[:-1], word[-1]
            if last in MARKS and body.isalpha():
                return self.after[body] + self.small[last]
        if not word or word != word.strip():
            raise Uneven
        return self.chunk(f" {word}")

    def lines(self, text: str) -> bytes:
        """Ids of a text whose words have one space or line end between, under a rule that keeps spaces."""
        known, after = self.known.__getitem__, self.after.__getitem__
        lines = []
        for line in text.split("\n"):
            first, *words = line.split(" ")
            if first[:1].isspace() or first[-1:].isspace():
                raise Uneven
            lines.append((known(first) if first else b"") + b"".join(map(after, words)))
        return known("\n").join(lines)

    def text(self, text: str) -> bytes:
        """Ids of a text that the rule covers."""
        if self.rule.spaced and "\n\n" not in text:
            with suppress(Uneven):
                return self.lines(text)
        return b"".join(map(self.known.__getitem__, self.rule.chunks(text)))

    def trim(self) -> None:
        """Lets go of all but the first words seen, which are the common ones; an idle worker then holds little."""
        for name in ("known", "after", "small"):
            table = getattr(self, name)
            if len(table) > KEPT:
                fresh = Chunks(table.make)
                fresh.update(islice(table.items(), KEPT))
                setattr(self, name, fresh)
        self.before, self.after_before = {}, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none for null."""
        texts = [t or "" for t in texts]
        if self.rule is None:
            return self.whole(texts)
        out: list[bytes] = []
        for text in texts:
            if SEPARATORS.search(text) or any(mark in text for mark in self.added):
                out += self.whole([text])
                continue
            out.append(self.text(text))
            if len(self.known) > MOST_CHUNKS:
                self.before, self.known = self.known, Chunks(self.chunk)
            if len(self.after) > MOST_CHUNKS:
                self.after_before, self.after = self.after, Chunks(self.word)
            if len(self.small) > MOST_PIECES:
                self.small = Chunks(self.piece)
        return out


@lru_cache(maxsize=4)
def encoder(spec: str) -> Encoder:
    """The worker's encoder for a tokenizer's JSON."""
    return Encoder(spec)


def spec_of(path: str) -> str:
    """A tokenizer file's JSON, which the driver sends to the executors; its size is that of one vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()

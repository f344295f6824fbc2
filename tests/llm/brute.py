"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PARTS = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def contamination(docs, items, size=13):
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows: dict[tuple, set[str]] = {}
    for name, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(name))
    out = []
    for key, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def shingles(text, width=5):
    w = PARTS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(docs, percent=85):
    """doc_id: (n_shingles, component_id), for keys that are there and differ."""
    sets = {k: shingles(t) for k, t in docs}
    label = {k: k for k in sets}
    keys = sorted(sets)
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(keys):
            for b in keys[:i]:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {k: (len(sets[k]), label[k]) for k in keys}


def secrets(text):
    """n_assign, n_access, n_hex and base_sha256."""
    text, spans = text or "", []
    for k, (pattern, fits) in enumerate(((ASSIGN, lambda m: len(m[2]) >= 6), (ACCESS, lambda m: len(m[0]) >= 20), (HEX, lambda m: len(m[0]) >= 24))):
        spans += [(m.start(), k, m.end()) for m in pattern.finditer(text) if fits(m)]
    names = ("assign", "access", "hex")
    joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest())


def repeats(docs, length):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    raw = [(k, (t or "").encode()) for k, t in docs]
    count = Counter(t[i : i + length] for _, t in raw for i in range(len(t) - length + 1))
    out = []
    for k, t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return out

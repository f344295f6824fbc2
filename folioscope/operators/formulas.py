"""A small LaTeX subset as a tree and as Office math; everything else is refused with a code."""

from __future__ import annotations

import json
import re
from xml.sax.saxutils import escape

# The commands that stand for a symbol, the signs that stand for themselves, and the limits.
SYMBOLS = {"neq": "≠", "leq": "≤", "geq": "≥", "times": "×", "cdot": "·", "pm": "±", "alpha": "α", "beta": "β", "theta": "θ", "pi": "π"}
SIGNS = set("+-=<>(),.[]|/:!")
MOST_TOKENS, MOST_DEPTH = 1024, 32

TOKEN = re.compile(r"\\[A-Za-z]+|\\.|\S")


class FormulaError(ValueError):
    """A formula that isn't supported; the message is a stable code."""


def tree(latex: str) -> list:
    """A formula as nested lists: runs of text, frac, sqrt, and sup, sub or subsup around a base."""
    tokens = TOKEN.findall(latex)
    if len(tokens) > MOST_TOKENS:
        raise FormulaError("FORMULA_TOO_COMPLEX")
    # Frames of open groups: their items, and the construct that awaits operands.
    frames: list[list] = [[]]
    waiting: list[list[tuple[str, int, list]]] = [[]]

    def put(item: list) -> None:
        """Gives an item to the innermost construct that awaits one, or to the row."""
        while waiting[-1]:
            name, need, have = waiting[-1][-1]
            have.append(item)
            if len(have) < need:
                return
            waiting[-1].pop()
            item = [name, *have]
            if name in ("sup", "sub"):
                script(name, have[0])
                return
        frames[-1].append(item)

    def script(name: str, value: list) -> None:
        base = frames[-1].pop()
        if base[0] == "scripted":
            if name in base[2]:
                raise FormulaError("DUPLICATE_FORMULA_SCRIPT")
            base[2][name] = value
        else:
            base = ["scripted", base, {name: value}]
        frames[-1].append(base)

    for token in tokens:
        depth = len(frames) + sum(map(len, waiting))
        if depth > MOST_DEPTH:
            raise FormulaError("UNSUPPORTED_FORMULA")
        if token == "{":
            frames.append([])
            waiting.append([])
        elif token == "}":
            if len(frames) == 1 or waiting[-1]:
                raise FormulaError("UNBALANCED_FORMULA")
            own = frames.pop()
            waiting.pop()
            if not own:
                raise FormulaError("EMPTY_FORMULA_GROUP")
            put(["row", *own])
        elif token in ("^", "_"):
            if waiting[-1] or not frames[-1]:
                raise FormulaError("UNSUPPORTED_FORMULA_TOKEN")
            waiting[-1].append(("sup" if token == "^" else "sub", 1, []))
        elif token == "\\frac":
            waiting[-1].append(("frac", 2, []))
        elif token == "\\sqrt":
            waiting[-1].append(("sqrt", 1, []))
        elif token.startswith("\\"):
            if token[1:] not in SYMBOLS:
                raise FormulaError("UNSUPPORTED_FORMULA_COMMAND")
            put(["text", SYMBOLS[token[1:]]])
        elif token == "[" and waiting[-1] and waiting[-1][-1][0] == "sqrt":
            raise FormulaError("UNSUPPORTED_INDEXED_ROOT")
        elif token.isalnum() or token in SIGNS:
            put(["text", token])
        else:
            raise FormulaError("UNSUPPORTED_FORMULA_TOKEN")
    if len(frames) > 1 or waiting[0] or not frames[0]:
        raise FormulaError("UNBALANCED_FORMULA")
    return ["row", *frames[0]]


def canonical(latex: str) -> str:
    """The tree as JSON: equal formulas, however spaced, have equal ones."""
    return json.dumps(tree(latex), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def omml(latex: str) -> str:
    """The formula as an Office math element."""

    def part(name: str, item: list) -> str:
        return f"<m:{name}>{written(item)}</m:{name}>"

    def written(item: list) -> str:
        kind, *rest = item
        if kind == "row":
            return "".join(map(written, rest))
        if kind == "text":
            return f"<m:r><m:t>{escape(rest[0])}</m:t></m:r>"
        if kind == "frac":
            return f"<m:f>{part('num', rest[0])}{part('den', rest[1])}</m:f>"
        if kind == "sqrt":
            return f'<m:rad><m:radPr><m:degHide m:val="1"/></m:radPr><m:deg/>{part("e", rest[0])}</m:rad>'
        base, scripts = rest
        name = {("sub", "sup"): "sSubSup", ("sup",): "sSup", ("sub",): "sSub"}[tuple(sorted(scripts))]
        return f"<m:{name}>{part('e', base)}{''.join(part(k, scripts[k]) for k in sorted(scripts))}</m:{name}>"

    return f'<m:oMath xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math">{written(tree(latex))}</m:oMath>'

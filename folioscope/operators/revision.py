"""An ordered ledger of edits to a document's blocks, applied to an immutable base."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame

#: Operations of a ledger, and characters of a text, at most.
MOST_OPERATIONS, MOST_CHARS = 200, 50_000


class LedgerError(ValueError):
    """An edit that can't be applied; the message is a stable code."""


def apply(blocks: list[dict], operations: list[dict]) -> list[dict]:
    """The blocks, in reading order, after all operations in their order; the given ones aren't changed.

    Every operation names its reason. ``text`` replaces a block's text, ``split`` cuts it at an offset, ``merge`` joins the next
    one to it, ``move`` exchanges it with a neighbour, ``policy`` sets how it is drawn.
    """
    if len(operations) > MOST_OPERATIONS:
        raise LedgerError("INVALID_OVERRIDES")
    out = [dict(b) for b in blocks]
    for n, op in enumerate(operations):
        if not (op.get("reason") or "").strip():
            raise LedgerError("OVERRIDE_REASON_REQUIRED")
        at = [i for i, b in enumerate(out) if b["id"] == op.get("block_id")]
        if len(at) != 1:
            raise LedgerError("BLOCK_NOT_FOUND")
        i, block, action = at[0], out[at[0]], op.get("action")
        if action == "text":
            if not isinstance(op.get("text"), str) or len(op["text"]) > MOST_CHARS:
                raise LedgerError("INVALID_TEXT")
            block["text"] = op["text"]
        elif action == "split":
            cut = op.get("offset") or 0
            if not 0 < cut < len(block["text"]):
                raise LedgerError("INVALID_SPLIT")
            out.insert(i + 1, block | {"id": f"{block['id']}-split{n}", "text": block["text"][cut:]})
            block["text"] = block["text"][:cut]
        elif action == "merge":
            if i + 1 == len(out):
                raise LedgerError("INVALID_MERGE")
            block["text"] += out.pop(i + 1)["text"]
        elif action == "move":
            to = i + (op.get("delta") or 0)
            if abs(to - i) != 1 or not 0 <= to < len(out):
                raise LedgerError("INVALID_MOVE")
            out[i], out[to] = out[to], out[i]
        elif action == "policy":
            block["policy"] = op.get("policy")
        else:
            raise LedgerError("UNKNOWN_ACTION")
    return out


def applied(blocks: DataFrame, operations: DataFrame) -> DataFrame:
    """Each document's blocks (document_id, ord, id, text, policy) after its operations (document_id, ord, operation as JSON).

    A document whose ledger can't be applied keeps its blocks and gets the code in ``error``; others never fail with it.
    """

    def run(key: tuple, own: pd.DataFrame, edits: pd.DataFrame) -> pd.DataFrame:
        base = own.sort_values("ord")[["id", "text", "policy"]].to_dict("records")
        error = None
        try:
            result = apply(base, [json.loads(x) for x in edits.sort_values("ord")["operation"]])
        except LedgerError as e:
            result, error = base, str(e)
        rows = [(key[0], i, b["id"], b["text"], b["policy"], error) for i, b in enumerate(result, 1)]
        return pd.DataFrame(rows, columns=["document_id", "ord", "id", "text", "policy", "error"])

    pair = blocks.groupBy("document_id").cogroup(operations.groupBy("document_id"))
    return pair.applyInPandas(run, "document_id long, ord long, id string, text string, policy string, error string")

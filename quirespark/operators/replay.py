"""Structural replay: operations that move, insert and remove blocks, folded in order, one document a group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id string, ord int, element string, text string, style string, kind string"
STEPS = ("insertAfter", "insertBefore", "append", "remove", "move", "setText", "setStyle")


def replay(log: DataFrame, base: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """The blocks (doc_id, ord, element, text, style, kind) after log(doc_id, seq, op, target, element, text, style, kind) on base of SCHEMA.

    op: insertAfter, insertBefore (element next to target), append, remove, move (target to after element; a null
    element is the beginning), setText, setStyle (its style). kind is paragraph, table or marker; null counts as
    paragraph. An operation on an element that isn't there is an error, and so is an element that comes twice or an op
    of another name, unless it is in `ignored`. The fold depends on order, so a document's log and blocks meet in one
    group; documents are independent. Blocks are a linked list, so the work grows with the log, not with its square.
    """

    def fold(key: tuple, ops: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        after: dict[str | None, str | None] = {None: None}  # None stands before the first and after the last
        before: dict[str | None, str | None] = {None: None}
        state: dict[str, list] = {}

        def link(e: str, left: str | None) -> None:
            right = after[left]
            after[left], before[e], after[e], before[right] = e, left, right, e

        def put(e: str, left: str | None, values: list) -> None:
            if e in state:
                raise ValueError(f"element {e} is in {key[0]} already")
            state[e] = values
            link(e, left)

        def cut(e: str) -> None:
            after[before[e]], before[after[e]] = after[e], before[e]

        def known(e: str) -> str:
            if e not in state:
                raise ValueError(f"no element {e} in {key[0]}")
            return e

        for r in rows.sort_values("ord").itertuples():
            put(r.element, before[None], [r.text, r.style, r.kind or "paragraph"])
        for o in ops.sort_values("seq").itertuples():
            if o.op in ("insertAfter", "insertBefore", "append"):
                left = before[None] if o.op == "append" else known(o.target) if o.op == "insertAfter" else before[known(o.target)]
                put(o.element, left, [o.text, o.style, o.kind or "paragraph"])
            elif o.op == "remove":
                cut(known(o.target))
                del state[o.target]
            elif o.op == "move":
                cut(known(o.target))
                link(o.target, None if o.element is None or o.element == o.target else known(o.element))
            elif o.op == "setText":
                state[known(o.target)][0] = o.text
            elif o.op == "setStyle":
                state[known(o.target)][1] = o.style
            elif o.op not in ignored:
                raise ValueError(f"replay does not know {o.op}")
        order, at = [], after[None]
        while at is not None:
            order.append(at)
            at = after[at]
        values = list(zip(*(state[e] for e in order), strict=True)) or [[], [], []]
        return pd.DataFrame({"doc_id": [key[0]] * len(order), "ord": range(len(order)), "element": order, "text": values[0], "style": values[1], "kind": values[2]})

    for c in ("style", "kind"):
        if c not in log.columns:
            log = log.withColumn(c, F.lit(None).cast("string"))
    return log.groupBy("doc_id").cogroup(base.groupBy("doc_id")).applyInPandas(fold, SCHEMA)

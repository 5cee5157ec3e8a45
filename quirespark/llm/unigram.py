"""SentencePiece encoding and decoding: Viterbi over a double-array trie of scored pieces.

The best segmentation is the one whose pieces' scores sum highest. Characters that no piece has cost an unknown's
score (the least score less 10) and come out as byte pieces. Pieces never cross a unit (a word with its marker), so
a text's best segmentation is its units', and units met before are not searched again.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Pieces, load_pieces, marked
from .shared import id_and_text, texts_of

UNKNOWN_PENALTY = 10.0
MEMO_UNITS = 500_000
MEMO_CHARS = 48


@dataclass(frozen=True)
class DoubleArray:
    """State t follows s on character code c where t = base[s] + c and check[t] = s; value[t] is the piece that ends there, or -1. State 0 is the root."""

    codes: dict[str, int]
    base: list[int]
    check: list[int]
    value: list[int]


def double_array(ids: dict[str, int]) -> DoubleArray:
    """Builds the trie breadth first, each node's children at the first base where all their cells are free."""
    codes = {c: k for k, c in enumerate(sorted({c for name in ids for c in name}), 1)}
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for name, i in ids.items():
        at = 0
        for c in name:
            at = children[at].setdefault(codes[c], len(children))
            if at == len(children):
                children.append({})
                ends.append(-1)
        ends[at] = i
    size = 2 * (len(children) + len(codes)) + 2
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    free, todo = 1, [(0, 0)]
    for node, state in todo:  # grows as it goes
        if not children[node]:
            continue
        kids = sorted(children[node].items())
        while check[free] >= 0:
            free += 1
        cell = free
        while True:
            start = cell - kids[0][0]
            if start >= 0:
                if start + kids[-1][0] >= size:
                    more = size
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
                    size += more
                if all(check[start + c] < 0 for c, _ in kids):
                    break
            cell += 1
        base[state] = start
        for c, child in kids:
            check[start + c] = state
            value[start + c] = ends[child]
            todo.append((child, start + c))
    return DoubleArray(codes, base, check, value)


class Unigram:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, pieces: Pieces) -> None:
        self.p = pieces
        self.trie = double_array(pieces.ids)
        self.unknown = min((pieces.scores[i] for i in pieces.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.memo: dict[str, bytes] = {}

    def best(self, unit: str) -> list[int]:
        """The ids of the unit's best segmentation. Of equal sums, the one met first stands: its last piece starts earliest."""
        t, scores, n = self.trie, self.p.scores, len(unit)
        codes, base, check, value = t.codes, t.base, t.check, t.value
        size = len(check)
        sums, back, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        cs = [codes.get(c, -1) for c in unit]
        for start in range(n):
            here, state, single = sums[start], 0, False
            for end in range(start, n):
                if (c := cs[end]) < 0 or (to := base[state] + c) >= size or check[to] != state:
                    break
                state = to
                if (i := value[state]) >= 0:
                    single |= end == start
                    if here + scores[i] > sums[end + 1]:
                        sums[end + 1], back[end + 1], piece[end + 1] = here + scores[i], start, i
            if not single and here + self.unknown > sums[start + 1]:
                sums[start + 1], back[start + 1], piece[start + 1] = here + self.unknown, start, -1
        out: list[int] = []
        at = n
        while at:
            out.extend([piece[at]] if piece[at] >= 0 else [self.p.byte_ids[b] for b in reversed(unit[back[at] : at].encode())])
            at = back[at]
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        memo, units = self.memo, self.p.units.findall(marked(text))
        found = list(map(memo.get, units))
        if None in found:
            if len(memo) > MEMO_UNITS:
                memo.clear()
            for k, unit in enumerate(units):
                if found[k] is None:
                    found[k] = memo.get(unit) or np.asarray(self.best(unit), np.int32).tobytes()
                    if len(unit) <= MEMO_CHARS:
                        memo[unit] = found[k]
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Pieces end to end, byte pieces as their bytes, markers as spaces; the one put before the text goes. Bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.p.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_coders: dict[str, Unigram] = {}


def coder(model_path: str) -> Unigram:
    """One coder a worker process and vocabulary."""
    if model_path not in _coders:
        _coders[model_path] = Unigram(load_pieces(model_path))
    return _coders[model_path]


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array of piece ids), n_tokens, n_byte_tokens (byte fallback), decoded_sha256 and round_trip.

    round_trip says whether decoding gives the text again; it does unless the text has a marker character of its own,
    which decodes to a space. A null text counts as empty and has no ids. Rows are independent: null or repeated ids
    and repeated rows do not matter; extra columns are not read. An empty table gives an empty one. Nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model_path)
        is_byte = np.zeros(len(c.p.raw), bool)
        is_byte[list(c.p.byte_ids)] = True
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                texts = texts_of(part.column(1))
                ids = [c.encode(t) for t in texts]
                decoded = [c.decode(i) for i in ids]
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int32), *ids])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([int(is_byte[i].sum()) for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                        pa.array([d == t for d, t in zip(decoded, texts, strict=True)], pa.bool_()),
                    ],
                    ["_id", "ids", "n_tokens", "n_byte_tokens", "decoded_sha256", "round_trip"],
                )

    schema = f"_id {kind}, ids array<int>, n_tokens long, n_byte_tokens long, decoded_sha256 string, round_trip boolean"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, model_path: str, *, ids_col: str = "ids") -> DataFrame:
    """All rows and columns of `encoded`, with the decoded text in column `text` (replaced if there). Null ids decode to null, no ids to the empty text."""
    import pandas as pd

    @F.pandas_udf("string")
    def to_text(column: pd.Series) -> pd.Series:
        c = coder(model_path)
        return pd.Series([None if x is None else c.decode(np.asarray(x, np.int32)) for x in column], dtype=object)

    return encoded.withColumn("text", to_text(F.col(f"`{ids_col}`")))

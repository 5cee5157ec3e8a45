"""Token counts: the exact BPE token count at every prefix of a text, by dynamic programming.

The BPE encoding of a prefix ends in exactly one piece t that forms a valid pair with the last piece of the
encoding of what stands before t. So count[i] = count[i - len(t)] + 1 for the only t that ends at i and fits,
and one pass gives the count of every prefix without encoding any of them. Pieces never cross a unit (a word
with its whitespace marker), so a text's table is the tables of its units laid end to end.

A table is kept as one signed byte per character: by how much the count changes when that character is added.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Pieces, load_pieces, marked
from .shared import Memo, id_and_text, texts_of

LIMIT = 4096
MEMO_UNITS = 700_000
MEMO_HEADS = 100_000
MEMO_CHARS = 48
HEAD = 6


class PrefixCounter:
    """Prefix tables for one vocabulary."""

    def __init__(self, pieces: Pieces) -> None:
        self.p = pieces
        self.names = {i: name for name, i in pieces.ids.items()}
        self.fits = Memo(self._fits, 2_000_000)
        self.tails = {name[k:] for name in pieces.ids for k in range(len(name))}
        self.heads = Memo(self._head, MEMO_HEADS)
        self.memo: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the adjacent pair whose piece scores highest, leftmost first, until none is a piece."""
        parts, ids, scores = list(text), self.p.ids, self.p.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, pair: tuple[int, int]) -> bool:
        a, b = self.names[pair[0]], self.names[pair[1]]
        return self.merged(a + b) == [a, b]

    def states(self, text: str, last: list[int], count: list[int]) -> None:
        """Carries last piece and count of every prefix on to the whole text; `last` and `count` hold those of a shorter prefix.

        -1 as last piece: the start, or a character that no piece has; pieces never join across it.
        """
        ids, fits, tails = self.p.ids, self.fits, self.tails
        for end in range(len(last), len(text) + 1):
            at = end - 1
            while at and text[at - 1 : end] in tails:  # a tail of a piece: something longer may match
                at -= 1
            while at < end:
                i = ids.get(text[at:end])
                if i is not None and ((before := last[at]) < 0 or fits[before, i]):
                    last.append(i)
                    count.append(count[at] + 1)
                    break
                at += 1
            else:
                char = text[end - 1]
                if char in ids:
                    raise ValueError(f"no piece fits at the end of {text[:end]!r}")
                last.append(-1)
                count.append(count[-1] + len(char.encode()))

    def _head(self, text: str) -> tuple[list[int], list[int]]:
        self.states(text, last := [-1], count := [0])
        return last, count

    def unit_deltas(self, unit: str) -> bytes:
        """The change of the count at each character of a unit. Units that begin alike share the states of their first characters."""
        last, count = self.heads[unit[:HEAD]]
        if len(unit) > HEAD:
            last, count = last.copy(), count.copy()
            self.states(unit, last, count)
        return bytes((b - a) & 255 for a, b in pairwise(count))

    def text_deltas(self, text: str) -> np.ndarray:
        """The change of the count at each character of the text as encoded: entry 0 is the marker put before it."""
        memo, units = self.memo, self.p.units.findall(marked(text))
        found = list(map(memo.get, units))
        if None in found:
            if len(memo) > MEMO_UNITS:
                memo.clear()
            for k, unit in enumerate(units):
                if found[k] is None:
                    found[k] = memo.get(unit) or self.unit_deltas(unit)
                    if len(unit) <= MEMO_CHARS:
                        memo[unit] = found[k]
        joined = b"".join(found)
        return np.frombuffer(joined, np.int8)

    def prefix_counts(self, text: str) -> np.ndarray:
        """count[i]: the tokens of text[:i], for every i from 0 to len(text)."""
        counts = np.cumsum(self.text_deltas(text), dtype=np.int64)
        if len(counts):
            counts[0] = 0  # an empty prefix has no marker
        return counts if len(counts) else np.zeros(1, np.int64)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """The length of the longest prefix of at most `budget` tokens. Counts may fall as a prefix grows, so the last is sought, not the first."""
    return int(np.flatnonzero(counts <= budget)[-1])


_counters: dict[str, PrefixCounter] = {}


def counter(model_path: str) -> PrefixCounter:
    """One counter a worker process and vocabulary."""
    if model_path not in _counters:
        _counters[model_path] = PrefixCounter(load_pieces(model_path))
    return _counters[model_path]


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, with_prefixes: bool = False) -> DataFrame:
    """Tokens of every text, and what its prefix table says of `limit`.

    Returns id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), fit_chars (code points of the longest
    prefix of at most `limit` tokens) and, with_prefixes, prefix_deltas: a signed byte per code point of the
    text, whose running sums from the first are the token counts of all its non-empty prefixes.

    A null text counts as empty; an empty text has no tokens. Rows are independent: null or repeated ids, repeated
    rows and extra columns do not matter, and an empty table gives an empty one. Nothing is shuffled. A very long
    text takes memory for its own table only.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + (", prefix_deltas binary" if with_prefixes else "")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(model_path)
        for batch in batches:
            n_bytes, n_tokens, fit, tables = [], [], [], []
            for text in texts_of(batch.column(1)):
                deltas = of.text_deltas(text)
                n = int(deltas.sum(dtype=np.int64))
                n_bytes.append(len(text.encode()))
                n_tokens.append(n)
                fit.append(longest_within(of.prefix_counts(text), limit) if n > limit else len(text))
                if with_prefixes:
                    table = deltas[1:].copy()
                    if len(table):
                        table[0] += deltas[0]
                    tables.append(table.tobytes())
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fit, pa.int64())]
            names = ["_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
            if with_prefixes:
                columns, names = [*columns, pa.array(tables, pa.binary())], [*names, "prefix_deltas"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return id_and_text(docs, id_col, text_col).mapInArrow(count, schema).withColumnRenamed("_id", id_col)


def tokens_of_prefix(deltas, n_chars) -> F.Column:
    """Tokens of the first `n_chars` code points, from a stored prefix_deltas column: a sum of bytes in a Spark expression, no encoding."""
    digits = F.hex(F.substring(deltas, 1, n_chars))
    codes = F.transform(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), lambda k: F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("long"))
    return F.when(F.length(digits) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(codes, F.lit(0).cast("long"), lambda total, x: total + F.when(x > 127, x - 256).otherwise(x)))

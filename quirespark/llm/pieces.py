"""The pieces of a SentencePiece vocabulary file, and how a text falls into units that no piece crosses."""

from __future__ import annotations

import re
from dataclasses import dataclass

MARK = "▁"


@dataclass(frozen=True)
class Pieces:
    """ids: of the pieces that match text; scores by id; byte_ids by byte; raw: each id's bytes in decoded text."""

    ids: dict[str, int]
    scores: list[float]
    byte_ids: tuple[int, ...]
    raw: list[bytes]
    longest: int
    alphabet: frozenset[str]
    units: re.Pattern


def load_pieces(model_path: str) -> Pieces:
    """Reads the vocabulary of `model_path` with the sentencepiece library.

    A unit is a run of whitespace markers with what follows up to the next marker. Line feeds and tabs that
    occur in no piece always stand alone. If some piece held a marker after another character, units would
    be wrong, so the whole text becomes one unit then.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    plain = {names[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    byte_ids = [-1] * 256
    raw = [b""] * n
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[value := int(names[i][3:-1], 16)] = i
            raw[i] = bytes([value])
        elif names[i] in plain:
            raw[i] = names[i].replace(MARK, " ").encode()
    if -1 in byte_ids:
        raise ValueError(f"{model_path} has no byte pieces to fall back on")
    alphabet = frozenset(c for p in plain for c in p)
    alone = "".join(c for c in "\n\t" if c not in alphabet)
    crossed = any(MARK in p.lstrip(MARK) for p in plain)
    units = re.compile("(?s).+" if crossed else f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
    return Pieces(plain, [sp.get_score(i) for i in range(n)], tuple(byte_ids), raw, max(map(len, plain), default=1), alphabet, units)


def marked(text: str) -> str:
    """The text as the encoder sees it: one marker before it, and one for each space. Empty stays empty."""
    return MARK + text.replace(" ", MARK) if text else ""

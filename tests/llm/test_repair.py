import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from quirespark.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, c string, seg string, pos string"
FAULT = {"blank": "b", "duplicate": "d", "truncated": "t"}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", None) for r in rows], SCHEMA).repartition(4)


def hurt(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if f:
            row = (c, turn, "user" if f == 4 else role, "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text)
            out += [row] * (2 if f == 3 else 1)
    return out


def best_edits(turns):
    """(cost, audit, lines) by trying every edit from each place on, back to front."""
    follows = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    @cache
    def rest(k, last, inserted):
        ways = []
        if k == len(turns) and last in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                if (last, role[0]) in follows:
                    cost, audit, lines = rest(k, role[0], inserted + 1)
                    ways.append((cost + 2, "I" + audit, (role + ":", *lines)))
        if k < len(turns):
            role, text, fault = turns[k]
            cost, audit, lines = rest(k + 1, last, 0)
            ways.append((cost + 3, "D" + audit, lines))
            if fault in ("t", ""):
                add = 1 if fault else 0
                for op, new, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if (last, new[:1]) in follows:
                        cost, audit, lines = rest(k + 1, new[:1], 0)
                        ways.append((cost + price + add, op + audit, (f"{new}:{text}", *lines)))
        return min(ways, default=(10**9, "", ()))

    return rest(0, "", 0)


def brute(rows, ids):
    """Conversation by conversation."""
    out = []
    for c in {r[0] for r in ids}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [r[1] for r in turns if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit, lines = best_edits(tuple((r[2], r[3], f) for r, f in zip(turns, faults, strict=True)))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        out.append((c, gaps, *(faults.count(f) for f in FAULT.values()), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, ids):
    return sorted((tuple(r[c] for c in ("conv_id", "gaps", *FAULT, "illegal", "cost", "audit", "repaired_sha256")) for r in R.repair(df, ids).collect()), key=str)


def talks(rng, n, longest=12):
    texts = ["yes.", "no", "why?", "  ", "", "so! ", "tail.\n", "é"]
    return [(c, t * rng.choice([1, 1, 2]) if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(texts)) for c in range(n) for t in range(rng.randrange(1, longest))]


@pytest.mark.parametrize("bits", [1, 10])
def test_brute_force(spark, monkeypatch, bits):
    """With segments of two turns and two matrices at a time the ways go through many levels."""
    monkeypatch.setattr(R, "SEGMENT", bits)
    monkeypatch.setattr(R, "FAN", 1 if bits == 1 else 5)
    rows = talks(random.Random(bits), 60) + [(77, k, "user" if k % 3 else "assistant", f"turn {k % 50}.") for k in range(90)]
    assert got(R.damaged(frame(spark, rows)), frame(spark, rows)) == brute(hurt(rows), rows)


def test_odd_rows(spark):
    """Null ids, turns, roles and texts, repeated rows and turns, negative and empty ones, conversations that lose all; clashing columns."""
    rows = [(None, None, None, None), (None, 1, "user", "hi."), (1, 5, "user", "a."), (1, 5, "user", "a."), (1, 5, "assistant", "b"), (-2, -4, "system", "s."), (-2, 9, "user", "x" * 70_000 + "."), (3, 0, "", "z."), (4, 0, "system", "only.")]
    lost = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "gone."))
    want = brute(hurt(rows), rows)
    assert got(R.damaged(frame(spark, rows)), frame(spark, rows)) == want
    assert [x for x in want if x[0] == lost][0][1:8] == (0, 0, 0, 0, 0, 0, "")
    assert got(frame(spark, []), frame(spark, [])) == []


def test_batches_cut_between_segments(spark, monkeypatch):
    """Arrow batches end anywhere; a segment never does."""
    rows = talks(random.Random(9), 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    monkeypatch.setattr(R, "BATCH", 9)
    try:
        assert got(R.damaged(frame(spark, rows)), frame(spark, rows)) == brute(hurt(rows), rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

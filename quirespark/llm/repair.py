"""Conversation structure repair: the cheapest edits that bring the roles of a conversation into the form (system? (user assistant)+)?.

Turns stand in order in segments of SEGMENT, which are dealt out by hash. A task gives a batch of segments to DuckDB as
one recursive query: each recursion takes one turn of all segments and keeps, for each state of the grammar, the
cheapest way into it and its audit. A segment is walked from every state it could begin in, so what it gives is a small
matrix; matrices of neighbouring segments combine (sums of costs, audits in a row), 32 at a time, until a conversation
has one. That of most has from the start. The way chosen is then followed down to the segments, and their edits are
applied to the turns. So no task needs all turns of a long conversation, but for two things that are one value for it:
its audit, a letter a turn, and the SHA-256 of its text, which is read front to back as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered
from .shared import written

SEGMENT = 10  # bits: 1,024 turns
FAN = 5  # bits: 32 matrices
BATCH = 20_000  # turns
BLANKS = " \t\n\x0b\x0c\r"

#: States: nothing yet, after system, after user, after assistant. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
FITS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1


def steps() -> list[tuple[int, str, int, int, str]]:
    """(state, symbol, next state, cost, edits): insertions, none to two, and then what is done with one turn.

    A symbol is the role's initial (x: any other) and k or t (truncated), or d for a turn that must go. More than two
    insertions in a row come back to a state they began with.
    """
    out = []
    for state in range(4):
        at, before = state, ""
        for _ in range(3):
            for initial in "suax":
                for end in "kt":
                    add = TRUNCATED if end == "t" else 0
                    if (at, initial) in FITS:
                        out.append((state, initial + end, FITS[at, initial], KEEP + add + INSERT * len(before), before + "K"))
                    for role in "ua":
                        if (at, role) in FITS:
                            out.append((state, initial + end, FITS[at, role], REROLE + add + INSERT * len(before), before + "R"))
                    out.append((state, initial + end, at, DELETE + INSERT * len(before), before + "D"))
            out.append((state, "d", at, DELETE + INSERT * len(before), before + "D"))
            at, before = INSERTED[at], before + "I"
    return out


WALK = """
    WITH RECURSIVE walk AS (
        SELECT g, 0 AS i, s AS begin, s AS state, 0 AS cost, '' AS audit FROM segments, (VALUES (0), (1), (2), (3)) v(s)
        UNION ALL
        SELECT w.g, w.i + 1, w.begin, x.next, min(w.cost + x.cost), arg_min(w.audit || x.edits, {'cost': w.cost + x.cost, 'audit': w.audit || x.edits})
        FROM walk w JOIN turns t ON t.g = w.g AND t.i = w.i JOIN steps x ON x.state = w.state AND x.symbol = t.symbol
        GROUP BY w.g, w.i, w.begin, x.next)
    SELECT g, begin, state, cost, audit FROM walk JOIN segments USING (g) WHERE i = n"""

MATRIX = "seg long, lo long, n long, initials string, illegal long, costs array<long>, audits array<string>"


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _walked(turns: DataFrame) -> DataFrame:
    """(c, MATRIX) of each segment of turns(c, seg, pos, symbol, initial)."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        import duckdb

        bounds = [k for k in range(len(rows)) if k == 0 or rows[k][:2] != rows[k - 1][:2]] + [len(rows)]
        sizes = [b - a for a, b in zip(bounds, bounds[1:], strict=False)]
        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        con.register("steps_", pa.table(dict(zip(("state", "symbol", "next", "cost", "edits"), map(list, zip(*steps(), strict=True)), strict=True))))
        con.execute("CREATE TABLE steps AS FROM steps_")
        con.register("segments", pa.table({"g": pa.array(range(len(sizes)), pa.int32()), "n": pa.array(sizes, pa.int32())}))
        con.register("turns_", pa.table({"g": pa.array([g for g, n in enumerate(sizes) for _ in range(n)], pa.int32()), "i": pa.array([i for n in sizes for i in range(n)], pa.int32()), "symbol": pa.array([r[3] for r in rows])}))
        con.execute("CREATE TABLE turns AS FROM turns_")
        costs: list[list] = [[None] * 16 for _ in sizes]
        audits: list[list] = [[None] * 16 for _ in sizes]
        for g, begin, state, cost, audit in con.execute(WALK).fetchall():
            costs[g][begin * 4 + state], audits[g][begin * 4 + state] = cost, audit
        con.close()
        initials = ["".join(r[4] for r in rows[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        heads = [rows[a] for a in bounds[:-1]]
        illegal = [sum(not legal(a, b) for a, b in zip(s, s[1:], strict=False)) for s in initials]
        columns = [pa.array([h[0] for h in heads], kind), *(pa.array(x, pa.int64()) for x in ([h[1] for h in heads], [h[2] for h in heads], sizes)), pa.array(initials), pa.array(illegal, pa.int64()), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["c", *(x.split()[0] for x in MATRIX.split(", "))])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in stream:
            rows += zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
            if len(rows) >= BATCH:
                cut = len(rows) - 1
                while cut and rows[cut][:2] == rows[cut - 1][:2]:
                    cut -= 1
                if cut:  # the last segment may go on
                    yield solve(rows[:cut])
                    rows = rows[cut:]
        if rows:
            yield solve(rows)

    kind = pa.int64()
    return turns.repartition("c", "seg").sortWithinPartitions("c", "seg", "pos").select("c", "seg", "pos", "symbol", "initial").mapInArrow(batches, f"c long, {MATRIX}")


JOINED = "c long, seg long, first string, last string, illegal long, costs array<long>, audits array<string>, via array<string>, kids array<long>"


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """The matrix of neighbouring segments (c, seg, up, first, last, illegal, costs, audits); via: the states between them, for each pair of begin and end."""
    pdf = pdf.sort_values("seg")
    best: dict[tuple[int, int], tuple] = {(s, s): (0, "", str(s)) for s in range(4)}
    for costs, audits in zip(pdf["costs"], pdf["audits"], strict=True):
        new: dict[tuple[int, int], tuple] = {}
        for (begin, mid), (cost, audit, via) in best.items():
            for end in range(4):
                more = audits[mid * 4 + end]
                if more is not None:
                    way = (cost + int(costs[mid * 4 + end]), audit + more, via + str(end))
                    new[begin, end] = min(new.get((begin, end), way), way)
        best = new
    pairs = [best.get((s, e), (None, None, None)) for s in range(4) for e in range(4)]
    firsts, lasts = list(pdf["first"]), list(pdf["last"])
    illegal = int(pdf["illegal"].sum()) + sum(not legal(a, b) for a, b in zip(lasts, firsts[1:], strict=False))
    c = pdf["c"].iloc[0]
    return pd.DataFrame([(None if pd.isna(c) else int(c), int(pdf["up"].iloc[0]), firsts[0], lasts[-1], illegal, [p[0] for p in pairs], [p[1] for p in pairs], [p[2] for p in pairs], [int(x) for x in pdf["seg"]])], columns=[x.split()[0] for x in JOINED.split(", ")]).astype({"c": "Int64"})


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _chosen(roots: DataFrame) -> DataFrame:
    """(c, seg, begin, end, cost, audit, illegal, closing) of whole conversations: the cheapest way from nothing to an end, ties by audit."""
    ways = [F.struct((F.get("costs", s) + INSERT * len(CLOSING[s])).alias("cost"), F.concat(F.get("audits", s), F.lit(CLOSING[s])).alias("audit"), F.lit(s).alias("end"), F.lit(CLOSING[s]).alias("closing")) for s in range(4)]
    best = F.array_min(F.filter(F.array(*ways), lambda w: w["audit"].isNotNull()))
    return roots.select("c", "seg", F.lit(START).alias("begin"), "illegal", best.alias("w")).select("c", "seg", "begin", "illegal", "w.*")


def _lines(leaves: DataFrame) -> DataFrame:
    """(c, pos, sub, role, own): what the edits of segments leave and bring: own is a turn that stays, with its own role (role null) or a new one; others are inserted. sub orders what has one pos."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {USER: "user", ASSISTANT: "assistant"}
        for batch in batches:
            out: list[tuple] = []
            for c, lo, n, initials, state, audit, closing in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                k = sub = 0
                for op in audit:
                    if op == "I":
                        state = INSERTED[state]
                        out.append((c, lo + k, sub, names[state], False))
                        sub += 1
                        continue
                    if op == "K":
                        state = FITS[state, initials[k]]
                        out.append((c, lo + k, 2, None, True))
                    elif op == "R":
                        state = ASSISTANT if state == USER else USER
                        out.append((c, lo + k, 2, names[state], True))
                    k, sub = k + 1, 0
                for j, _ in enumerate(closing):
                    state = INSERTED[state]
                    out.append((c, lo + n - 1, 4 + j, names[state], False))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["c", "pos", "sub", "role", "own"])

    audit = F.get("audits", F.col("begin") * 4 + F.col("end"))
    return leaves.select("c", "lo", "n", "initials", "begin", audit.alias("audit"), "closing").mapInArrow(lines, "c long, pos long, sub int, role string, own boolean")


def _hashes(lines: DataFrame, turns: DataFrame) -> DataFrame:
    """(c, repaired_sha256) of the conversations that lines are left of."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        open_, sha, some, stays, new_role = object(), hashlib.sha256(), False, None, None

        def say(role: str, text: str) -> None:
            nonlocal some
            sha.update((("\n" if some else "") + role + ":" + text).encode())
            some = True

        for batch in batches:
            for c, pos, sub, role, text, own in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if c != open_:
                    if some:
                        done.append((open_, sha.hexdigest()))
                    open_, sha, some, stays = c, hashlib.sha256(), False, None
                if sub == 3:  # the turn itself
                    if stays == pos:
                        say(role if new_role is None else new_role, text)
                elif own:
                    stays, new_role = pos, role
                else:
                    say(role, "")
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], ["c", "repaired_sha256"])
            done = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([open_], pa.int64()), pa.array([sha.hexdigest()], pa.string())], ["c", "repaired_sha256"])

    rows = lines.select("c", "pos", "sub", "role", F.lit("").alias("text"), "own").unionByName(turns.select("c", "pos", F.lit(3).alias("sub"), "role", "text", F.lit(False).alias("own")))
    return rows.repartition("c").sortWithinPartitions("c", "pos", "sub").mapInArrow(stream, "c long, repaired_sha256 string")


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with the damage to be repaired, by crc32 of "conv_id:turn" % 20: 0 the row is gone, 1 its text, 2 its stops, 3 it comes twice, 4 its role is user. Nulls are one space."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    f = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    rows = df.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), f.alias("f")).where("f <> 0")
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def repair(df: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of the conversations (conv_id, turn, role, text), and of those of ids(conv_id), which may have no turns.

    Turns stand by `turn`, null ones first, equal ones by role and digest. A turn's first fault counts: blank (nothing but
    white space), duplicate (role and text came before), truncated (does not end with a stop). gaps: turns missing
    between the first and the last. illegal: neighbours whose roles' initials are none of su, ua, au. Edits: Keep costs
    0, Rerole (user or assistant) 2, Delete 3 and is what blank and duplicate turns must get, Insert (an empty user or
    assistant) 2; truncated turns that stay add 1. audit: the initials of the cheapest edits that leave nothing, or
    user-assistant pairs with or without a system before them; of equally cheap ones the least as text.
    repaired_sha256: of the lines role:text.

    Nulls in role and text count as one space, a null conv_id is a conversation of its own. Without turns numbers are 0,
    the audit is empty and the hash is that of nothing. Other columns are not read. Rows that are alike in all four
    columns stay next to each other in one task.
    """
    of = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = df.select(F.col("conv_id").cast("long").alias("c"), F.col("turn"), of("role").alias("role"), of("text").alias("text")).withColumn("digest", digest)
    turns = numbered(rows, ["c", "turn", "role", "digest"], "turns")
    trimmed = F.rtrim("text", F.lit(BLANKS))
    light = turns.select("c", "turn", "pos", "digest", F.left("role", F.lit(1)).alias("initial"), (trimmed == "").alias("blank"), F.right(trimmed, F.lit(1)).isin(".", "!", "?").alias("ends"))
    light = light.withColumn("initial", F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x"))
    first = light.where("NOT blank").groupBy("c", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    light = light.join(first, "pos", "left").withColumn("duplicate", ~F.col("blank") & F.col("_first").isNull())
    light = light.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~F.col("ends"))
    symbol = F.when(F.col("blank") | F.col("duplicate"), "d").otherwise(F.concat("initial", F.when(F.col("truncated"), "t").otherwise("k")))
    light = written(light.select("c", "turn", "pos", F.shiftright("pos", SEGMENT).alias("seg"), "initial", symbol.alias("symbol"), "blank", "duplicate", "truncated"), "faults")
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    stats = written(light.groupBy("c").agg(gaps.cast("long").alias("gaps"), count("blank"), count("duplicate"), count("truncated"), F.shiftright(F.min("pos"), SEGMENT).alias("from"), F.shiftright(F.max("pos"), SEGMENT).alias("to")), "conversations")

    spans = stats.select(F.col("c").alias("_c"), "from", "to")
    leaves = written(_walked(light), "matrices").join(spans, _same("c", "_c")).drop("_c")
    ends = {"first": F.left("initials", F.lit(1)), "last": F.right("initials", F.lit(1))}
    depth = -(-int(stats.agg(F.max(F.col("from").bitwiseXOR(F.col("to")))).first()[0] or 0).bit_length() // FAN)
    levels, level = [], leaves.withColumns(ends).select("c", "seg", "from", "to", "first", "last", "illegal", "costs", "audits")
    roots = [_chosen(level.where(F.col("from") == F.col("to")))]
    for k in range(1, depth + 1):
        above = lambda c, bits=FAN * k: F.shiftright(c, bits)
        parts = level.where(F.shiftright("from", FAN * (k - 1)) != F.shiftright("to", FAN * (k - 1))).withColumn("up", F.shiftright("seg", FAN))
        joined = written(parts.select("c", "seg", "up", "first", "last", "illegal", "costs", "audits").groupBy("c", "up").applyInPandas(_joined, JOINED), "matrices")
        levels.append(joined)
        level = joined.join(spans, _same("c", "_c")).drop("_c")
        roots.append(_chosen(level.where(above("from") == above("to"))))
    roots = [written(r, "chosen") for r in roots]
    way = roots[-1].select("c", "seg", "begin", "end", "closing")
    for k in range(depth, 0, -1):
        via = levels[k - 1].select(F.col("c").alias("_c"), F.col("seg").alias("_seg"), "via", "kids")
        met = way.join(via, _same("c", "_c") & (F.col("seg") == F.col("_seg"))).withColumn("states", F.get("via", F.col("begin") * 4 + F.col("end")))
        kid = met.select("c", "closing", "states", F.size("kids").alias("_n"), F.posexplode("kids").alias("_k", "seg"))
        state = lambda nth: F.col("states").substr(nth, F.lit(1)).cast("int")
        down = kid.select("c", "seg", state(F.col("_k") + 1).alias("begin"), state(F.col("_k") + 2).alias("end"), F.when(F.col("_k") == F.col("_n") - 1, F.col("closing")).otherwise("").alias("closing"))
        way = down.unionByName(roots[k - 1].select("c", "seg", "begin", "end", "closing"))
    way = way.withColumnsRenamed({"c": "_c", "seg": "_seg"})
    lines = _lines(leaves.join(way, _same("c", "_c") & (F.col("seg") == F.col("_seg"))))
    hashes = _hashes(lines, turns)

    whole = reduce(DataFrame.unionByName, roots).select("c", "illegal", "cost", "audit")
    known = (ids.select(F.col("conv_id").cast("long").alias("c")) if ids is not None else stats.select("c")).distinct()
    union = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    out = reduce(union, [known, stats.drop("from", "to"), whole, hashes]).groupBy("c").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    return out.withColumnRenamed("c", "conv_id")

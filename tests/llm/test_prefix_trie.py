import hashlib
import random
import zlib

from quirespark.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, key string, n string, node string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", None) for r in rows], SCHEMA).repartition(4)


def symbol(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", symbol(role, text), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c > 0 else -1)  # truncated, as in SQL
        out[c] = own.get(c - rest, [])[:h] + t[h:]
    return out


def brute(rows):
    """Nodes by dictionaries of prefixes."""
    conversations = rebuilt(rows)
    members = {}
    for c, t in conversations.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(m) if len(conversations[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), sum(len(x) == len(k) + 1 for x in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, **more):
    rows = T.conversation_trie(T.branched(T.turns(df)), **more).collect()
    return sorted(((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows), key=str)


def talks(rng, n):
    rows = []
    for c in range(n):
        kind = rng.random()
        length = rng.choice([1, 2, 5, 9, 12]) if kind < 0.9 else 40
        for t in range(length):
            text = "hello" if kind < 0.4 or t < 2 else f"text {rng.randrange(3)} é"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    return rows


def test_brute_force_in_many_buckets(spark):
    """Hot first turns, copies of whole conversations, deep ones; buckets of a few conversations cut their paths."""
    rows = talks(random.Random(4), 120)
    want = brute(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert got(frame(spark, rows), bucket=60) == want
        assert got(frame(spark, rows), bucket=7) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got(frame(spark, rows)) == want


def test_odd_rows(spark):
    """Null roles, texts, turns and ids, repeated rows and turns, negative ids, empty texts, missing first conversations."""
    rows = [(0, None, None, None), (0, None, "user", "a"), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 1, "user", "b"), (-3, 0, "user", ""), (-1, 0, "x", "y"), (7, 5, "user", "z"), (None, 0, "user", "lost"), (4, 0, None, ""), (4, 3, "", None), (9, 0, "user", "q" * 100_000)]
    assert got(frame(spark, rows)) == brute(rows)
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [(None, 0, "user", "x")])) == []


def test_merge_of_runs():
    """Every entry comes in order with the turns that it shares with the one before, from any number of runs."""
    rng = random.Random(2)
    for n_runs in (1, 2, 3, 7):
        keys = {"".join(f"{rng.randrange(2):0{T.WIDTH}d}" for _ in range(rng.randrange(9))) for _ in range(60)}
        runs = [[] for _ in range(n_runs)]
        for k in keys:
            runs[rng.randrange(n_runs)].append(k)
        runs = [[(T.common(r[i - 1], k) if i else 0, k, i) for i, k in enumerate(r)] for r in map(sorted, runs)]
        stream = list(T.merged(runs))
        assert [k for _, k, _ in stream] == sorted(keys)
        assert [x for x, _, _ in stream] == [0] + [T.common(a[1], b[1]) for a, b in zip(stream, stream[1:], strict=False)]

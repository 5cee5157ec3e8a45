"""Mixing sources to target weights: blocks of equal size, apportioned by highest quotients (Sainte-Laguë).

Seats are blocks of BLOCK words. Sources get blocks by the quotients target / (2 k - 1); a source's blocks go to
its shards in the same way, by size. In a shard the documents stand in a seeded order on a circle of all its
words, and its quota of blocks is taken from a seeded place on, once or twice round.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORDS, with_order, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BLOCK = 4
SHARD_WORDS = 1 << 18
FAN = 4096  # shards apportioned in one group


def apportion(votes: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Laguë: each seat goes to the highest quotient votes / (2 k - 1), k counting from 1; ties to the first.

    Starts from rounded shares, which differ from the outcome by a few seats, and moves single seats until the
    lowest quotient that holds a seat is no lower than the highest that holds none.
    """
    votes = np.asarray(votes, dtype=float)
    total = votes.sum()
    if seats <= 0 or total <= 0:
        return np.zeros(len(votes), np.int64)
    got = np.floor(votes * seats / total + 0.5).astype(np.int64)
    high = [(-v / (2 * g + 1), k) for k, (v, g) in enumerate(zip(votes, got, strict=True)) if v > 0]
    heapq.heapify(high)
    left = seats - int(got.sum())
    while left > 0:
        _, k = high[0]
        got[k] += 1
        left -= 1
        heapq.heapreplace(high, (-votes[k] / (2 * got[k] + 1), k))
    low = [(votes[k] / (2 * got[k] - 1), -k) for k in np.flatnonzero(got).tolist()]
    heapq.heapify(low)
    while left < 0:
        _, k = low[0]
        got[-k] -= 1
        left += 1
        heapq.heapreplace(low, (votes[-k] / (2 * got[-k] - 1), k)) if got[-k] else heapq.heappop(low)
    return _settled(votes, got)


def _settled(votes: np.ndarray, got: np.ndarray) -> np.ndarray:
    """Moves a seat while some source without it has a higher quotient than one that holds it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        while True:
            gain = votes / (2 * got + 1)
            loss = np.where(got > 0, votes / (2 * got - 1), np.inf)
            to, off = int(gain.argmax()), int(loss.argmin())
            if gain[to] <= loss[off]:
                return got
            got[to] += 1
            got[off] -= 1


def fill(sizes: np.ndarray, weights: np.ndarray, total: float, cap: float) -> np.ndarray:
    """Shares `total` by weight; a share above cap * size stops there, and what is over is shared again among the rest."""
    most = cap * sizes.astype(float)
    out, free = np.zeros(len(sizes)), sizes > 0
    left = total
    while free.any() and left > 0:
        share = np.where(free, left * weights / weights[free].sum(), 0)
        over = free & (share > most)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = most[over]
        left -= most[over].sum()
        free &= ~over
    return out


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, cap: float, block: int, seed: int) -> DataFrame:
    """mix's rows, with what tells rows of one id apart: (_id, _source, _raw: a hash of the text, size, ...)."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").cast("string").alias("_source"), F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_raw"),
    )
    rows = written(rows, "mix-sizes")
    kind = "_source string, source_size long"

    def targets(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_order", ignore_index=True)  # as Spark has ranked them
        by = np.resize(np.asarray(weights, float), len(pdf))
        sizes = pdf["source_size"].to_numpy(np.int64)
        pdf["target"] = fill(sizes, by, share * float(sizes.sum()), cap)
        pdf["_blocks"] = apportion(pdf["target"].to_numpy(), round(float(pdf["target"].sum()) / block))
        return pdf[["_source", "source_size", "target", "_blocks"]]

    sources = rows.groupBy("_source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("_order", F.row_number().over(Window.partitionBy(F.lit("all")).orderBy(F.col("_source").asc_nulls_last())))
    sources = written(sources.groupBy(F.lit("all")).applyInPandas(targets, f"{kind}, target double, _blocks long"), "mix-targets")
    own = sources.select(F.col("_source").alias("_of"), "source_size", "target", "_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long").alias("_shards"))
    rows = rows.join(own, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("_id", "_raw", F.lit(seed)), "_shards"))

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        """The blocks of a part, dealt to the parts below it by their words."""
        pdf = pdf.sort_values("_part", ignore_index=True)
        pdf["_quota"] = apportion(pdf["_words"].to_numpy(), int(pdf["_blocks"].iloc[0]))
        return pdf[["_source", "_part", "_words", "_quota"]]

    quota = "_source string, _part long, _words long, _quota long"
    shards = rows.groupBy("_source", "_shard").agg(F.sum("size").alias("_words"), F.first("_blocks").alias("_blocks")).withColumn("_upper", F.floor(F.col("_shard") / FAN))
    uppers = shards.groupBy("_source", F.col("_upper").alias("_part")).agg(F.sum("_words").alias("_words"), F.first("_blocks").alias("_blocks"))
    uppers = uppers.groupBy("_source").applyInPandas(quotas, quota).select(F.col("_source").alias("_of"), F.col("_part").alias("_in"), "_quota")
    shards = shards.drop("_blocks").join(uppers, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_upper") == F.col("_in"))).select("_source", "_upper", F.col("_shard").alias("_part"), "_words", F.col("_quota").alias("_blocks"))
    shards = shards.groupBy("_source", "_upper").applyInPandas(quotas, quota).select(F.col("_source").alias("_of"), F.col("_part").alias("_in"), "_words", "_quota")
    order = Window.partitionBy("_source", "_shard").orderBy(F.xxhash64(F.lit(seed), "_id", "_raw"), "_id", "_raw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_end", F.sum("size").over(order)).withColumn("_begin", F.col("_end") - F.col("size"))
    rows = rows.join(shards, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_shard") == F.col("_in")))
    z = F.greatest(F.lit(1), "_words")
    rows = rows.withColumn("_take", F.least(F.col("_quota") * block, F.col("_words") * int(cap)))
    rows = rows.withColumn("full", F.floor(F.col("_take") / z).cast("long")).withColumn("_rest", F.col("_take") - F.col("full") * F.col("_words"))
    rows = rows.withColumn("_at", F.pmod(F.xxhash64("_source", "_shard", F.lit(seed)), z))
    # the arc [_at, _at + _rest) of the circle, and the part of it that lies a turn further
    for n, turn in (("1", F.lit(0)), ("2", F.col("_words"))):
        low = F.greatest("_begin", F.col("_at") - turn)
        high = F.least("_end", F.col("_at") + F.col("_rest") - turn)
        rows = rows.withColumn(f"from_{n}", F.when(high > low, low - F.col("_begin")).otherwise(0)).withColumn(f"to_{n}", F.when(high > low, high - F.col("_begin")).otherwise(0))
    taken = F.col("size") * F.col("full") + F.col("to_1") - F.col("from_1") + F.col("to_2") - F.col("from_2")
    return rows.select("_id", "_source", "_raw", "size", "source_size", "target", taken.cast("long").alias("taken"), "full", "from_1", "to_1", "from_2", "to_2")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = 17
) -> DataFrame:
    """What a mix takes from each document.

    Sources stand in the order of their code points, null last, and weigh `weights`, repeating; they share `share`
    times all words, and none gets more than `cap` (a whole number) times its own. Returns id_col, size,
    source_size, target and taken, and the places that `taken` comes from: full (whole copies) and the word ranges
    [from_1, to_1) and [from_2, to_2) of further copies. For each source, taken words come to its target within half
    a block (more only where blocks are larger than sources).

    A null or empty text has no words and gives none; a null source is a source of its own; ids may be null or
    repeated. Extra columns are not read. An empty table gives an empty one. Reruns agree, as places depend on ids,
    sizes, texts and `seed` alone. One row a source goes through one task, and of a source's shards one row for FAN of
    them at a time; documents never do.
    """
    plan = _plan(docs, id_col, text_col, source_col, weights, share, cap, block, seed)
    return plan.drop("_source", "_raw").withColumnRenamed("_id", id_col)


def mixed_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = 17
) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken whole, and cut to the words taken where a block's edge falls inside it.

    Columns are those of `docs`. Each row has its own places, also where rows share an id; rows that share id, source
    and text are given theirs in turn. Where a text is cut, its words taken are joined by single spaces; whole copies
    keep their text as it is. A document without words is never taken.
    """
    key, places = ["_id", "_source", "_raw"], ["taken", "full", "from_1", "to_1", "from_2", "to_2", "size"]
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in key]
    plan = written(_plan(docs, id_col, text_col, source_col, weights, share, cap, block, seed).withColumnsRenamed({k: f"{k}_" for k in key}), "mix-plan")
    by_key = plan.groupBy(*(f"{k}_" for k in key)).agg(F.count("*").alias("_times"), F.max(F.struct(*places)).alias("_mix"))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").cast("string").alias("_source"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_raw")
    )
    once = rows.join(by_key.where("_times = 1 AND _mix.taken > 0"), same).select("_doc", "_mix")
    # rows that share all three, if any, meet their places in turn
    repeated = by_key.where("_times > 1").drop("_mix", "_times")
    turns = plan.join(repeated.withColumnsRenamed({f"{k}_": k for k in key}), same, "left_semi")
    turns = turns.withColumn("_turn_", F.row_number().over(Window.partitionBy(*(f"{k}_" for k in key)).orderBy(*(F.desc(c) for c in places)))).select(*(f"{k}_" for k in key), "_turn_", F.struct(*places).alias("_mix"))
    again = rows.join(repeated, same, "left_semi").withColumn("_turn", F.row_number().over(Window.partitionBy(*key).orderBy(*with_order(docs, "_doc"))))
    again = again.join(turns, [*same, F.col("_turn") == F.col("_turn_")]).where("_mix.taken > 0").select("_doc", "_mix")
    rows = once.unionByName(again)
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("a"), F.col("_mix.size").alias("b")), F.col("_mix.full").cast("int"))
    parts = [F.when(F.col(f"_mix.to_{n}") > F.col(f"_mix.from_{n}"), F.array(F.struct(F.col(f"_mix.from_{n}").alias("a"), F.col(f"_mix.to_{n}").alias("b")))).otherwise(F.expr("array()").cast("array<struct<a:bigint,b:bigint>>")) for n in "12"]
    rows = rows.select("_doc", "_mix", F.explode(F.concat(whole, *parts)).alias("_range"))
    spaces = r"[\x20\x09-\x0D]"
    text = F.col(f"_doc.`{text_col}`")
    taken = F.array_join(F.slice(F.split(F.regexp_replace(text, f"^{spaces}+", ""), f"{spaces}+"), (F.col("_range.a") + 1).cast("int"), (F.col("_range.b") - F.col("_range.a")).cast("int")), " ")
    cut = F.when((F.col("_range.a") == 0) & (F.col("_range.b") == F.col("_mix.size")), text).otherwise(taken)
    return rows.select(*(cut.alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))

"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w . x - threshold_k): one weight vector for all grades, thresholds in order. The expected
severity is the sum of these probabilities. Features are words and their first letters; a feature's value grows
with its share of the document's words.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Memo, id_and_text, texts_of, written

BITS = 20
STEMS = (4, 5, 6, 7)
GRADES = 3  # above 0
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 6000
LEAST_DOCS = 4  # toxic documents of the sample that have a feature, at least
LEAST_ODDS = float(np.log(12))  # and how much rarer, in logarithms, it is in clean ones
EDGES = ".,;:!?\"'()[]«»„“”…¿¡"


def features_of(word: str) -> tuple[int, ...]:
    """A word's features: itself and its beginnings, without case and punctuation at the ends."""
    word = word.lower().strip(EDGES)
    if not word:
        return ()
    names = [f"w:{word}", *(f"s{n}:{word[:n]}" for n in STEMS if len(word) > n)]
    return tuple(zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in names)


def counts_of(text: str, memo) -> tuple[dict[int, int], int]:
    counts: dict[int, int] = {}
    words = text.split()
    for hits in filter(None, map(memo.__getitem__, words)):
        for f in hits:
            counts[f] = counts.get(f, 0) + 1
    return counts, len(words)


def value(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Grows with how often a feature occurs and with how often for 100 words."""
    return np.log1p(count) + np.log1p(100 * count / np.maximum(words, 1))


def print_of(text: str) -> int:
    """The least hash of the text's runs of three words; copies with a few edits mostly share it."""
    words = text.split()
    return min((zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))), default=0)


@dataclass(frozen=True)
class SeverityModel:
    """weights by feature; thresholds in ascending order; cut: the P(grade >= 1) from which a text counts as toxic."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]
    cut: float = 0.5

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(-(score[:, None] - np.asarray(self.thresholds)[None, :])))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, *, ridge: float = 2.0, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with a ridge penalty, by Adam over all rows: weights and ascending thresholds."""
    n, k = len(grades), GRADES
    w, first, gaps = np.zeros(n_features), np.array([2.0]), np.zeros(k - 1)
    moments = [np.zeros((2, len(x))) for x in (w, first, gaps)]
    at = np.arange(n)
    for step in range(1, steps + 1):
        theta = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        s = np.bincount(rows, values * w[cols], n)
        p = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-(s[:, None] - theta[None, :]))), np.zeros((n, 1))], axis=1)  # P(grade >= 0 .. k + 1)
        mass = np.maximum(p[at, grades] - p[at, grades + 1], 1e-12)
        slope = p * (1 - p)
        d_low, d_high = -slope[at, grades] / mass, slope[at, grades + 1] / mass  # of the loss, by s at either edge of the grade
        ds = d_low + d_high
        d_theta = np.array([-(d_low[grades == j].sum() + d_high[grades == j - 1].sum()) for j in range(1, k + 1)])
        grads = [np.bincount(cols, values * ds[rows], n_features) / n + ridge * w / n, np.array([d_theta.sum()]) / n, np.array([d_theta[j:].sum() * np.exp(gaps[j - 1]) for j in range(1, k)]) / n]
        for x, g, m in zip((w, first, gaps), grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            x -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return w, np.concatenate([first, first + np.cumsum(np.exp(gaps))])


def markers(sample: DataFrame, n1: int, n0: int) -> np.ndarray:
    """The numbers, ascending, of all features far more frequent in the sample's `n1` toxic documents than in its `n0` clean ones."""
    seen = sample.select("_toxic", F.explode("_features").alias("f")).groupBy("f").agg(F.sum("_toxic").alias("t"), F.sum(1 - F.col("_toxic")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("c") + 0.5) / (n0 + 1))
    most = seen.where((F.col("t") >= LEAST_DOCS) & (odds >= LEAST_ODDS)).select("f").toArrow()  # one of 2 ** BITS numbers each
    return np.sort(most["f"].to_numpy().astype(np.int64))


def fit_severity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN) -> SeverityModel:
    """Learns from at most `toxic_rows` + `clean_rows` labelled documents, those whose ids hash lowest.

    Labels say toxic or not; grades above 0 are made of them: a toxic document's grade is the third that it falls in
    by its share of markers, features far more frequent in toxic than in clean documents. Of copies in the sample, and
    of documents that share an id, one counts, else what copies share would look like a mark. Spark counts documents by feature; the driver receives the
    chosen features and, of each document of the sample, what it holds of them. The cut is where the sample's F1 is highest. Without both
    kinds of label the model calls nothing toxic.
    """
    marks = labels.where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("_marked")).agg(F.max(f"`{label_col}`").cast("int").alias("_toxic"))
    order = [F.xxhash64("_marked"), F.col("_marked")]
    marks = marks.where("_toxic = 1").orderBy(*order).limit(toxic_rows).unionByName(marks.where("_toxic = 0").orderBy(*order).limit(clean_rows))
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(marks), F.col("_id") == F.col("_marked")).select("_toxic", "_text", "_id")  # at most toxic_rows + clean_rows pairs of numbers

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(features_of, 300_000)
        for batch in batches:
            texts = texts_of(batch.column(1))
            found = [counts_of(t, memo) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(c) for c, _ in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.int64()), pa.array([print_of(t) for t in texts], pa.int64()), batch.column(2)],
                ["_toxic", "_features", "_counts", "_words", "_print", "_id"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    sample = rows.mapInArrow(extract, f"_toxic int, _features array<int>, _counts array<int>, _words long, _print long, _id {kind}")
    sample = sample.groupBy("_id").agg(F.min(F.struct("_print", "_toxic", "_words", "_features", "_counts")).alias("x")).select("x.*")  # however often an id stands in docs
    sample = sample.groupBy("_print", "_toxic").agg(F.min(F.struct("_words", "_features", "_counts")).alias("x"))
    sample = written(sample.select("_print", "_toxic", "x._words", "x._features", "x._counts"), "severity-sample")
    by_label = {r["_toxic"]: r["n"] for r in sample.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    chosen = markers(sample, by_label.get(1, 0), by_label.get(0, 0)) if len(by_label) == 2 else np.zeros(0, np.int64)
    if not len(chosen):
        return SeverityModel({}, tuple(20.0 + k for k in range(GRADES)))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            feature, count = (batch.column(k).flatten().to_numpy() for k in (3, 4))
            number = np.minimum(np.searchsorted(chosen, feature), len(chosen) - 1)
            hit = chosen[number] == feature
            offsets = np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[hit].astype(np.int32))) for x in (number, count)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *lists], ["_print", "_toxic", "_words", "_numbers", "_counts"])

    got = sample.select("_print", "_toxic", "_words", "_features", "_counts").mapInArrow(narrow, "_print long, _toxic int, _words long, _numbers array<int>, _counts array<int>").toArrow()
    got = got.sort_by([("_print", "ascending"), ("_toxic", "ascending")]).combine_chunks()  # of each document of the sample its markers only
    toxic, words = got["_toxic"].to_numpy().astype(np.int64), got["_words"].to_numpy().astype(float)
    flat = lambda name: got[name].combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(len(toxic)), pc.list_value_length(got["_numbers"]).to_numpy())
    col, count = flat("_numbers"), flat("_counts").astype(float)
    density = np.bincount(row, count, len(toxic)) / np.maximum(words, 1)
    cuts = np.quantile(density[toxic == 1], np.arange(1, GRADES) / GRADES)
    grades = np.where(toxic == 1, 1 + np.searchsorted(cuts, density, side="right"), 0)
    values = value(count, words[row])
    w, theta = fit_ordinal(row, col, values, grades, len(chosen))
    scores = np.bincount(row, values * w[col], len(toxic))
    model = SeverityModel({int(f): float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-6}, tuple(map(float, theta)))
    return replace(model, cut=best_cut(model.at_least(scores)[:, 0], toxic))


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap below the lowest score that is called toxic where F1 is highest."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + toxic.sum())
    k = int(f1.argmax())
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(p[order[k]] + below) / 2


def scorer(model: SeverityModel):
    weights = model.weights
    memo = Memo(lambda word: tuple(f for f in features_of(word) if f in weights), 300_000)

    def score(texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for k, text in enumerate(texts):
            counts, n = counts_of(text, memo)
            if counts:
                v = value(np.fromiter(counts.values(), float), np.array(n))
                out[k] = float(v @ np.fromiter((weights[f] for f in counts), float))
        return out

    return score


def severity(docs: DataFrame, model: SeverityModel, *, text_col: str = "text", cut: float | None = None, prefix: str = "") -> DataFrame:
    """All rows and columns of `docs` with `prefix` + severity (expected grade, 0 to 3), grade (the likeliest) and toxic (P(grade >= 1) >= cut; the model's unless given).

    A null or empty text scores as a text without toxic features. Rows are independent: null or repeated ids and
    repeated rows do not matter; columns of `docs` that bear a result's name are replaced. An empty table gives an
    empty one. Nothing is shuffled; the model is bounded by the sample, and by 2 ** BITS features.
    """
    kind = "severity double, grade int, toxic boolean"

    at = model.cut if cut is None else cut

    @F.pandas_udf(kind)
    def apply(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = scorer(model)
        for series in texts:
            p = model.at_least(score(["" if t is None else t for t in series]))
            whole = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1)
            yield pd.DataFrame({"severity": p.sum(axis=1), "grade": (whole[:, :-1] - whole[:, 1:]).argmax(axis=1).astype("int32"), "toxic": p[:, 0] >= at})

    names = [x.split()[0] for x in kind.split(", ")]
    scored = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), apply(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_score"))
    kept = [c for c in docs.columns if c not in {prefix + n for n in names}]
    return scored.select(*(F.col(f"_doc.`{c}`").alias(c) for c in kept), *(F.col(f"_score.{n}").alias(prefix + n) for n in names))

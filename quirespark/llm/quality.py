"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms are hashed words, the shapes of words (case, digits, punctuation) and pairs of equal neighbours; a document's
vector is its tf-idf row projected on the leading singular directions of a bounded labelled sample. Every document's
cosine with every vector of that sample is computed exactly, in blocks, and its nearest neighbours vote by similarity.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Memo, id_and_text, texts_of

CLASSES = 1024
TERMS = 2 * CLASSES
PIECE = 40
DIMENSIONS = 48
SAMPLE = 4096
NEIGHBOURS = 15
BLOCK = 512
ACCEPT = 0.7


def terms_of(piece: str) -> int:
    """Two terms of a word, or of a piece of a long one, in one number: the class of its shape and, times CLASSES, that of its letters without case.

    A shape is the runs of letters and digits by class, other characters as they are, up to three of each, and the length by powers of two.
    """
    out, last, run = [], "", 0
    for c in piece:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "w" if c.isalpha() else c
        run = run + 1 if kind == last else 1
        if run == 1 or (run <= 3 and kind not in "aA0w"):
            out.append(kind)
        last = kind
    shape = 1 + zlib.crc32(f"{''.join(out)}/{len(piece).bit_length()}".encode()) % (CLASSES - 1)
    return shape + CLASSES * (zlib.crc32(piece.lower().encode()) % CLASSES)


def term_counts(texts: list[str], memo) -> np.ndarray:
    """A row of term counts for each text; term 0 counts words that repeat the one before. Words longer than PIECE count by their pieces, all of them."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for k, text in enumerate(texts):
        if words := text.split():
            out[k, 0] = sum(map(eq, words[1:], words))
            if max(map(len, words)) > PIECE:
                words = [w[a : a + PIECE] for w in words for a in range(0, len(w), PIECE)]
            both = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
            out[k, 1:CLASSES] = np.bincount(both % CLASSES, minlength=CLASSES)[1:]
            out[k, CLASSES:] = np.bincount(both // CLASSES, minlength=CLASSES)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.sqrt(counts) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class Neighbours:
    """idf by term; axes: terms x dimensions; points: the sample's unit vectors; labels of the points; prior: their mean."""

    idf: np.ndarray
    axes: np.ndarray
    points: np.ndarray
    labels: np.ndarray
    prior: float

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = weighted(counts, self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def vote(self, counts: np.ndarray, k: int) -> np.ndarray:
        """Of each row, the mean label of its k nearest points, weighted by their cosine; the prior where none is alike."""
        out = np.full(len(counts), self.prior)
        k = min(k, len(self.points))
        for at in range(0, len(counts) if k else 0, BLOCK):
            cosines = self.vectors(counts[at : at + BLOCK]) @ self.points.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(float)
            total = weight.sum(axis=1)
            found = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[at : at + BLOCK] = np.where(total > 1e-9, np.clip(found, 0, 1), self.prior)
        return out


def held_out(id_column):
    """True for the quarter of ids kept out of learning: crc32 of the id as text leaves 2 when divided by 4. A null id is never held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Neighbours:
    """Learns from at most `sample` labelled documents that are not held out, those whose ids hash lowest. A document labelled twice counts as the lower label; of documents that share an id one counts."""
    marks = labels.where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull() & ~held_out(F.col(f"`{id_col}`")))
    marks = marks.groupBy(F.col(f"`{id_col}`").alias("_marked")).agg(F.min(f"`{label_col}`").cast("int").alias("_label")).orderBy(F.xxhash64("_marked"), "_marked").limit(sample)
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(marks), F.col("_id") == F.col("_marked")).select("_id", "_label", "_text")  # at most `sample` pairs of numbers
    kind = docs.schema[id_col].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(terms_of, 300_000)
        for batch in batches:
            counts = term_counts(texts_of(batch.column(2)), memo)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in counts], pa.binary())], ["_id", "_label", "_counts"])

    found = rows.mapInArrow(extract, f"_id {kind}, _label int, _counts binary").groupBy("_id").agg(F.min(F.struct("_label", "_counts")).alias("x"))
    got = found.select("_id", "x._label", "x._counts").toArrow().sort_by("_id")  # at most `sample` rows of 8 kB
    counts = np.frombuffer(b"".join(got["_counts"].to_pylist()), np.float32).reshape(-1, TERMS)
    y = np.asarray(got["_label"].to_pylist(), float)
    if not len(y):
        return Neighbours(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    idf = (np.log((1 + len(y)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    rows_ = weighted(counts, idf)
    _, vectors = np.linalg.eigh(rows_.T @ rows_)
    axes = np.ascontiguousarray(vectors[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
    model = Neighbours(idf, axes, np.zeros((0, DIMENSIONS), np.float32), y, float(y.mean()))
    return Neighbours(idf, axes, model.vectors(counts), y, model.prior)


def quality_scores(docs: DataFrame, model: Neighbours, *, id_col: str = "doc_id", text_col: str = "text", k: int = NEIGHBOURS, accept: float = ACCEPT) -> DataFrame:
    """id_col, held_out, score (0 to 1) and predicted (1 if score >= accept) of every row.

    A null or empty text has no terms and gets the share of label 1 among the sample. Rows are independent: null or
    repeated ids and repeated rows do not matter; extra columns are not read. An empty table gives an empty one.
    Nothing is shuffled; the model is broadcast and holds at most SAMPLE vectors of DIMENSIONS numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Memo(terms_of, 300_000)
        for series in texts:
            whole = series.tolist()
            parts = [shared.value.vote(term_counts(whole[a : a + BLOCK], memo), k) for a in range(0, len(whole), BLOCK)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    rows = id_and_text(docs, id_col, text_col).select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), score("_text").alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= accept, 1).otherwise(0).cast("int"))

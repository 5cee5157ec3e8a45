"""A corpus, from documents to token ids: toxicity, exact dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.

All stages take rows with nulls in any column, and columns besides those of `documents`, whatever their names: they go
along untouched. A null text counts as empty. An empty table gives an empty one. Stages that keep rows keep texts as
they are; which of repeated rows they keep depends on the rows alone, so reruns agree.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quirespark.llm.exact_dedup import without_copies
from quirespark.llm.mixing import mixed_documents
from quirespark.llm.near_dedup import without_near_copies
from quirespark.llm.shared import table, written
from quirespark.llm.toxicity import fit_severity, severity
from quirespark.llm.unigram import encode

#: Near-copies, exact copies, the mix's seeded places and the classifier are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model calls toxic go. It is learned from this stage's own documents and their labels.

    Empty and null texts are never toxic. Rows are judged one by one: repeated rows and ids stay or go alike. Of documents
    that share a labelled id one is learned from; without labels of both kinds nothing goes.
    """
    model = fit_severity(docs, table(spark, sf_dir, "labels"))
    return severity(docs, model, prefix="_tox_").where("NOT _tox_toxic").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the one with the smallest doc_id stays, a null id after all others.

    Null and empty texts are equal. Of rows that share that id, too, one stays: the first by its other columns.
    """
    return without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a likeness of 0.8 and more between sets of five-word shingles, the one with the smallest doc_id stays, a null id after all others.

    Links go on: what is linked to a linked document is in the group. Texts without words are linked with nothing and
    stay. Of rows of a group that share the smallest id one stays.
    """
    return without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: documents come once, twice, in part or not at all.

    A null source is a source of its own, the last one. Texts without words are never taken. Rows that share an id have
    places of their own. Where a text is cut, its words are joined by single spaces.
    """
    return mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and what `encode` tells besides, for every row; an empty or null text has no ids. Repeated rows have a row each."""
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs

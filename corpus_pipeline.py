"""A training corpus from raw documents: each stage's result is written as Parquet and read as the next one's documents.

A null or empty text is scored like an empty one, links with nothing, holds no benchmark window and no secret, and packs as its end
token. A null id is kept as it is. Repeated rows are judged one by one, except that near_duplicates keeps one of them. An empty
table of documents, benchmark or labels gives an empty result, no hits, or a network that was not trained and rejects nothing.
Further columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard, packing, secrets, toxicity
from tidemark.llm.queries import table, tokenizer_path, toxicity_model
from tidemark.llm.tables import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go."""
    return toxicity.accepted(docs, toxicity_model(spark, docs, sf_dir))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: that of the smallest id; of rows with equal ids and texts any one."""
    return jaccard.one_of_each(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets masked and n_chars counted anew."""
    return secrets.with_length(secrets.redact(docs))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("secrets", _secrets),
    ("packing", _packing),
]

#: Learned scores, connected components and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, name)
    return docs

"""A corpus pipeline: quality rules, near duplicates, mixing of sources, SentencePiece encoding.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet to the folder named by
``spark.checkpoint.dir`` and read again as the next stage's documents, so a lost executor never reaches further back than
one stage. All stages but the last return the columns of ``documents``; the last one returns the encoded segments with
the text they decode to.

Null texts count as empty ones: the quality rules drop them, and texts too short to judge, as failed. Texts of any length go
through whole. Rows that repeat an id are one document to the join, of which one row stays; rows without id stay and are
linked with nothing. Columns beside those of ``documents`` are carried to the stage before the last, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shopgrain.llm import jaccard_join, lattice, mixing, quality_votes
from shopgrain.llm.queries import tokenizer_file
from shopgrain.session import configure, materialize, name_local_folder, release, staged

# Mild tempering of source, language and topic shares, so that most documents stay.
POWERS = (0.95, 0.95, 0.95)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed votes of the rules keep."""
    return quality_votes.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, n=5, similarity=jaccard_join.Similarity(4, 5))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens meet tempered shares of sources, languages and topics."""
    return mixing.sample(docs, powers=POWERS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the piece table for every document, with the text that they decode to."""
    model = tokenizer_file("piece_bpe_32k.model")
    return lattice.decode(lattice.encode(docs, model), model)


def afresh(stage: Stage) -> Stage:
    """The stage, begun on a driver that has dropped the plans of the one before."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", afresh(quality)),
    ("n-gram Jaccard join", afresh(deduplicate)),
    ("mixing sources to target weights", afresh(mix)),
    ("SentencePiece encoding and decoding", afresh(encode)),
]

# The joins of shingle sets and the piece lattice have no SQL twin at this size; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    name_local_folder(configure(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with staged(spark):  # what a stage writes on its way goes with it
            docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower(), outlive=True)
    return docs

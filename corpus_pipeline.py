"""A corpus from raw documents to sampled pieces, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; ``run`` writes what a stage returns as Parquet in the shared folder and
gives the next one the table read from there, after which it is deleted.

Defined cases: an empty table runs through all stages; null texts score 0 for toxicity
and as empty texts for quality, have no shingles, size 0 and no pieces; a null doc_id
is kept by every filter that its text passes; rows with equal doc_id are scored each by
its text, and count as one document for near-duplicates; ties go to the least
doc_id; extra columns, whatever their names, stay until the last stage; texts are read
whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import mixing, ngram_join, pieces, quality, toxicity
from palisade.llm.store import Stages, documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject."""
    return toxicity.kept(docs, _labels(spark, sf_dir))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking does not reject."""
    return quality.kept(docs, _labels(spark, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each group of near-duplicates: five words, similarity 0.8."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a document taken twice has two rows."""
    return mixing.mixed(docs)


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_pieces, pieces and lossless of each row."""
    return pieces.encoded(docs)


STAGES = [
    ("toxicity", clean),
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("source mixing", mix),
    ("sampled pieces", sampled_pieces),
]

#: SQL expresses neither the networks nor the sampling; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages, docs = Stages(spark, "corpus-pipeline"), documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stages.keep(stage(spark, docs, sf_dir))
        stages.only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)

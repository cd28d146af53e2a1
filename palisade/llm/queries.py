"""The subpackage's registered queries; each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import compression, fingerprints, language_model, licenses, mixing, neighbours, ngram_join, pieces, quality, simhash, toxicity, url_filters, whitening
from palisade.llm.oracles import ORACLE
from palisade.llm.store import documents


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.grouped(documents(spark, sf_dir))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op5_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(documents(spark, sf_dir))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "size", "source_size", "target", "taken")
    return mixing.plan(documents(spark, sf_dir)).select(*columns)


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(documents(spark, sf_dir)).drop("spans")


def op10_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(documents(spark, sf_dir))


def op11_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_ALL = (
    op1_bradley_terry_quality,
    op2_tree_neighbours,
    op3_ngram_jaccard_join,
    op4_document_fingerprints,
    op5_recurrent_toxicity,
    op6_url_filters,
    op7_hidden_markov_scores,
    op8_source_mixing,
    op9_license_scans,
    op10_sampled_pieces,
    op11_simhash_variants,
    op12_vector_codes,
    op13_embedding_whitening,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {name: ORACLE[name] for name in QUERIES if name in ORACLE}

"""From raw documents to packed sequences: five stages, each written and read again.

Rejected documents go, of near copies one stays, personal data is masked, sources
are mixed to their target weights, and what is left is packed into bins. All but
the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import mixing, ngram_join, packing, private, quality
from paperloom.sources.durable import cut_lineage


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality policy passes."""
    return quality.keep_good(docs, policy="web-1")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity 0.8."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def anonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return private.mask_documents(docs, private.fit(private.sample_regions(docs)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in random order."""
    return mixing.mix_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", good),
    ("near duplicates", distinct),
    ("personal data", anonymous),
    ("mixture", mixed),
    ("packing", packed),
]

# No SQL: masking decodes a trained model, packing is sequential.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the shared
store and reads again as the next one's docs. All but the last keep the columns of documents.

1. language ID: rows whose language can't be told with confidence go;
2. n-gram Jaccard join: one document of each group of near duplicates stays;
3. PII: personal data is replaced by its kind in brackets;
4. mixing: documents become the mixture's documents, source by source to its target;
5. packing: pieces of documents with their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbitframe.llm.jaccard import one_of_each
from orbitframe.llm.langid import accepted_documents
from orbitframe.llm.mixing import mixed_texts
from orbitframe.llm.packing import pack
from orbitframe.llm.pii import redacted
from orbitframe.llm.settings import scratch, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

# No SQL: a trained classifier, expectation-maximisation and a tokeniser are stages; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{at}/{k}")
    return docs

"""A training corpus from ``documents``: five stages, each a call of one operator.

Every stage works on all that the stage before it kept.  The first four return
the columns of ``documents``; the last writes the token files and returns a row
for each document in them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkrisk.llm.decontamination import decontaminated
from linkrisk.llm.kernel import stored
from linkrisk.llm.mixing import mixed_documents
from linkrisk.llm.simhash import SIMILAR, deduplicated
from linkrisk.llm.token_store import new_store, read_tokens, write_tokens
from linkrisk.llm.toxicity import clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return deduplicated(docs, SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document comes as often as the mix takes it."""
    return mixed_documents(docs, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, read back: doc_id, start, n_tokens, ids_crc32."""
    path = new_store(spark)
    write_tokens(docs, path, end_id=2)
    return read_tokens(spark, path, ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: The learned and hashed stages have no SQL; tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of five stages; each works on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes the result
of each stage but the last as Parquet in the shared checkpoint folder and reads it again as the next one's documents;
what a stage has written goes once the next one has. (The last of them stays, as the result is computed from it.)

Defined results: all stages but the last keep the columns, whatever they are. Null and empty texts are neither toxic,
nor near copies, nor contaminated, and end at the mixing, as they have no tokens; so do rows of a null doc_id only if
the budget leaves them out. Of rows that share a doc_id one stays from near_dedup on. Texts are worked on in full,
however long. Empty documents, labels or benchmark are no error: there is nothing to do, or nothing to go by.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import shared_folder, table
from tessera.llm.decontaminate import decontaminate
from tessera.llm.mixing import mix
from tessera.llm.simhash_dedup import near_dedup
from tessera.llm.token_binary import token_binary
from tessera.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut to their target weights."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become binary shards of token ids."""
    return token_binary(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_binary", tokens)]

#: A factorization machine, a graph search and a tokenizer have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, written = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(path := f"{folder}/{i}-{name}")
            docs = spark.read.parquet(path)
            if written:
                _delete(spark, written)
            written = path
    return docs

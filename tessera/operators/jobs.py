"""A queue of jobs as a table, and the jobs themselves: re-index and batch embedding.

A job is (job_id, kind, priority, status, created_at, ...); status is pending, running, completed, failed or cancelled.
Every operation is a filter, an update of a column, or a sort of the table, so the queue may hold any number of jobs;
the state after it is a new table, to be written where the old one was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.embed import Embedder, embed_cached, hashing_embedder
from tessera.operators import chunking
from tessera.operators.store import ParquetStore, upsert
from tessera.schema import chunk_id

PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = "pending", "running", "completed", "failed", "cancelled"
ENDED = (COMPLETED, FAILED, CANCELLED)


def listed(jobs: DataFrame, status: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Jobs of a status and kind, newest first."""
    for column, value in (("status", status), ("kind", kind)):
        if value is not None:
            jobs = jobs.where(F.col(column) == value)
    ordered = jobs.orderBy(F.desc("created_at"), "job_id")
    return ordered if limit is None else ordered.limit(limit)


def due(jobs: DataFrame, limit: int) -> DataFrame:
    """The pending jobs to run next: of the highest priority, oldest first."""
    return jobs.where(F.col("status") == PENDING).orderBy(F.desc("priority"), "created_at", "job_id").limit(limit)


def moved(jobs: DataFrame, which: Column, status: str) -> DataFrame:
    """jobs with a new status for those that have not ended and match."""
    return jobs.withColumn("status", F.when(which & ~F.col("status").isin(*ENDED), status).otherwise(F.col("status")))


def cancelled(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """jobs with those of the ids cancelled that are still pending."""
    gone = ids.select("job_id").distinct().withColumn("_gone", F.lit(True))
    out = jobs.join(gone, "job_id", "left")
    return out.withColumn("status", F.when(F.col("_gone") & (F.col("status") == PENDING), CANCELLED).otherwise(F.col("status"))).drop("_gone")


def pruned(jobs: DataFrame, before: Column) -> DataFrame:
    """jobs without those that ended and were created before a time."""
    return jobs.where(~(F.col("status").isin(*ENDED) & (F.col("created_at") < before)))


def counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"))


def reindex(documents: DataFrame, chunks: DataFrame, strategy: Callable[[DataFrame], DataFrame] = chunking.fixed_size, id_: str = "doc_id") -> DataFrame:
    """chunks with those of the documents made anew; chunks of other documents stay, those of documents without text go."""
    made = strategy(documents).withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("chunk_index")))
    left = chunks.join(documents.select(F.col(id_).alias("document_id")), "document_id", "left_anti")
    return left.select("chunk_id", "document_id", "chunk_index", "content").unionByName(made.select("chunk_id", "document_id", "chunk_index", "content"))


def batch_embed(chunks: DataFrame, embeddings: DataFrame, make: Callable[[], Embedder] = hashing_embedder) -> DataFrame:
    """embeddings (chunk_id, vector) with those of chunks that lack one; each distinct text is embedded once."""
    missing = chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_anti")
    made, _ = embed_cached(missing.select("chunk_id", "content"), make=make)
    return upsert(embeddings.select("chunk_id", "vector"), made.select("chunk_id", "vector"))


def run_next(jobs: DataFrame, store: ParquetStore, work: dict[str, Callable[[ParquetStore], None]], limit: int) -> DataFrame:
    """Runs the jobs that are due, one after the other, and returns jobs with how they ended. limit bounds what the driver holds."""
    ended: list[tuple[object, str]] = []
    for job in due(jobs, limit).select("job_id", "kind").collect():
        try:
            work[job.kind](store)
            ended.append((job.job_id, COMPLETED))
        except Exception:
            ended.append((job.job_id, FAILED))
    if not ended:
        return jobs
    kind = jobs.schema["job_id"].dataType.simpleString()
    new = jobs.sparkSession.createDataFrame(ended, f"job_id {kind}, _new string")
    return jobs.join(F.broadcast(new), "job_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")

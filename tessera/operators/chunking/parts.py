"""Windows and groups over the parts of documents (sentences, turns, chunks), as window functions.

parts: (document, order, text or vector). A document's parts are sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vector as V


def windows(parts: DataFrame, size: int, id_: str = "document_id", order: str = "chunk_index", text: str = "content", joiner: str = " ") -> DataFrame:
    """(id, order, text): each run of size neighbouring parts, joined; shorter tails are left out."""
    over = Window.partitionBy(id_).orderBy(order).rowsBetween(0, max(1, size) - 1)
    rows = parts.select(id_, order, F.collect_list(F.coalesce(text, F.lit(""))).over(over).alias("_parts"))
    return rows.where(F.size("_parts") == max(1, size)).select(id_, order, F.array_join("_parts", joiner).alias(text))


def neighbours(parts: DataFrame, id_: str = "document_id", order: str = "chunk_index", vector: str = "vector") -> DataFrame:
    """parts with the cosine similarity to the part before; null for a document's first."""
    before = F.lag(vector).over(Window.partitionBy(id_).orderBy(order))
    return parts.withColumn("similarity", F.when(before.isNotNull(), V.cosine(F.col(vector), before)))


def groups(parts: DataFrame, breaks: Column, id_: str = "document_id", order: str = "chunk_index") -> DataFrame:
    """parts with a column part: how many breaks a document has had up to each."""
    over = Window.partitionBy(id_).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("part", F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(over))

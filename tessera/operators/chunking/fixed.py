"""Chunks by size, overlap and statistics as built-in expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import CHARS_PER_TOKEN, trimmed


def _windows(documents: DataFrame, size: int, stride: int, id_: str, content: str) -> DataFrame:
    """Windows over the trimmed text; the last is the first that reaches the end. Blank texts give none.

    The text is cut once into blocks of stride characters, of which a window takes those that it reaches into: linear in
    the text, which is not carried along with its windows.
    """
    text = documents.select(F.col(id_).alias("document_id"), trimmed(F.col(content)).alias("text"))
    blocks = text.select("document_id", F.length("text").alias("n"), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{stride}}}"), F.lit(0)).alias("blocks"))
    count = F.when(F.col("n") == 0, F.lit(0)).when(F.col("n") <= size, F.lit(1)).otherwise(F.ceil((F.col("n") - size) / F.lit(stride)).cast("int") + 1)
    full, rest = divmod(size, stride)

    def window(i: Column) -> Column:
        parts = [F.coalesce(F.get("blocks", i + k), F.lit("")) for k in range(full)]
        return F.concat(*parts, F.left(F.coalesce(F.get("blocks", i + full), F.lit("")), F.lit(rest))) if rest else F.concat(*parts)

    windows = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1))), F.lit(1), count), window)
    start = F.col("chunk_index") * stride
    each = blocks.select("document_id", "n", F.posexplode(windows).alias("chunk_index", "content"))
    return each.select("document_id", "chunk_index", "content", start.alias("start_offset"), F.least(start + size, F.col("n")).alias("end_offset"))


def whole(documents: DataFrame, id_: str = "doc_id", content: str = "content") -> DataFrame:
    """The trimmed text of each document as one chunk, whatever its length. Blank texts give none."""
    text = documents.select(F.col(id_).alias("document_id"), F.lit(0).alias("chunk_index"), trimmed(F.col(content)).alias("content"))
    return text.where(F.length("content") > 0).withColumn("start_offset", F.lit(0)).withColumn("end_offset", F.length("content"))


def fixed_size(documents: DataFrame, size: int = 1000, overlap: int = 200, id_: str = "doc_id", content: str = "content") -> DataFrame:
    size = max(1, size)
    return _windows(documents, size, size - min(max(0, overlap), size - 1), id_, content)


def fixed_tokens(documents: DataFrame, size: int = 512, overlap: int = 50, model: str = "simple", id_: str = "doc_id", content: str = "content") -> DataFrame:
    """Windows of exactly size estimated tokens: the shortest run of characters that counts as that many."""
    size, rate = max(1, size), CHARS_PER_TOKEN[model]
    overlap = min(max(0, overlap), size - 1)
    chars = max(int(rate * size), math.ceil(rate * size)) if size > 1 else int(rate)
    return _windows(documents, chars, max(1, chars - int(rate * overlap)), id_, content)


def _previous() -> Column:
    return F.lag("content").over(Window.partitionBy("document_id").orderBy("chunk_index"))


def add_overlap(chunks: DataFrame, size: int) -> DataFrame:
    """Each chunk with the last characters of the one before it in front."""
    tail = F.coalesce(F.right(_previous(), F.lit(size)), F.lit(""))
    with_tail = chunks.withColumn("tail", tail)
    return with_tail.select(
        "document_id",
        "chunk_index",
        F.concat("tail", "content").alias("content"),
        F.greatest(F.lit(0), F.col("start_offset") - F.length("tail")).alias("start_offset"),
        "end_offset",
    )


def shared(before: str | None, content: str | None) -> int:
    """Length of the longest start of content that before ends with."""
    if not before or not content:
        return 0
    at = before.find(content[0], max(0, len(before) - len(content)))
    while at >= 0:
        if content.startswith(before[at:]):
            return len(before) - at
        at = before.find(content[0], at + 1)
    return 0


def _shared(before: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([shared(a, b) for a, b in zip(before, content, strict=True)], dtype="int32")


def remove_overlap(chunks: DataFrame) -> DataFrame:
    """Each chunk without the longest start that is also the end of the one before it."""
    before = chunks.withColumn("before", _previous())
    cut = before.withColumn("cut", F.pandas_udf(_shared, "int")("before", "content"))
    return cut.select(
        "document_id",
        "chunk_index",
        F.expr("substring(content, cut + 1)").alias("content"),
        (F.col("start_offset") + F.col("cut")).alias("start_offset"),
        "end_offset",
    )


def statistics(chunks: DataFrame) -> DataFrame:
    """One row of count, total, mean, least, most and median size; zeros for no chunks."""
    size = F.length("content")
    none = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    return chunks.agg(
        F.count("*").alias("count"),
        none(F.sum(size), "bigint").alias("total_characters"),
        none(F.avg(size), "double").alias("average_size"),
        none(F.min(size), "bigint").alias("min_size"),
        none(F.max(size), "bigint").alias("max_size"),
        none(F.floor(F.percentile(size, F.lit(0.5))), "bigint").alias("median_size"),
    )

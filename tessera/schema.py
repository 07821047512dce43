"""Schemas of documents, chunks, embeddings and results, and the ids of chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT = "doc_id string, content string, source string, title string, author string, url string, mime_type string, custom string, created_at timestamp"
CHUNK = "chunk_id string, content string, document_id string, chunk_index int, start_offset int, end_offset int, source string, custom string"
EMBEDDING = "chunk_id string, vector array<float>, model string"
RESULT = f"{CHUNK}, score double"


@dataclass(frozen=True)
class QueryOptions:
    retrieval_limit: int = 5
    include_metadata: bool = True
    system_prompt: str | None = None
    temperature: float | None = None
    filter: object | None = None
    max_context_tokens: int = 4096


@dataclass(frozen=True)
class LLMOptions:
    temperature: float | None = None
    max_tokens: int | None = None
    stop_sequences: tuple[str, ...] = ()


def chunk_id(document_id: Column, index: Column) -> Column:
    """The same id for the same chunk at every run."""
    return F.sha2(F.concat_ws(":", document_id.cast("string"), index.cast("string")), 256)


def chunk_errors(chunks: DataFrame, max_size: int) -> DataFrame:
    """(chunk_id, chunk_index, reason) of chunks that are too long."""
    size = F.length("content")
    reason = F.format_string(f"chunk of %d characters is over the limit of {max_size}", size)
    return chunks.where(size > max_size).select("chunk_id", "chunk_index", reason.alias("reason"))

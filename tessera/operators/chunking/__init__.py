"""Chunking: one row of a document becomes rows (document_id, chunk_index, content, start_offset, end_offset)."""

from tessera.operators.chunking.fixed import add_overlap, fixed_size, fixed_tokens, remove_overlap, statistics, whole
from tessera.operators.chunking.python import STRATEGIES, Piece, chunk, code, language_of, markdown, paragraph, recursive, semantic, sentence
from tessera.operators.chunking.parts import groups, neighbours, windows

__all__ = ["STRATEGIES", "Piece", "add_overlap", "chunk", "code", "fixed_size", "fixed_tokens", "groups", "language_of", "markdown", "neighbours", "paragraph", "recursive", "remove_overlap", "semantic", "sentence", "statistics", "whole", "windows"]

"""Byte-level BPE of whole texts, by a public vocabulary of ranks.

The pattern that splits a text before BPE never joins what stands on either side of a space that follows something
else than white space. So texts are cut before such spaces, the pieces are numbered by an Arrow dictionary, and only
pieces not met before are encoded; their ids are then laid out by gathers. The ids are those of encoding each text.
"""

from __future__ import annotations

import base64
import functools
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken

from tessera.llm.common import raw

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers: the first ones, among which all frequent ones are.
REMEMBERED = 200_000


class Tokenizer:
    def __init__(self, path: str = VOCABULARY):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        self.bpe = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.held: dict[bytes, list[int]] = {}

    def one(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(text)

    def __call__(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the n + 1 offsets between them."""
        data, offsets = raw(texts)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        space = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (data[1:] == 32) & ~space[:-1]
        # white space of more than one byte may stand before the space: no cut there
        cut[2:-1] &= ~((data[:-2] == 0xC2) & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0)))
        cut[3:-1] &= ~((data[:-3] >= 0xE1) & (data[:-3] <= 0xE3) & (data[1:-2] >= 0x80) & (data[1:-2] <= 0x9A))
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        found = pieces.dictionary_encode()
        held, bpe, ids = self.held, self.bpe.encode_ordinary, []
        for piece in found.dictionary.to_pylist():
            got = held.get(piece)
            if got is None:
                got = bpe(piece.decode())
                if len(held) < REMEMBERED:
                    held[piece] = got
            ids.append(got)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((t for x in ids for t in x), np.uint32, int(size.sum()))
        start, code = np.cumsum(size) - size, found.indices.to_numpy(zero_copy_only=False)
        n = size[code]
        before = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(start[code] - before[:-1], n) + np.arange(before[-1])]
        return out, before[np.searchsorted(edges, offsets)]


@functools.lru_cache(2)
def tokenizer(path: str = VOCABULARY) -> Tokenizer:
    return Tokenizer(path)

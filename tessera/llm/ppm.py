"""Prediction by partial matching over bytes: contexts of up to three bytes, escape method C, symbol exclusion.

A symbol is coded in the longest context that the statistics hold. There, with T occurrences and D distinct symbols,
a known symbol of count c costs log2((T + D) / c) bits; an unknown one costs log2((T + D) / D) for the escape, and is
coded in the next shorter context, of which all symbols already refused are taken out. What even the empty context
lacks is uniform over the bytes that it lacks. Statistics are frozen: they do not change while a text is coded.

Contexts before a text's start read as NUL bytes. A gram is four bytes, the context's three and the symbol, as one
integer, oldest byte first.
"""

from __future__ import annotations

import numpy as np

ORDER = 3


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gram at each byte of texts that lie in data between the offsets."""
    key, context = data.astype(np.uint32), data.copy()
    starts = offsets[:-1][offsets[:-1] < len(data)]
    for k in range(1, ORDER + 1):
        context = np.concatenate([np.zeros(1, np.uint8), context[:-1]]) if len(context) else context
        context[starts] = 0
        key |= context.astype(np.uint32) << np.uint32(8 * k)
    return key


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _at(table: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values of wanted keys in a sorted table, 0 where absent."""
    if not len(table):
        return np.zeros(len(wanted), values.dtype if len(values) else np.int64)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[at] == wanted, values[at], 0)


def costs(wanted: np.ndarray, keys: np.ndarray, counts: np.ndarray, root: np.ndarray, longest: int = ORDER) -> np.ndarray:
    """Bits that each wanted gram costs under the statistics: grams (keys sorted) with counts, root: count by byte.

    keys must hold all grams whose context ends in the same byte as that of a wanted one; others don't matter.
    longest: bytes of context that are looked at.
    """
    bits, open_ = np.zeros(len(wanted)), np.ones(len(wanted), bool)
    child = None  # of the longer context: its symbols' grams in this order, by which they are excluded here
    for order in range(longest, -1, -1):
        low = np.uint64((1 << 8 * (order + 1)) - 1)
        if order:
            table, number = merged(keys & low, counts)
        else:
            table, number = np.arange(256, dtype=np.uint64)[root > 0], root[root > 0]
        context, first = np.unique(table >> np.uint64(8), return_index=True)
        total = np.add.reduceat(number, first) if len(first) else number[:0]
        kinds = np.diff(np.append(first, len(table)))
        here = wanted & low
        t, d, c = _at(context, total, here >> np.uint64(8)), _at(context, kinds, here >> np.uint64(8)), _at(table, number, here)
        if child is not None:
            owner, taken = np.unique(child >> np.uint64(8), return_index=True)
            longer = wanted & np.uint64((1 << 8 * (order + 2)) - 1)
            lost = _at(table, number, child & low)
            t = t - _at(owner, np.add.reduceat(lost, taken) if len(taken) else lost, longer >> np.uint64(8))
            d = d - _at(owner, np.diff(np.append(taken, len(child))), longer >> np.uint64(8))
        child = table
        live = open_ & (t > 0)  # else the context is unknown, or has nothing left: the escape is certain
        found = live & (c > 0)
        bits[found] += np.log2((t[found] + d[found]) / c[found])
        missed = live & (c == 0)
        bits[missed] += np.log2((t[missed] + d[missed]) / d[missed])
        open_ &= c == 0
    bits[open_] += np.log2(max(1, 256 - int((root > 0).sum())))
    return bits


class Trie:
    """Byte-context trie over sorted grams. A context holds a bit for each symbol that follows it and, for each 64 of
    them, where their values begin, so a value is found by a count of bits: 48 bytes a context and 4 a gram, whatever
    the symbols. Grams that it lacks have the value 0."""

    CONTEXT_BYTES, GRAM_BYTES = 48, 4

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = keys.astype(np.uint32)
        context, first = np.unique(keys >> np.uint32(8), return_index=True)
        self.cls = np.zeros(256, np.int32)  # symbols of the last place of a context; class 0: none
        seen = np.unique(context & np.uint32(255))
        self.cls[seen] = np.arange(1, len(seen) + 1)
        pairs = np.unique(context >> np.uint32(8))
        self.pair = np.zeros(65536, np.int32)
        self.pair[pairs] = np.arange(1, len(pairs) + 1)
        self.triple = np.zeros((len(pairs) + 1, len(seen) + 1), np.int32)
        self.triple[self.pair[context >> np.uint32(8)], self.cls[context & np.uint32(255)]] = np.arange(1, len(context) + 1)
        node = np.repeat(np.arange(1, len(context) + 1), np.diff(np.append(first, len(keys))))
        symbol = keys & np.uint32(255)
        word = node * 4 + (symbol >> np.uint32(6))
        self.bits = np.zeros(4 * (len(context) + 1), np.uint64)
        np.bitwise_or.at(self.bits, word, np.uint64(1) << (symbol & np.uint32(63)).astype(np.uint64))
        self.start = np.searchsorted(word, np.arange(len(self.bits))).astype(np.int32)
        self.value = np.append(values.astype(np.float32), np.float32(0))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        word = self.triple[self.pair[keys >> np.uint32(16)], self.cls[(keys >> np.uint32(8)) & np.uint32(255)]]
        symbol = (keys & np.uint32(255)).astype(np.uint8)
        word *= 4
        word += symbol >> np.uint8(6)
        bits = self.bits[word] << (np.uint8(63) - (symbol & np.uint8(63))).astype(np.uint64)  # the symbol's bit is now the highest
        at = self.start[word] + np.bitwise_count(bits).astype(np.int32)
        return self.value[np.where(bits >> np.uint64(63), at - 1, -1)]


def adaptive_bits(text: bytes) -> float:
    """Code length of one text under statistics that start empty and learn each byte after it is coded.

    Sequential by nature, so for single texts; whole tables are scored under frozen statistics.
    """
    held: list[dict[bytes, dict[int, int]]] = [{} for _ in range(ORDER + 1)]
    bits, padded = 0.0, bytes(ORDER) + text
    for i in range(ORDER, len(padded)):
        symbol, out, done = padded[i], set(), False
        for order in range(ORDER, -1, -1):
            here = {s: n for s, n in held[order].get(padded[i - order : i], {}).items() if s not in out}
            if not here:
                continue
            t, d = sum(here.values()), len(here)
            if done := symbol in here:
                bits += np.log2((t + d) / here[symbol])
                break
            bits += np.log2((t + d) / d)
            out |= set(here)
        if not done:
            bits += np.log2(max(1, 256 - len(out)))
        for order in range(ORDER + 1):
            node = held[order].setdefault(padded[i - order : i], {})
            node[symbol] = node.get(symbol, 0) + 1
    return float(bits)

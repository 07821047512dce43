import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import ppm
from tessera.llm.lang_id import Trees


def plain_counts(texts: list[bytes]) -> list[dict[bytes, Counter]]:
    held = [{} for _ in range(4)]
    for t in texts:
        t = bytes(3) + t
        for i in range(3, len(t)):
            for k in range(4):
                held[k].setdefault(t[i - k : i], Counter())[t[i]] += 1
    return held


def plain_bits(held: list[dict[bytes, Counter]], context: bytes, symbol: int) -> float:
    bits, out = 0.0, set()
    for k in range(len(context), -1, -1):
        here = {s: n for s, n in held[k].get(context[len(context) - k :], {}).items() if s not in out}
        if not here:
            continue
        t, d = sum(here.values()), len(here)
        if symbol in here:
            return bits + math.log2((t + d) / here[symbol])
        bits += math.log2((t + d) / d)
        out |= set(here)
    return bits + math.log2(max(1, 256 - len(held[0].get(b"", {}))))


def plain_text(held, text: bytes) -> float:
    padded = bytes(3) + text
    return sum(plain_bits(held, padded[i - 3 : i], padded[i]) for i in range(3, len(padded)))


def flat(texts: list[bytes]):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


texts = st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 5 for x in b)), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(texts, texts)
def test_costs_equal_a_plain_coder(learnt, coded):
    held = plain_counts(learnt)
    keys, counts = ppm.counted(ppm.grams(*flat(learnt)))
    root = np.bincount(np.frombuffer(b"".join(learnt), np.uint8), minlength=256)
    data, offsets = flat(coded)
    wanted = ppm.grams(data, offsets).astype(np.uint64)
    bits = ppm.costs(wanted, keys.astype(np.uint64), counts, root)
    for i, t in enumerate(coded):
        assert math.isclose(bits[offsets[i] : offsets[i + 1]].sum(), plain_text(held, t), abs_tol=1e-6)
    distinct, first = np.unique(wanted, return_index=True)
    trie = ppm.Trie(distinct, bits[first].astype(np.float32))
    assert np.allclose(trie(wanted.astype(np.uint32)), bits, atol=1e-4)


@settings(max_examples=40, deadline=None)
@given(texts, texts, st.lists(st.binary(max_size=15), min_size=1, max_size=4))
def test_trees_equal_a_plain_coder(one, two, coded):
    grams = [ppm.counted(ppm.grams(*flat(x))) for x in (one, two)]
    trees = Trees(["a", "b"], [k for k, _ in grams], [n for _, n in grams])
    bits = trees(*flat(coded))
    for j, learnt in enumerate((one, two)):
        held = plain_counts(learnt)
        assert np.allclose(bits[:, j], [plain_text(held, t) for t in coded], atol=1e-3)


def test_adaptive_learns():
    assert math.isclose(ppm.adaptive_bits(b"a"), 8)
    assert ppm.adaptive_bits(b"") == 0
    assert ppm.adaptive_bits(b"abcabcabcabcabcabc") < ppm.adaptive_bits(b"qwertzuiopasdfghjk")

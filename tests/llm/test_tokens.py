import numpy as np
import pyarrow as pa
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tessera.llm.token_binary import SAMPLE, EliasFano
from tessera.llm.tokens import tokenizer

text = st.text(st.sampled_from(" \n\t'abéßs1$  　\u0085  🙂\x1c중"), max_size=25)


@settings(max_examples=200, deadline=None)
@given(st.lists(text, max_size=5))
@example(["  a", "a  b", "a\u0085 b", "　 x", "  x", "  x", "a  b ", " ", ""])
def test_ids_equal_those_of_each_text(texts):
    t = tokenizer()
    ids, bounds = t(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [t.one(x) for x in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=3 * SAMPLE))
@example([0] * 200)
@example([1 << 40])
@example([0])
def test_elias_fano(steps):
    values = np.cumsum([0, *steps])
    ef = EliasFano.encode(values)
    assert ef.decode().tolist() == values.tolist() == [ef.select(i) for i in range(len(values))]
    assert len(ef.low) + len(ef.high) <= len(values) * (3 + max(0, np.log2(max(1, values[-1]) / len(values)))) / 8 + 2

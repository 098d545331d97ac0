import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tests.llm.conftest import ODD
from verdigris.llm import text as T


def check(texts, table, pattern):
    w = T.words(*T.buffers(pa.array(texts, pa.string())), table)
    want = [brute.words(t, pattern) for t in texts]
    assert np.diff(w.at).tolist() == [len(x) for x in want]
    seen = {}
    for word, h in zip((x for d in want for x in d), w.hash.tolist()):
        assert seen.setdefault(word, h) == h == T.word_hash(word)
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("table, pattern", [(T.SPACED, brute.SPACED), (T.ALNUM, brute.ALNUM)])
@pytest.mark.parametrize("size", [7, 64, 1 << 19])
def test_words(monkeypatch, table, pattern, size):
    monkeypatch.setattr(T, "SLICE", size)
    check(ODD, table, pattern)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text("aB 1é\n-", max_size=40), max_size=12), st.integers(1, 30))
def test_words_anywhere(texts, size):
    old, T.SLICE = T.SLICE, size
    try:
        check(texts, T.SPACED, brute.SPACED)
        check(texts, T.ALNUM, brute.ALNUM)
    finally:
        T.SLICE = old


def test_runs():
    b = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "c"]})
    assert [r.num_rows for r in T.runs(iter([b, b.slice(0, 0)]), size=20)] == [2, 1, 1]

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té中 \x0b", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_spans_are_the_words_of_the_pattern(texts):
    buf, off = W.string_parts(pa.array(texts, pa.string()))
    start, end, first = W.spans(buf, off)
    raw = buf.tobytes()
    found = [[raw[start[k]:end[k]].decode() for k in range(a, b)] for a, b in zip(first, first[1:])]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_equal_windows_have_equal_hashes(texts, size):
    buf, off = W.string_parts(pa.array(texts, pa.string()))
    start, end, first = W.spans(buf, off)
    raw = buf.tobytes()
    words = [raw[a:b] for a, b in zip(start, end)]
    hashes = W.window_hashes(W.word_hashes(buf, start, end), size)
    by_words = {}
    for k, h in enumerate(hashes.tolist()):
        assert by_words.setdefault(tuple(words[k:k + size]), h) == h
    assert len(set(by_words.values())) == len(by_words)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    assert W.within(first, size, len(words)).tolist() == [text[k] == text[k + size - 1] for k in range(len(hashes))]


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.randoms())
def test_kept_text_joins_kept_words(texts, rng):
    buf, off = W.string_parts(pa.array(texts, pa.string()))
    start, end, first = W.spans(buf, off)
    keep = np.array([rng.random() < 0.6 for _ in start], dtype=bool)
    out = W.text_array(*W.kept_text(buf, off, start, end, first, keep)).to_pylist()
    raw = buf.tobytes()
    assert out == [" ".join(raw[start[k]:end[k]].decode() for k in range(a, b) if keep[k]) for a, b in zip(first, first[1:])]


@given(st.lists(st.integers(0, 9), max_size=30), st.integers(1, 9))
def test_sliding(values, size):
    found = W.sliding(np.array(values, dtype=np.int64), size).tolist()
    assert found == [min(values[k:k + size]) for k in range(len(values) - size + 1)]


def test_slices_of_columns_are_read_from_their_own_offset():
    column = pa.array(["aa", None, "b c", "ddd"]).slice(1, 2)
    buf, off = W.string_parts(column)
    assert buf.tobytes() == b"b c" and off.tolist() == [0, 0, 3]

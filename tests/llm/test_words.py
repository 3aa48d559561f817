import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from bookloom.llm import words
from bookloom.llm.words import ALPHANUMERIC, BLANK_SEPARATED, hashed, sliced

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZz09 .\t\n\r\x0b\x7f{@é東", max_size=60)), max_size=8)
PATTERN = {"blank": r"[^\x20\x09-\x0D]+", "alnum": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}


def lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, piece):
    was, words.PIECE = words.PIECE, piece
    try:
        plain, low = hashed(pa.array(texts, pa.string())), hashed(pa.array(texts, pa.string()), ALPHANUMERIC, lower=True)
    finally:
        words.PIECE = was
    seen = {}
    for t, text in enumerate(texts):
        mine = re.findall(PATTERN["blank"], text or "")
        assert plain.joined(t).decode() == " ".join(mine)
        keep = np.arange(len(mine)) % 2 == 0
        assert plain.joined(t, keep).decode() == " ".join(mine[::2])
        mine = re.findall(PATTERN["alnum"], lower(text or ""))
        got = low.hash[low.first[t]:low.first[t + 1]].tolist()
        assert len(got) == len(mine)
        for word, h in zip(mine, got):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=30), min_size=1, max_size=6), st.integers(1, 4))
def test_equal_runs_have_equal_hashes(texts, n):
    w = hashed(pa.array(texts))
    runs, rest, spans = w.runs(n), w.rest(), {}
    by = {}
    for t, text in enumerate(texts):
        mine = text.split()
        for i in range(len(mine) - n + 1):
            at = int(w.first[t]) + i
            assert rest[at] == len(mine) - i
            assert by.setdefault(tuple(mine[i:i + n]), runs[at]) == runs[at]
            h = w.spans(np.array([at]), np.array([n]))[0]
            assert spans.setdefault(tuple(mine[i:i + n]), h) == h
    assert len(set(by.values())) == len(by) == len(set(spans.values()))


def test_sliced_array_and_slices_keep_every_row(monkeypatch):
    texts = ["a b c", None, "", "d " * 50, "e"]
    column = pa.array(["x", *texts])[1:]
    assert [hashed(column).joined(t).decode() for t in range(5)] == ["a b c", "", "", " ".join("d" * 50), "e"]
    monkeypatch.setattr(words, "SLICE", 4)
    parts = list(sliced([pa.RecordBatch.from_arrays([column], ["t"])], "t"))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert len(parts) > 2


@pytest.mark.parametrize("member", [BLANK_SEPARATED, ALPHANUMERIC])
def test_a_word_longer_than_a_piece(member):
    w = hashed(pa.array(["z" * 700_000 + " y", "z" * 700_000]), member)
    assert np.diff(w.first).tolist() == [2, 1] and w.hash[0] == w.hash[2]

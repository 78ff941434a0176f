import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from glossaflow.llm import words as W

TEXT = st.one_of(st.none(), st.text(st.sampled_from("ab Cé\n\t\x0b\x1c x漢"), max_size=60))


@settings(deadline=None, max_examples=200)
@given(st.lists(TEXT, max_size=8), st.integers(1, 40))
def test_split_matches_bytes_split(texts, limit):
    got = []
    for row, data, offsets in W.blocks(pa.array(texts, pa.string()), limit):
        assert row == len(got)
        words = W.split(data, offsets, lower=True)
        vocab = words.vocab.to_pylist()
        hashes = words.hashes()
        for a, b in zip(words.bounds[:-1], words.bounds[1:]):
            got.append([vocab[c] for c in words.codes[a:b]])
        each = {}
        for c, h in zip(words.codes.tolist(), hashes.tolist()):
            assert each.setdefault(c, h) == h
        assert len(set(each.values())) == len(each)
    assert got == [(t or "").encode().lower().split() for t in texts]


def test_windows_stay_inside_their_text():
    (_, data, offsets), = W.blocks(pa.array(["a b c", "", "d e", "f g h i"]))
    words = W.split(data, offsets)
    assert words.windows(3).tolist() == [0, 5, 6]
    h = W.window_hashes(words.hashes(), words.windows(3), 3)
    assert len(np.unique(h)) == 3


def test_long_words_and_slices():
    texts = pa.array(["skip", "x" * 5000 + " " + "x" * 5001, None]).slice(1)
    (_, data, offsets), = W.blocks(texts)
    words = W.split(data, offsets)
    assert np.diff(words.bounds).tolist() == [2, 0]
    assert words.hashes()[0] != words.hashes()[1]

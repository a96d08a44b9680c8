import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from seriate.llm import textkit

TEXT = st.text(alphabet="ab Z\t\n\x0b\x1cé  語", max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8))
def test_words_are_those_of_the_pattern(texts):
    data, offsets = textkit.utf8(pa.array(texts, pa.string()))
    starts, ends, bounds = textkit.word_spans(data, offsets)
    raw = data.tobytes()
    for k, t in enumerate(texts):
        want = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        assert [raw[a:b] for a, b in zip(starts[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]], strict=True)] == want


def test_hashes_do_not_depend_on_the_place(monkeypatch):
    words = [b"a", b"ab", b"ba", b"word", b"Word", b"x" * 700, b"a"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = textkit.word_spans(data, np.array([0, len(data)]))
    whole = textkit.hash_spans(data, starts, ends)
    monkeypatch.setattr(textkit, "BLOCK", 8)
    assert (textkit.hash_spans(data, starts, ends) == whole).all()
    assert whole[0] == whole[6] and len(set(whole.tolist())) == 6
    folded = textkit.hash_spans(data, starts, ends, fold=True)
    assert folded[3] == folded[4]


def test_windows_of_both_kinds_compare_sequences():
    h = np.array([5, 6, 7, 8, 9, 5, 6, 7, 8, 9, 1] * 2, np.uint64)
    for n in (5, 9):
        w = textkit.windows(h, n, 1).tolist()
        seen = [tuple(h[i : i + n].tolist()) for i in range(len(h) - n + 1)]
        assert len(w) == len(seen)
        assert all((w[i] == w[j]) == (seen[i] == seen[j]) for i in range(len(w)) for j in range(len(w)))
    assert len(textkit.windows(h[:3], 5, 1)) == 0


def test_groups_cover_all_rows():
    offsets = np.array([0, 5, 5, 100, 103, 110])
    assert list(textkit.groups(offsets, 10)) == [(0, 2), (2, 3), (3, 5)]

import re

import numpy as np
import pytest

from dossier.llm import words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = [b"", None, b"  ", b"a", b"a b", "Über die\tBrücke\x0b geht\xa0er".encode(), b"x " * 50, b"one two three four five six", b"\n\nq\n"]


def test_scan_finds_the_words():
    for t in TEXTS:
        s, e, h = words.scan(t or b"")
        assert [(t or b"")[a:b] for a, b in zip(s, e)] == WORD.findall(t or b"")
        assert len(h) == len(s)


def test_equal_words_hash_equally_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 16)
    long = b"alpha beta " * 20 + b"w" * 100 + b" alpha"
    s, e, h = words.scan(long)
    found = {}
    for a, b, x in zip(s, e, h):
        assert found.setdefault(long[a:b], x) == x
    assert len(set(found.values())) == len(found) == 3


def test_shingle_sets_against_tuples():
    for size in (2, 5):
        for t, got in zip(TEXTS, words.shingle_sets(TEXTS, size)):
            w = WORD.findall(t or b"")
            want = {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
            assert len(got) == len(want)
            assert (np.sort(got) == got).all()


@pytest.mark.parametrize("limit", [1, 10, 1000])
def test_batches_cover_all_texts_once(limit):
    runs = list(words.batches(TEXTS, limit))
    assert [i for a, b in runs for i in range(a, b)] == list(range(len(TEXTS)))

"""Expected piece uses against all segmentations, and of long runs in full."""

import numpy as np
import pytest

from pactum.llm.lattice import MARK, PieceTable, rank_prior, vocabulary
from pactum.llm.lm_scoring import UNKNOWN, VOCABULARY


def _segmentations(word, weight, unknown):
    if not word:
        yield 1.0, []
    for k in range(1, len(word) + 1):
        if w := weight.get(word[:k]) or (unknown if k == 1 else 0.0):
            for rest, used in _segmentations(word[k:], weight, unknown):
                yield w * rest, [word[:k], *used]


def test_all_segmentations():
    pieces = [MARK, MARK + "a", "a", "b", "ab", "ba", "aba", MARK + "ab"]
    weights = np.array([0.05 + 0.03 * i for i in range(len(pieces))])
    words, times = ["a", "abab", "bazab", "", "ababababab", "zz"], np.array([[1.0, 2], [3, 0], [1, 1], [5, 1], [0, 2], [1, 1]])
    want = np.zeros((len(pieces), 2))
    for word, t in zip(words, times, strict=True):
        found = list(_segmentations(MARK + word, dict(zip(pieces, weights, strict=True)), 1e-4))
        total = sum(w for w, _ in found)
        for w, used in found:
            for p in used:
                if p in pieces:
                    want[pieces.index(p)] += w / total * t
    assert PieceTable(pieces).expected_counts(words, times, weights, 1e-4) == pytest.approx(want)


@pytest.fixture(scope="module")
def model():
    rows = vocabulary(VOCABULARY)
    return [p for _, p, _ in rows], PieceTable([p for _, p, _ in rows]), rank_prior([s for *_, s in rows])


@pytest.mark.parametrize("size", [10, 100, 300, 5000])
@pytest.mark.parametrize("run", ["中国人民大学", "8141592653", "internationalization", "ab"])
def test_characters_add_up(model, run, size):
    pieces, table, prior = model
    got = table.expected_counts([(run * size)[:size]], np.ones((1, 1)), prior, UNKNOWN)[:, 0]
    assert np.dot(got, [len(p) for p in pieces]) == pytest.approx(size + 1)


def test_unknown_characters_leave_the_rest_counted(model):
    pieces, table, prior = model
    unknown = "\U0001f9ff" * 200
    assert "\U0001f9ff" not in pieces
    got = table.expected_counts([unknown + "river" + unknown], np.ones((1, 1)), prior, UNKNOWN)[:, 0]
    assert np.dot(got, [len(p) for p in pieces]) == pytest.approx(6)

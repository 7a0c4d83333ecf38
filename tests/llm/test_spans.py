"""Cutting, counting and looking up of chunks against plain Python."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pactum.llm import piece_encoding, spans

PIECES = [" ", "a", "b", "ab", " a", "ba", "c", "--", "x"]
TEXTS = ["abab-- c", None, "", "ba" * 700 + "é" + "-" * 50, "c", "x ab", "\U0001f600ab", "abab-- c"]


def _split(text):
    pairs = {p[k : k + 2] for p in PIECES for k in range(len(p) - 1)}
    out = []
    for c in " " + text if text else "":
        if out and out[-1][-1] + c in pairs:
            out[-1] += c
        else:
            out.append(c)
    return out


@pytest.mark.parametrize("size", [10, 64, 10_000])
def test_passes(size):
    cut = spans.Cutter(PIECES)
    assert [cut.split(t) for t in TEXTS] == [_split(t) for t in TEXTS]
    got = [[] for _ in TEXTS]
    counts = Counter()
    for low, high, passes in cut.passes(pa.array(TEXTS), size):
        for some in passes:
            found = some.chunks(np.arange(len(some.at)))
            rows = low + np.repeat(np.arange(len(some.counts)), some.counts)
            assert len(rows) == len(found) and len(some.counts) in (1, high - low)
            for row, chunk in zip(rows, found, strict=True):
                got[row].append(chunk)
            counts.update(dict(zip(*some.counted(np.arange(len(some.at))), strict=True)))
    assert got == [_split(t) for t in TEXTS]
    assert counts == Counter(c for t in TEXTS for c in _split(t))


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(spans.Pass, "hashes", lambda self: np.full(len(self.at), 5, np.uint64))
    some = next(next(spans.Cutter(PIECES).passes(pa.array(TEXTS)))[2])
    known = spans.Dictionary(["c", " "])
    found = dict(zip(some.chunks(np.arange(len(some.at))), known.find(some).tolist(), strict=True))
    assert {c for c, at in found.items() if at >= 0} <= {"c", " "} and all(["c", " "][at] == c for c, at in found.items() if at >= 0)


def test_dictionary():
    words = [f"w{k}" for k in range(5000)] + ["é" * 300]
    known = spans.Dictionary(words)
    assert known.find(spans.Pass([*words[::-1], "w", "w5000", "é" * 299])).tolist() == [*range(5000, -1, -1), -1, -1, -1]
    assert spans.Dictionary([]).find(spans.Pass(words)).tolist() == [-1] * len(words)


def test_cuts_of_the_public_vocabulary_cross_no_piece():
    cut = piece_encoding.cutter()
    for _, p, _ in piece_encoding.vocabulary(piece_encoding.VOCABULARY):
        assert not cut.cuts(spans.code_points(p.replace(piece_encoding.MARK, " ")))[1:].any()

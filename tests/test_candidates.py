"""Pairs of units that meet on rare words, against all pairs of a comparison."""

import random
from difflib import SequenceMatcher

import pytest

from pactum.operators import compare


def _units(rng, n):
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    out = []
    for _ in range(n):
        base = rng.choice(out) if out and rng.random() < 0.4 else rng.choices(words, weights, k=rng.randrange(60))
        out.append([w if rng.random() < 0.7 else rng.choice(words) for w in base])
    return out


@pytest.mark.parametrize("least", [compare.GRAY, compare.SAME, 0.95])
def test_no_pair_is_lost(spark, least):
    rng = random.Random(5)
    sides, want = ([], []), set()
    for c in range(4):
        old = _units(rng, 25)
        new = [[w for w in u if rng.random() < 0.8] for u in old[::2]] + _units(rng, 12) + [[], ["w0"] * 40]
        for side, units in zip(sides, (old, new), strict=True):
            side.extend((c, k, u) for k, u in enumerate(units))
        for i, a in enumerate(old):
            for j, b in enumerate(new):
                if (1.0 if not a and not b else SequenceMatcher(None, a, b).ratio() if a and b else 0.0) >= least:
                    want.add((c, i, j))
    old, new = (spark.createDataFrame(rows, f"c int, {at} int, k{at} array<string>") for rows, at in zip(sides, "ij", strict=True))
    got = [tuple(r) for r in compare.candidates(old, new, "c", least).collect()]
    assert len(got) == len(set(got)) and want and want <= set(got)
    assert all(i < 25 for _, i, _ in got) and len(got) < 4 * 25 * 27


def test_common_words_alone_make_no_pair(spark):
    rows = lambda at, side: spark.createDataFrame([("c", k, ["the", "of", "and"] + [f"{side}{k}x{m}" for m in range(9)]) for k in range(200)], f"c string, {at} int, k{at} array<string>")
    assert compare.candidates(rows("i", "old"), rows("j", "new"), "c", compare.GRAY).count() == 0
    assert compare.candidates(rows("i", "one"), rows("j", "one"), "c", compare.GRAY).count() == 200


def test_empty_sides(spark):
    none = lambda at: spark.createDataFrame([], f"c string, {at} int, k{at} array<string>")
    blank = lambda at: spark.createDataFrame([("c", 0, [])], f"c string, {at} int, k{at} array<string>")
    assert compare.candidates(none("i"), blank("j"), "c", 0.5).count() == 0
    assert [tuple(r) for r in compare.candidates(blank("i"), blank("j"), "c", 0.5).collect()] == [("c", 0, 0)]

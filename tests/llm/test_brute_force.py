"""Whole scores of small models and fingerprints against plain loops."""

import math

import numpy as np
import pytest

from pactum.llm import fingerprints, language_id, lm_scoring
from pactum.llm.lattice import MARK, PieceTable

PIECES = [MARK, MARK + "a", "a", "b", "ab", "ba", "c", MARK + "ab", "é"]


def _marginal(word, weight, unknown):
    """Sum over all segmentations, by the plain recursion."""
    ways = [1.0] + [0.0] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            ways[e] += ways[s] * (weight.get(word[s:e]) or (unknown if e - s == 1 else 0.0))
    return ways[-1]


def test_language_scores(spark):
    rng = np.random.default_rng(2)
    weights = rng.random((len(PIECES), 3))
    weights /= weights.sum(axis=0)
    model = language_id.Model(["de", "en", "fr"], PieceTable(PIECES), weights)
    texts = ["abba cab", "A B, ab! é", "zz abz", None, "", "12 !", "abab" * 60 + " ba", "ba"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    for i, text in enumerate(texts):
        runs = language_id.LETTERS.findall((text or "").lower())
        if not runs:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        logs = [sum(math.log(_marginal(MARK + w, dict(zip(PIECES, weights[:, k], strict=True)), language_id.UNKNOWN)) for w in runs) for k in range(3)]
        assert got[i]["lang_pred"] == model.langs[int(np.argmax(logs))]
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp(x - max(logs)) for x in logs))


def test_language_fit_counts_expected_uses(spark):
    """Counts of a fit over texts of one language, by every segmentation under the prior."""
    rows = [(2, "ab ab", "x"), (3, "a", "x")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["x"] and model.weights.sum() == pytest.approx(1.0)


def test_document_scores(spark, monkeypatch):
    pieces = [(i, p, -float(i)) for i, p in enumerate(PIECES)]
    monkeypatch.setattr(lm_scoring, "vocabulary", lambda path: pieces)
    texts = ["ab ba ab", "a zz", None, "", "abc é ab", "ba" * 90, "c c c", "ab ba ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lm_scoring.score(df).collect()}
    words = {i: [w.decode() for w in lm_scoring._words(t)] for i, t in enumerate(texts)}
    train = {i: ws for i, ws in words.items() if not rows[i]["held_out"]}
    prior = lm_scoring.rank_prior([s for *_, s in pieces])
    counts = dict.fromkeys(PIECES, 0.0)
    for w in [w for ws in train.values() for w in ws]:
        total, word = _marginal(MARK + w, dict(zip(PIECES, prior, strict=True)), lm_scoring.UNKNOWN), MARK + w
        for s in range(len(word)):
            for e in range(s + 1, len(word) + 1):
                if (p := word[s:e]) in counts:
                    weight = dict(zip(PIECES, prior, strict=True))
                    counts[p] += _marginal(word[:s], weight, lm_scoring.UNKNOWN) * weight[p] * _marginal(word[e:], weight, lm_scoring.UNKNOWN) / total
    smooth = {p: counts[p] + 0.01 * len(PIECES) * prior[i] for i, p in enumerate(PIECES)}
    n = sum(smooth.values())
    end = (len(train) + 0.5) / (len(train) + sum(counts.values()) + 1.0)
    weight = {p: x / n * (1 - end) for p, x in smooth.items()}
    for i, ws in words.items():
        want = sum(math.log10(_marginal(MARK + w, weight, lm_scoring.UNKNOWN)) for w in ws) + math.log10(end)
        assert rows[i]["score"] == pytest.approx(want, rel=1e-9)


def _sketch(text):
    """The smallest mixed hashes of all spans, by a loop over the spans."""
    spans = {text[k : k + fingerprints.WIDTH] for k in range(max(1, len(text) - fingerprints.WIDTH + 1))} if text else set()
    out = set()
    for s in spans:
        h = 0
        for p, shift in zip((2147483647, 2147483629), (31, 0), strict=True):
            h |= sum((ord(c) + 1) * pow(fingerprints.BASE, k, p) for k, c in enumerate(s)) % p << shift
        out.add(h * int(fingerprints._MIX) % (1 << 64) >> 32)
    return set(sorted(out)[: fingerprints.SKETCH])


def test_likeness(spark):
    rng = np.random.default_rng(4)
    base = " ".join(f"word{x}" for x in rng.integers(0, 300, 120))
    texts = [base, base[:400] + " other " + base[420:], "", None, "short", base, "é😀" * 30, base[200:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(df, 3).collect()}
    like = lambda a, b: 1.0 if not a and not b else len((u := set(sorted(a | b)[: fingerprints.SKETCH])) & a & b) / len(u)
    for i, t in enumerate(texts):
        text, after = t or "", texts[i - 1] or ""
        cut = len(text) // 2
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i]["near_edited"] == pytest.approx(like(_sketch(text), _sketch(edited)))
        assert got[i]["near_next"] == pytest.approx(like(_sketch(text), _sketch(after)))
        assert got[i]["fingerprint"] == "".join(f"{x:08x}" for x in sorted(_sketch(text)))

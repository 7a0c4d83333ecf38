"""Runs without white space, however long, take the best path of their whole lattice."""

import math

import pytest

from pactum.llm import piece_encoding

RUNS = ["internationalization" * 60, "東京大学の研究者は新しい方法を発表した" * 40, "x" + " " * 1500 + "end", "aGVsbG8gd29ybGQ" * 90 + " short " + "https://example.org/a/path?with=values&" * 30, "😀ab" * 300]


def _best(chunk, score, longest):
    best = [0.0] + [-math.inf] * len(chunk)
    for e in range(1, len(chunk) + 1):
        for s in range(max(0, e - longest), e):
            best[e] = max(best[e], best[s] + score.get(chunk[s:e], piece_encoding.UNKNOWN_SCORE if e - s == 1 else -math.inf))
    return best[-1]


def test_long_runs(spark):
    pieces, longest, _ = piece_encoding.piece_table(spark, piece_encoding.VOCABULARY)
    score = {r["piece"]: r["score"] for r in pieces.collect()}
    df = spark.createDataFrame(list(enumerate(RUNS)), "doc_id long, text string")
    got = piece_encoding.decode(piece_encoding.encode(df)).collect()
    assert len(got) == len(RUNS)
    for r in got:
        assert r["decoded"] == RUNS[r["doc_id"]]
        assert r["score"] == pytest.approx(_best(" " + RUNS[r["doc_id"]], score, longest), rel=1e-12)


def test_loop_and_fold_agree(spark, monkeypatch):
    texts = ["the quick brown fox", "Straße  und\tGrüße", "internationalization 12345", "日本 😀 aaaaaaaa" * 3]
    rows = sorted({c for t in texts for c in piece_encoding.cutter().split(t)})
    df = spark.createDataFrame([(c, 1) for c in rows], "chunk string, n long")
    folded = {r["chunk"]: r for r in piece_encoding.best_paths(df).collect()}
    monkeypatch.setattr(piece_encoding, "LONG_CHUNK", 0)
    looped = {r["chunk"]: r for r in piece_encoding.best_paths(df).collect()}
    assert folded == looped and set(looped) == set(rows)

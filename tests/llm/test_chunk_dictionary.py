"""The dictionary of common chunks: written by a task, read in parts, whole."""

import numpy as np

from pactum.llm import piece_encoding
from pactum.llm.spans import Pass


def _lexicon(spark, rows):
    return spark.createDataFrame(rows, "chunk string, n long, score double, ids array<int>")


def test_written_in_parts(spark, monkeypatch):
    monkeypatch.setattr(piece_encoding, "PART", 1000)
    rows = [(f"chunk{k}", 5, -float(k), [k, k + 1]) for k in range(3000)]
    known, (flat, starts, lengths, scores) = piece_encoding._dictionary(piece_encoding._common(_lexicon(spark, rows), 3), 3)
    at = known.find(Pass([r[0] for r in rows] + ["chunk"]))
    assert at[-1] == -1 and sorted(at[:-1].tolist()) == list(range(3000))
    assert np.array_equal(scores[at[:-1]], [r[2] for r in rows]) and set(lengths.tolist()) == {2}
    assert np.array_equal(flat[starts[at[:-1]]], range(3000))


def test_no_chunk(spark):
    known, (flat, *_) = piece_encoding._dictionary(piece_encoding._common(_lexicon(spark, []), 3), 3)
    assert len(flat) == 0 and known.find(Pass(["a"])).tolist() == [-1]

"""The fold over many lattices at a time, and what hashing a dictionary leaves in a worker."""

import random

import numpy as np
import pyarrow as pa

from pactum.llm import piece_encoding, spans


def test_many_lattices_fold_as_one_by_one_does():
    rng = random.Random(3)
    texts = sorted({"".join(rng.choice("abc") for _ in range(k)) for k in (1, 2, 3) for _ in range(40)})
    # Few different scores, so that many paths are equally good.
    worth = np.array([float(-rng.randrange(1, 4)) for _ in texts])
    pieces = {t: (i, worth[i]) for i, t in enumerate(texts) if t != "b"}
    chunks = ["".join(rng.choice("abcé😀") for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    lattices = []
    for chunk in chunks:
        edges = []
        for s in range(len(chunk)):
            for k in range(1, min(3, len(chunk) - s) + 1):
                found = pieces.get(chunk[s : s + k])
                if found or k == 1:
                    p, i = len(chunk) - s, found[0] if found else -ord(chunk[s]) - 1
                    edges.append((((p << piece_encoding.PLACE_BITS) + p - k) << piece_encoding.ID_BITS) + i + piece_encoding.LEAST_ID)
        rng.shuffle(edges)
        lattices.append(edges)
    score, ids = piece_encoding.fold_edges(pa.array(lattices, pa.list_(pa.int64())), worth)
    assert list(zip(score.tolist(), ids.to_pylist(), strict=True)) == [piece_encoding.best_path(c, pieces, 3) for c in chunks]
    score, ids = piece_encoding.fold_edges(pa.array([], pa.list_(pa.int64())), worth)
    assert len(score) == len(ids) == 0


def test_hashing_a_dictionary_keeps_little(monkeypatch):
    monkeypatch.setattr(spans.Powers, "up", np.empty(0, np.uint64))
    monkeypatch.setattr(spans.Powers, "down", np.empty(0, np.uint64))
    chunks = [f" chunk{i}é" for i in range(100_000)]
    known = spans.Dictionary(chunks)
    # Powers are kept from then on; they were as many as all chunks have characters.
    assert len(spans.Powers.up) < 500_000 < sum(map(len, chunks))
    some = [*chunks[::7], " chunk"]
    assert known.find(spans.Pass(some)).tolist() == [*range(0, len(chunks), 7), -1]

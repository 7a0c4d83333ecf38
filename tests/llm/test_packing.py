"""Packing: every id in exactly one piece, sequences without holes or padding, neighbours close."""

import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from pactum.llm import packing, queries

SCHEMA = "doc_id long, text string, lang string, row long, tokens int, ids int, v1 string, position int, place int, part int, whole int, start int, length int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "l", 1, 1, 1, "v", 1, 1, 1, 1, 1, 1) for i, t in texts], SCHEMA)


def check(pieces, texts, length):
    """Pieces against the ids of the tokenizer's own library."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.TOKENIZER)
    want = Counter((i, tuple([*own.encode(t or "", add_special_tokens=False).ids, packing.END])) for i, t in texts)
    by_sequence = defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_sequence[r["sequence_id"]].append(r)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length and at & (at - 1) == 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    # Pieces in order of their sequences give the documents again, one after the other.
    got, ids = Counter(), []
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["start"] == len(ids)
        ids += np.frombuffer(r["ids"], "<u4").tolist()
        if len(ids) == r["doc_tokens"]:
            got[r["doc_id"], tuple(ids)] += 1
            ids = []
    assert not ids and got == want
    assert sum(len(x) for _, x in want.elements()) - length * sum(sum(r["length"] for r in rows) == length for rows in by_sequence.values()) < length


EDGES = [(1, None), (2, ""), (2, ""), (None, "no id"), (None, "no id"), (None, None), (3, "x" * 9000), (4, "word " * 20_000), (5, "a <|endoftext|> b"), (6, "日本語 😀 ́"), (7, " \t\n ")]


@pytest.mark.parametrize("length", [1, 8, 2048])
def test_edges(spark, length):
    texts = EDGES if length > 1 else EDGES[:6]
    check(packing.pack(frame(spark, texts), length).collect(), texts, length)


def test_copies_and_empty_table(spark):
    texts = [(1, "the same text again")] * 700 + [(i, f"text number {i}") for i in range(300)]
    check(packing.pack(frame(spark, texts), 64).collect(), texts, 64)
    assert packing.pack(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        packing.pack(frame(spark, []), 100)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    pieces = packing.pack(docs).collect()
    check(pieces, texts, 2048)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    again = queries.op12_packing(spark, sf)
    assert again.columns == names
    assert Counter(tuple(r) for r in again.collect()) == Counter(tuple(r[n] for n in names) for r in pieces)
    # Neighbours along the curve share more content than documents taken at random.
    first = {r["doc_id"]: (r["sequence_id"], r["offset"]) for r in pieces if r["start"] == 0}
    words = {i: set((t or "").lower().split()) for i, t in texts}
    order = [i for i in sorted(first, key=first.get) if len(words[i]) > 20]
    alike = lambda pairs: np.mean([len(words[a] & words[b]) / len(words[a] | words[b]) for a, b in pairs])
    mixed = np.random.default_rng(1).permutation(order).tolist()
    assert alike(zip(order, order[1:])) > 1.5 * alike(zip(mixed, mixed[1:]))


def test_sequences(spark):
    pieces = packing.pack(frame(spark, EDGES), 32)
    rows = packing.sequences(pieces).collect()
    assert all(len(r["ids"]) == 4 * r["tokens"] for r in rows)
    assert sum(r["tokens"] for r in rows) == sum(r["length"] for r in pieces.select("length").collect())


def test_libraries_agree():
    """The rank table gives the ids of the tokenizer's library: each code point in context,
    long runs, the special token."""
    quick, own = packing.Encoder(packing.TOKENIZER, packing.RANKS), packing.Encoder(packing.TOKENIZER)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for texts in ([f"a{c}b {c}1{c}" for c in points[::7]], [" " * 5000, "\n" * 5000, "a" * 20_000, "日本" * 5000, "<|endoftext|>x <|endoftext|>\n", "it's  \n\n we'LL"]):
        assert list(map(list, quick(texts))) == list(map(list, own(texts)))


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (4, 2), (1, 4)])
def test_hilbert_visits_neighbours(n, bits):
    points = np.array(list(product(range(1 << bits), repeat=n)))
    place = packing.hilbert(points, bits)
    assert sorted(place) == list(range(len(points)))
    steps = np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(1)
    assert (steps == 1).all()

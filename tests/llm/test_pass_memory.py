"""What a pass over texts takes of a worker's memory, however many texts come at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from pactum.llm import piece_encoding, spans


def test_passes_over_many_texts_stay_small():
    cutter, known = spans.Cutter(["ab", "bc"]), spans.Dictionary([" ", "abc"])
    texts = pa.array(["abc d " * 500] * 700)
    spans.Powers.reach(1 << 19)
    tracemalloc.start()
    chunks = sum(len(known.find(some)) for _, _, passes in cutter.passes(texts) for some in passes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert chunks == 700 * (1 + 500 * 4)
    # 2.1 million characters; a pass of a million takes some 100 bytes a character.
    assert peak < 50e6


def test_encoding_with_and_without_a_common_dictionary(spark, monkeypatch):
    texts = ["the cat sat", "the cat", None, "", "ağaç 東京 the", "zzqx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {}
    for bound in (0, 5, 1 << 19):
        monkeypatch.setattr(piece_encoding, "DICTIONARY", bound)
        found[bound] = {r["doc_id"]: (r["text"], r["ids"], r["score"]) for r in piece_encoding.encode(docs).collect()}
    assert [found[0][i][0] for i in range(len(texts))] == texts
    for bound in (5, 1 << 19):
        for i in found[0]:
            assert found[bound][i][:2] == found[0][i][:2] and np.isclose(found[bound][i][2], found[0][i][2])


def test_round_trip_is_written_in_small_batches(spark, monkeypatch):
    sizes = []
    real = piece_encoding.stored
    monkeypatch.setattr(piece_encoding, "stored", lambda df, name, *a: sizes.append(name) or real(df, name, *a))
    rows = piece_encoding.round_trip(spark.createDataFrame([(1, "ab a")], "doc_id long, text string")).collect()
    assert [r["same"] for r in rows] == [True] and "pieces-rows" in sizes

"""The corpus pipeline on the whole small tables, stage by stage."""

import re
from collections import Counter

import corpus_pipeline

from pactum.llm import language_id


def test_stages_on_whole_tables(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf).write.parquet(str(tmp_path / str(at)))
        kept.append(spark.read.parquet(str(tmp_path / str(at))))
    ids = [Counter(r["doc_id"] for r in d.select("doc_id").collect()) for d in kept]

    pred = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert set(ids[1]) == {i for i, r in pred.items() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    assert len(ids[1]) > 0.9 * len(ids[0])

    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    best = {}
    for r in kept[1].collect():
        mark = (-len(r["text"]), r["doc_id"])
        best[plain(r["text"])] = min(best.get(plain(r["text"]), mark), mark)
    assert set(ids[2]) == {i for _, i in best.values()}

    shingles = {}
    for r in kept[2].collect():
        ws = r["text"].encode().lower().split()
        shingles[r["doc_id"]] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}
    near = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    left = sorted(ids[3])
    assert not any(near(shingles[i], shingles[j]) for k, i in enumerate(left) for j in left[k + 1 :])
    for i in set(ids[2]) - set(ids[3]):
        assert any(near(shingles[i], shingles[j]) for j in shingles if j != i)

    assert max(ids[4].values()) <= 2 and set(ids[4]) <= set(ids[3])
    assert ids[5] == ids[4] and kept[5].filter("not same").count() == 0

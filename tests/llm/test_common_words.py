"""Long words that stand in many texts, and rows that repeat very often."""

import pytest

from pactum.llm import lm_scoring

LONG = "http://example.org/" + "a-very-long-path/" * 12


def test_long_common_words_are_in_the_dictionary(spark):
    docs = spark.createDataFrame([(i, f"{LONG} word{i % 5}", i % 2 == 0) for i in range(60)], "doc_id long, text string, held_out boolean")
    words = lm_scoring.count_words(docs)
    places, uses, _ = lm_scoring._common(lm_scoring.score_words(words, lm_scoring.fit(words, 30)))
    entry = lm_scoring._entry(LONG.encode())
    assert len(entry) == 17 and uses[places[entry]] == 30
    assert lm_scoring._entry(b"word1") in places and LONG.encode() not in places


def test_scores_do_not_depend_on_the_dictionary(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{LONG}{i % 3} word{i % 5} {LONG}") for i in range(40)], "doc_id long, text string")
    read = lambda: {r["doc_id"]: r for r in lm_scoring.score(docs).collect()}
    with_, _ = read(), monkeypatch.setattr(lm_scoring, "DICTIONARY", 0)
    without = read()
    for i, r in with_.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (without[i]["n_tokens"], without[i]["n_known"], without[i]["train_tokens"])
        assert r["score"] == pytest.approx(without[i]["score"], rel=1e-9) and r["base_score"] == pytest.approx(without[i]["base_score"], rel=1e-9)


def test_very_many_equal_rows(spark):
    n = 3 * lm_scoring.COPIES + 5
    docs = spark.range(n).selectExpr("cast(null as long) doc_id", "'one two' text")
    rows = lm_scoring.score(docs).groupBy("doc_id", "n_tokens", "score").count().collect()
    assert [(r["doc_id"], r["n_tokens"], r["count"]) for r in rows] == [(None, 3, n)]

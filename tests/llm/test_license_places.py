"""Short notices word by word, and what the positional filter leaves out."""

from pactum.llm import license_scan

SCATTERED = [
    "Licensed under the Apache License, Version 1.1 or under the terms of 2 0 version 2",
    "It was released under a tree; it lies under the bridge of the mit press, whose mit license is old.",
    "this work is licensed under the gnu general public license version 2 and not version 3 of the license",
]
WHOLE = ["Licensed under the Apache License, Version 2.0", "It is released under the MIT license, and it lies under the bridge."]


def _scan(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in license_scan.scan(df, **how).collect()}


def test_scattered_pairs_are_no_notice(spark):
    got = _scan(spark, SCATTERED + WHOLE)
    assert [got[i]["labels"] for i in range(3)] == ["", "", ""]
    assert [got[i]["labels"] for i in (3, 4)] == ["apache-2", "mit"]
    assert all(got[i]["score"] == 0.0 for i in range(3)) and got[3]["score"] == 1.0


def test_a_short_notice_at_every_offset(spark):
    words = "released under the mit license".split()
    texts = [" ".join([*(f"f{k}" for k in range(n)), *words, "and", *words[:3]]) for n in range(100)]
    got = _scan(spark, texts)
    assert {r["labels"] for r in got.values()} == {"mit"}


def test_repeated_words_in_a_short_notice(spark):
    notices = [("x", "a b a b a c"), ("y", "c d")]
    got = _scan(spark, ["a b a c", "z a b a b a c", "a b a b z b a c", "a b a b a b a c d"], notices=notices)
    assert [got[i]["labels"] for i in range(4)] == ["", "x", "", "x,y"]


def test_positional_filter_rejects(spark):
    notice = [f"n{k}" for k in range(41)]
    # The rarest pairs of the notice stand in text 0, which goes on with other words.
    texts = [" ".join([*notice[:9], *(f"u{k}" for k in range(60))]), " ".join(notice)] + [" ".join(notice[8:]) for _ in range(3)]
    got = _scan(spark, texts, notices=[("x", " ".join(notice))])
    assert got[0]["n_candidates"] > 0 and got[0]["n_verified"] == 0 and got[0]["labels"] == ""
    assert got[1]["labels"] == "x" and got[1]["n_verified"] > 0

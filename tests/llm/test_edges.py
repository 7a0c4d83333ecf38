"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, clashing
column names and empty tables."""

from collections import Counter

import corpus_pipeline
import pytest

from pactum.llm import chat, exact_dedup, fingerprints, jaccard_join, language_id, license_scan, lm_scoring, mixing, piece_encoding, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, h int, key string, words int, size int, score string, lang_pred string, src int, part int, chunk int, ids int, k_id int, at int, w int"
LONG = " ".join(f"wort{i % 977} and the river {i}" for i in range(6000))
TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "hello world of rivers and stones"), (4, "hello world of rivers and stones"), (5, "hello world of rivers and  stones"),
    (6, "HELLO world of rivers and stones"), (7, LONG), (8, LONG + " end"), (9, "x" * 5000), (10, "日本語 text with 😀 and ́ marks"), (None, "a text without an id"), (11, "one"), (12, "one"),
    (13, "released under the MIT License by us"), (14, "12 34 !!"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "de"][k % 3], ["a", "b", None][k % 3], 0, "n", 1, "k", 1, 2, "s", "p", 1, 1, 1, 1, 1, 1, 1) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).cache()


OPERATORS = {
    "piece_encoding": piece_encoding.round_trip, "license_scan": license_scan.scan, "mixing": mixing.mix, "language_id": language_id.identify,
    "jaccard_join": jaccard_join.similar_groups, "fingerprints": fingerprints.fingerprints, "exact_dedup": exact_dedup.exact_groups, "lm_scoring": lm_scoring.score,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, name):
    out = OPERATORS[name](docs)
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter(i for i, _ in TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, sf, at):
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, docs, sf)
    if at < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    kept = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert kept and set(kept) <= {i for i, _ in TEXTS}
    assert stage(spark, spark.createDataFrame([], SCHEMA), sf).collect() == []


def test_pages(spark):
    schema = "page_id long, url string, html string, d string, refers_to string"
    big = "<p>" + "é" * 200
    rows = [(3, "u", big), (1, None, big), (1, None, big), (2, "u", None), (4, "a\nb", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", big), (7, "u", "y" * 3_000_000)]
    got = warc.archive_round_trip(spark.createDataFrame([(*r, "d", "r") for r in rows], schema)).collect()
    assert all(r["error"] is None for r in got) and len(got) == len(rows)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter([(3, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (None, "response", None), (7, "response", None)])
    assert warc.page_digests(spark.createDataFrame([], schema)).collect() == []


def test_conversations(spark):
    schema = "conv_id long, turn int, role string, text string, segments int, formatted int, state int, xs int"
    rows = [(1, 2, "assistant", "x"), (1, 1, "user", None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (None, 1, None, "[ROLE]t[|]"), (3, None, "tool[|]", "</s>&<&s>[INST]")]
    df = spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], schema)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    turns = {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in got.items()}
    assert turns == {1: [("user", ""), ("assistant", "x")], 2: [("assistant", ""), ("assistant", "")], None: [("", "[ROLE]t[|]")], 3: [("tool[|]", "</s>&<&s>[INST]")]}
    assert {k: r["state"] for k, r in got.items()} == {1: "assistant", 2: "error", None: "error", 3: "error"}
    assert chat.digest(chat.format_conversations(df.limit(0))).collect() == []

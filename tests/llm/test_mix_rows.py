"""The mix takes rows, whether or not they have an id of their own."""

from collections import Counter

from pactum.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, row string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "r") for r in rows], SCHEMA)


def test_rows_without_an_id_fill_their_source(spark):
    rows = [(None, f"a{k} " * 40, "a") for k in range(120)] + [(k, f"b{k} " * 40, "b") for k in range(120)]
    docs = _docs(spark, rows)
    target = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    out = mixing.repeat_by_mix(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())
    assert set(got) <= set(rows) and max(got.values()) <= 2
    for source in "ab":
        words = 40 * sum(n for (_, _, s), n in got.items() if s == source)
        assert abs(words - target[source]) <= 0.15 * target[source]


def test_repeated_rows_have_their_own_quota(spark):
    rows = [(1, "same words here " * 30, "a")] * 50 + [(k, f"b{k} " * 90, "b") for k in range(2, 40)] + [(None, "no id " * 45, "c")] * 40
    docs = _docs(spark, rows)
    plan = mixing.mix(docs).collect()
    assert len(plan) == len(rows)
    taken, target = Counter(), {}
    for r in plan:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in "abc")
    got = Counter(r["source"] for r in mixing.repeat_by_mix(docs).collect())
    assert all(abs(90 * got[s] - target[s]) <= 0.15 * target[s] for s in "abc")
    assert got == Counter(r["source"] for r in mixing.repeat_by_mix(docs).collect())

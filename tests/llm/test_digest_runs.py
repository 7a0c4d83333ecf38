"""Runs of digests: skewed copies, verified digests, any number of rounds."""

import pytest
from pyspark.sql import functions as F

from pactum.llm import exact_dedup


def test_many_rows_of_one_text_without_ids(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same  text").alias("text")).unionByName(spark.createDataFrame([(7, "same text"), (8, "other")], "doc_id long, text string"))
    got = exact_dedup.exact_groups(df)
    rows = {tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept").distinct().collect()}
    # The longest original stays; its rows repeat id and text, so they share the verdict.
    assert rows == {(None, None, n + 1, True), (7, None, n + 1, False), (8, 8, 1, True)}
    assert got.count() == n + 2
    assert exact_dedup.keep_first(df).count() == 2


def test_copies_lie_in_all_runs(spark):
    df = spark.range(0, 10_000, 1, 8).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    runs = exact_dedup.digests(df).groupBy("run").count().collect()
    assert len(runs) == exact_dedup.RUNS and max(r["count"] for r in runs) < 400


@pytest.mark.parametrize("runs", [1, 2, 64])
def test_any_number_of_rounds(spark, runs):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("text"))
    got = exact_dedup.exact_groups(df, runs=runs).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got} == {(i, i % 7, i < 7) for i in range(500)}


def test_runs_halve(spark):
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(spark.createDataFrame([(1, "a")], "doc_id long, text string"), runs=6)


def test_one_digest_of_unlike_texts_fails(spark):
    rows = spark.createDataFrame([(1, 1, "d", (5, 1), 0), (2, 1, "d", (6, 1), 1)], "doc_id long, n_chars long, text_sha256 string, check struct<hash: long, chars: int>, run int")
    with pytest.raises(Exception, match="unlike texts of one digest"):
        exact_dedup.merge_runs(rows)[1].collect()

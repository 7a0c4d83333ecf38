"""What the n-gram join leaves a worker and sends to it at a time."""

from pactum.llm import jaccard_join, piece_encoding
from pactum.storage import stored


def test_join_tasks_drop_a_kept_dictionary(spark, monkeypatch):
    docs, tasks = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, task, schema: tasks.append(task) or self)
    jaccard_join._survey(docs, 5)
    jaccard_join._prefixes(docs, 5, 80, jaccard_join.np.zeros(1 << jaccard_join.BUCKET_BITS, "int64"), frozenset())
    assert len(tasks) == 2
    for task in tasks:
        piece_encoding._HELD["somewhere"] = (1,)
        list(task(iter([])))
        assert not piece_encoding._HELD


def test_whole_sets_go_to_python_in_small_batches(spark, monkeypatch):
    rows = []
    real = jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name, *a, **how: rows.append((name, how.get("batch_rows"))) or real(df, name, *a, **how))
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words), (2, words + " more"), (3, "other words stand here by themselves")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.similar_groups(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert {n for name, n in rows if name == "jaccard-links"} == {jaccard_join.SET_ROWS}


def test_batches_are_as_long_as_asked(spark):
    def sizes(batches):
        for b in batches:
            yield b.select(["id"]).slice(0, 0) if b.num_rows <= 7 else b.select(["id"])

    assert stored(spark.range(100).coalesce(1).mapInArrow(sizes, "id long"), "short", batch_rows=7).count() == 0
    assert stored(spark.range(100).coalesce(1).mapInArrow(sizes, "id long"), "long").count() == 100

"""The full search: rows of one n-gram on a grid of cells, by length band, lose no pair."""

import random

import pytest
from pyspark.sql import functions as F

from pactum.llm import jaccard_join


def _rows(seed, many):
    """One n-gram that all hold, in sets of many sizes; a few share a component."""
    rnd = random.Random(seed)
    return [(7, node, rnd.choice([rnd.randint(1, 9), rnd.randint(1, 400), 100, 101]), 0, node % 11, 0, 0, 0, 0) for node in range(many)]


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
@pytest.mark.parametrize("side", [3, 1_000])
def test_every_pair_that_the_filters_pass(spark, monkeypatch, percent, side):
    monkeypatch.setattr(jaccard_join, "PAIRED_ROWS", side)
    rows = _rows(percent, 60)
    fields = "h long, node long, n int, pos int, root long, " + ", ".join(f"{g} long" for g in jaccard_join.SIGNS)
    got = [(r["a"], r["b"]) for r in jaccard_join._across(spark.createDataFrame(rows, fields), percent).collect()]
    want = set()
    for _, a, na, _, ra, *_ in rows:
        for _, b, nb, _, rb, *_ in rows:
            index = na - -(-2 * percent * na // (100 + percent))
            if (na, a) < (nb, b) and ra != rb and index >= 0 and nb * percent <= na * 100 and (100 + percent) * na >= percent * (na + nb):
                want.add((a, b))
    assert len(got) == len(set(got)) and set(got) == want and want


def test_groups_by_the_full_search_alone(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRED_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "STAR_TURNS", 0)
    rnd, texts = random.Random(5), []
    for group in range(12):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(8, 60))]
        for _ in range(6):
            words = list(base)
            for _ in range(rnd.randint(0, 2)):
                words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 9)}"
            texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    low = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if 100 * len(x & y) >= 80 * len(x | y):
                    low[i] = low[j] = min(low[i], low[j])
    assert got == dict(enumerate(low)) and len(set(low)) > 12


def test_needed_sets_are_those_of_the_pairs(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f {i}") for i in range(40)] + [(None, "a b c d e f 3")], "doc_id long, text string")
    meta = jaccard_join._survey(docs, 5).filter("kind = 0 and doc_id is not null")
    nodes = meta.groupBy("node").agg(F.min("doc_id").alias("doc_id")).cache()
    some = [r["node"] for r in nodes.filter("doc_id in (3, 5, 38)").collect()]
    pairs = spark.createDataFrame([(some[0], some[1]), (some[1], some[2])], "a long, b long")
    assert sorted(r["node"] for r in jaccard_join._needed_sets(docs, nodes, pairs, 5, frozenset()).collect()) == sorted(some)


def test_a_pair_comes_up_once_where_many_ngrams_are_shared(spark):
    """Forty near copies share most of thirty n-grams: no row for each n-gram of a pair."""
    rnd = random.Random(9)
    rows = []
    for node in range(40):
        own = sorted(rnd.sample(range(30), 29))
        rows += [(h, node, 400, pos, node, 0, 0, 0, 0) for pos, h in enumerate(own)]
    fields = "h long, node long, n int, pos int, root long, " + ", ".join(f"{g} long" for g in jaccard_join.SIGNS)
    got = [(r["a"], r["b"]) for r in jaccard_join._across(spark.createDataFrame(rows, fields), 85).collect()]
    assert set(got) == {(a, b) for a in range(40) for b in range(a + 1, 40)}
    assert len(got) == len(set(got))


def test_nearest_pairs_of_components_first(spark, monkeypatch):
    """A large group in the full search: few pairs are checked, and no link is lost."""
    monkeypatch.setattr(jaccard_join, "STAR_TURNS", 0)
    monkeypatch.setattr(jaccard_join, "FEW_PAIRS", 0)
    checked, plain = [], jaccard_join._checked

    def counted(docs, nodes, pairs, *rest):
        checked.append(pairs.count())
        return plain(docs, nodes, pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_checked", counted)
    rnd, texts = random.Random(6), []
    base = [f"w{i}" for i in range(200)]
    for _ in range(60):
        words = list(base)
        for k in rnd.sample(range(200), rnd.randint(1, 4)):
            words[k] = f"x{rnd.randint(0, 9)}"
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85).collect()}
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    low = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if 100 * len(x & y) >= 85 * len(x | y):
                    low[i] = low[j] = min(low[i], low[j])
    assert got == dict(enumerate(low))
    assert sum(checked) < 300  # of 1,770 pairs

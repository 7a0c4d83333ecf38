"""Connected components against union-find, row by row."""

import random
from collections import Counter

import pytest

from pactum.llm import jaccard_join
from pactum.llm.components import components


def _roots(links):
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return Counter((x, find(x)) for x in root if find(x) != x)


#: Finished stars and a link between two of their leaves.
STARS = [(x, 1) for x in (11, 12, 13, 14)] + [(x, 2) for x in (21, 22, 23)] + [(x, 3) for x in (31, 32)]


@pytest.mark.parametrize("links", [[(5, 1), (7, 5), (7, 2)], [*STARS, (13, 22)], [*STARS, (14, 23), (21, 32)]])
def test_stars_joined_at_their_leaves(spark, links):
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert Counter((r["node"], r["root"]) for r in got) == _roots(links)


def test_random_links(spark):
    rng = random.Random(11)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert Counter((r["node"], r["root"]) for r in got) == _roots(links)


def test_merged_labels_give_one_row_a_node(spark):
    labels = spark.createDataFrame(STARS, "node long, root long")
    got = jaccard_join._merged(labels, spark.createDataFrame([(13, 22), (23, 31)], "a long, b long")).collect()
    assert Counter(r["node"] for r in got) == Counter([2, 3, *(x for x, _ in STARS)]) and {r["root"] for r in got} == {1}

"""Components of link tables against a plain union-find."""

import random

import pytest

from meshwright.llm.graph import components


def plain(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


CASES = {
    "none": [],
    "star": [(1, i) for i in range(2, 30)],
    "chain": [(i, i + 1) for i in range(40)],
    "random": (lambda r: [(a, b) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(50)) if a != b])(random.Random(3)),
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    links = CASES[name]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == plain(links)

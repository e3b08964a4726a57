import random

import pytest

from nosoflow.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(5, 3), (3, 5), (5, 3)], [(i, i + 1) for i in range(60)], [(100, i) for i in range(50)], [(0, -i) for i in range(40)],
    [(random.Random(i).randrange(90), random.Random(-i - 1).randrange(90)) for i in range(70)]])
def test_equals_union_find(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == brute(edges)

"""Connected components against a plain search."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.helpers import components
from weekcast.llm.components import Forest, connected


def shapes():
    draw = random.Random(9)
    yield "path", [(i, i + 1) for i in range(40)]
    yield "shuffled path", (lambda p: list(zip(p, p[1:], strict=False)))(draw.sample(range(60), 60))
    yield "hub", [(500, i) for i in range(200)]
    yield "random", [(draw.randrange(120), draw.randrange(120)) for _ in range(90)]
    yield "loops and repeats", [(1, 1), (2, 1), (1, 2), (2, 1), (-5, 9)]
    yield "none", []


@pytest.mark.parametrize("name,links", list(shapes()))
def test_smallest_reachable_node(spark, name, links):
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r.id: r.component for r in connected(frame, "a", "b").collect()}
    want = components({x for p in links for x in p}, links)
    for node, least in want.items():
        assert found.get(node, node) == least


def test_forest():
    for _, links in shapes():
        pairs = [(a, b) for a, b in links if a >= 0]
        forest = Forest(600)
        if pairs:
            forest.add(*np.array(pairs).T)
        want = components(range(600), pairs)
        assert forest.root.tolist() == [want[i] for i in range(600)]

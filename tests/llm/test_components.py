import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelog.llm import common
from sievelog.llm.components import Forest, components, forest


def brute(edges):
    label = {}
    for u, v in edges:
        label.setdefault(u, u)
        label.setdefault(v, v)
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(label[u], label[v])
            if label[u] != low or label[v] != low:
                label[u] = label[v] = low
                changed = True
    return {u: r for u, r in label.items() if u != r}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=60))
def test_forest(edges):
    u, v = np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64)
    assert dict(zip(*(x.tolist() for x in forest(u, v)))) == brute(edges)
    held = Forest(limit=5)
    for a, b in edges:
        held.add(np.array([a]), np.array([b]))
    assert dict(zip(*(x.tolist() for x in held.fold()))) == brute(edges)


@pytest.mark.parametrize("kind", ["chain", "random", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(2)
    order = rng.sample(range(-100, 100), 200)
    edges = {"chain": list(zip(order, order[1:])), "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "star": [(5, x) for x in range(100)] + [(x, 5) for x in range(50)], "none": [(1, 1)]}[kind]
    found = components(spark.createDataFrame(edges, "u long, v long"), common.Scratch(spark, "t"))
    assert {r["node"]: r["root"] for r in found.collect()} == brute(edges)

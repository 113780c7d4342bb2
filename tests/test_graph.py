"""Components and hierarchies against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.operators.graph import block_labels, components
from skein.operators.hierarchy import hierarchy, paths, walk
from skein.session import Scratch

TWCS = "tweet_id long, in_response_to_tweet_id long"


def brute(rows):
    """root and depth of each id by walking up."""
    parent = {}
    for i, p in rows:
        if i is not None:
            parent[i] = p if p is not None else parent.get(i)
    out = {}
    for i in parent:
        seen, at = [], i
        while True:
            if at in seen:
                ring = seen[seen.index(at) :]
                out[i] = (min(ring), -1)
                break
            seen.append(at)
            p = parent[at]
            if p is None or p not in parent:
                out[i] = (at, len(seen) - 1)
                break
            at = p
    return out, parent


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
@settings(max_examples=60, deadline=None)
def test_block_labels_are_smallest_of_component(edges):
    n = 31
    got = block_labels(n, np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64))
    p = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(p[a], p[b])
            changed |= p[a] != low or p[b] != low
            p[a] = p[b] = low
    assert got.tolist() == p


@given(st.lists(st.integers(-1, 19), min_size=20, max_size=20))
@settings(max_examples=80, deadline=None)
def test_walk_matches_brute_force(up):
    root, depth, pre, below, ring, _ = walk(np.arange(20), np.array(up))
    want, _ = brute([(i, None if u < 0 else u) for i, u in enumerate(up)])
    assert [(r, d) for r, d in zip(root, depth)] == [want[i] for i in range(20)]
    for i in range(20):
        if depth[i] >= 0:
            inside = {j for j in range(20) if root[j] == root[i] and pre[i] < pre[j] <= pre[i] + below[i]}
            assert inside == {j for j in range(20) if j != i and i in chain(up, j)}


@given(st.lists(st.integers(-1, 11), min_size=12, max_size=12))
@settings(max_examples=80, deadline=None)
def test_walk_numbers_trees_under_cycles(up):
    root, _, pre, below, ring, _ = walk(np.arange(12), np.array(up))
    for i in range(12):
        assert (pre[i] < 0) == ring[i]
        if not ring[i]:
            inside = {j for j in range(12) if root[j] == root[i] and pre[i] < pre[j] <= pre[i] + below[i]}
            assert inside == {j for j in range(12) if j != i and i in chain(up, j)}


def test_positions_do_not_depend_on_the_limit(spark):
    rng = random.Random(7)
    rows = [*ROWS, *[(i, rng.choice([i - 1, rng.randrange(20, i)])) for i in range(21, 90)], (20, 24), (91, 20), (92, 91), (93, 91), (94, 92), (95, None), *[(i, rng.randrange(95, i)) for i in range(96, 150)]]
    df = spark.createDataFrame(rows, TWCS)
    one, two = ({r["id"]: (r["root"], r["pre"], r["below"]) for r in hierarchy(df, co_locate_rows=limit).collect()} for limit in (1_000_000, 2))
    assert one == two and {i for i, x in two.items() if x[1] is None} >= {6, 7, 9, 20, 24} and two[91][2] == 3 and two[8][1:] == (0, 0) and two[1][2] == 3


def chain(up, j):
    seen = []
    while j >= 0 and j not in seen:
        seen.append(j)
        j = up[j]
    return seen


ROWS = [(1, None), (2, 1), (3, 2), (3, None), (3, 2), (4, 99), (5, 4), (6, 7), (7, 6), (8, 7), (9, 9), (None, 1), (10, None), (11, 1)]


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_hierarchy(spark, limit):
    df = spark.createDataFrame(ROWS, TWCS).withColumn("component", F.lit("clash")).withColumn("id", F.lit(-5)).repartition(3)
    got = {r["id"]: (r["root"], r["depth"]) for r in hierarchy(df, co_locate_rows=limit).collect()}
    assert got == brute(ROWS)[0]
    rows = {r["id"]: r for r in hierarchy(df, co_locate_rows=limit).collect()}
    assert rows[5]["root_state"] == 2 and rows[3]["tree_rows"] == 6 and rows[6]["on_cycle"] and not rows[8]["on_cycle"]


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_paths(spark, limit):
    got = {r["id"]: list(r["path"]) for r in paths(spark.createDataFrame(ROWS, TWCS), co_locate_rows=limit).collect()}
    assert got == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [4], 5: [4, 5], 6: [], 7: [], 8: [], 9: [], 10: [10], 11: [1, 11]}


def test_deep_chain_and_hub(spark):
    n = 3000
    rows = [(i, i - 1 if i else None) for i in range(n)] + [(n + i, 5) for i in range(2000)]
    df = spark.createDataFrame(rows, TWCS).repartition(8)
    got = {r["id"]: (r["root"], r["depth"]) for r in hierarchy(df).collect()}
    assert got == {**{i: (0, i) for i in range(n)}, **{n + i: (0, 6) for i in range(2000)}}
    assert {r["id"]: (r["root"], r["depth"]) for r in hierarchy(df, co_locate_rows=10).collect()} == got


def test_empty(spark):
    df = spark.createDataFrame([], TWCS)
    assert hierarchy(df).count() == 0 and paths(df).count() == 0


def test_components_far_links(spark):
    rows = [(i, (i * 7919) % 500, 0) for i in range(500)] + [(1000, None, 0), (1001, 2000, 0), (1002, 2000, 0)]
    df = spark.createDataFrame(rows, "id long, link long, kind int").repartition(6)
    got = {r["id"]: r["component"] for r in components(df, Scratch(spark, "t")).collect()}
    assert got[1001] == 1001 and got[1002] == 1002 and got[1000] == 1000
    p = block_labels(500, np.arange(500), np.array([(i * 7919) % 500 for i in range(500)]))
    assert [got[i] for i in range(500)] == p.tolist()

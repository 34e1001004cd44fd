import random

from curator.llm.graph import components, spanning


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in parent}


def test_components(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(100, 220)]
    hub = [(500 + i, 300) for i in range(80)]
    some = [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    for edges in (chain + hub + some, chain[::-1], hub * 2, [(-5, 7), (7, -(1 << 62))], some):
        edges = [e for e in edges if e[0] != e[1]]
        rng.shuffle(edges)
        df = spark.createDataFrame([*edges, (4, 4), (None, 1)], "x bigint, y bigint").repartition(5)
        assert {r.node: r.component for r in components(df).collect()} == brute(edges)
    assert components(df.limit(0)).count() == 0


def test_spanning():
    import numpy as np

    a, b = spanning(np.array([3, 2, 9]), np.array([2, 1, 9]))
    assert dict(zip(a.tolist(), b.tolist())) == {3: 1, 2: 1}


def test_scratch_tables_go(spark):
    import os

    from curator.llm.common import kept, scratch_root, scratch_scope, written

    root = scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    with scratch_scope():
        with scratch_scope():
            inner = kept(written(spark.range(5)).where("id > 2"))
        assert inner.count() == 2 and len(set(os.listdir(root)) - before) == 1
        last = kept(inner.where("id > 3"))
    assert last.count() == 1 and len(set(os.listdir(root)) - before) == 1
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "a bigint, b bigint")
    with scratch_scope():
        assert components(edges).count() == 51
    assert len(set(os.listdir(root)) - before) == 1

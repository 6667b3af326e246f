import random

from evenkeel.llm.components import connected_components


def test_chains_stars_loops_and_repeats(spark):
    random.seed(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7), (8, 9), (9, 8), (8, 9), (None, 3), (3, None)]
    edges += [(random.randint(1000, 1200), random.randint(1000, 1200)) for _ in range(120)]
    random.shuffle(edges)
    parent = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0

import random

from sparkloom.operators import graph


def test_components(spark):
    draw = random.Random(3)
    chain = [(k, k + 1) for k in range(100, 180)]
    edges = chain + [(draw.randrange(90), draw.randrange(90)) for _ in range(50)]
    root = {n: n for e in edges for n in e}
    for a, b in edges * len(root):
        if root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {n: low if r == high else r for n, r in root.items()}
    found = graph.components(spark.createDataFrame(edges, "a int, b int").repartition(3))
    assert {r.node: r.root for r in found.collect()} == root
    assert graph.components(found.limit(0).selectExpr("node AS a", "root AS b")).count() == 0

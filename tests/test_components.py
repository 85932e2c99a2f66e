import random

from sparkgate.operators.components import connected_components


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2300)]
    links += [(None, 3), (4, None), (7, 7), links[0], links[0][::-1]]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == brute(links)


def test_components_of_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0

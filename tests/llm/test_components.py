import random

from corvane.llm.components import components, joined


def brute(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((root(a), root(b)))
            up[hi] = lo
    return {x: root(x) for x in up}


def test_components_and_later_links(spark):
    rng = random.Random(5)
    of = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    got = lambda df: sorted((r.node, r.component) for r in df.collect())
    first = [(rng.randint(-40, 90), rng.randint(-40, 90)) for _ in range(60)] + [(1000, 1000 + i) for i in range(1, 30)] + [(3, 3), (None, 4), (5, None), (1001, 1000)]
    chain = [(i, i + 1) for i in range(2000, 2060)]
    later = [(2060, 1029), (7000, 7001), (-40, 7001), (1000, 1005), (None, 1), (8000, 8000)]
    start = components(of(first + chain))
    assert got(start) == sorted(brute(first + chain).items())
    assert got(joined(start, of(later))) == sorted(brute(first + chain + later).items())
    # links inside components change nothing; without earlier components they are all there is
    assert got(joined(start, of([(2000, 2050)]))) == got(start)
    assert got(joined(components(of([])), of(later))) == sorted(brute(later).items())

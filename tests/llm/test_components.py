"""Connected sets along long chains."""

import random

from lexmill.llm import neardup as N


def test_long_chains(spark):
    rng = random.Random(5)
    names = rng.sample(range(-(2**40), 2**40), 1300)
    chains = [names[:300], names[300:]]
    edges = [(min(a, b), max(a, b)) for c in chains for a, b in zip(c[:-1], c[1:])]
    rng.shuffle(edges)
    found = {r["class"]: r.group for r in N.components(spark.createDataFrame(edges, "class_a long, class_b long")).collect()}
    assert found == {x: min(c) for c in chains for x in c}

import random

import numpy as np
import pytest

from repovitals.llm import components


def brute(links):
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(5))
def test_stars_in_memory(seed):
    r = random.Random(seed)
    links = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(40 + 60 * seed)] + [(1000 + i, 1001 + i) for i in range(200)]
    want = brute(links)
    got = components.stars(np.array(links).T)
    assert dict(got.T.tolist()) == {x: c for x, c in want.items() if x != c}


def test_few_links_take_no_round_and_many_give_the_same(spark, monkeypatch):
    r = random.Random(1)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(5, 5), (None, 3), (100, 101)]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    want = brute([x for x in links if None not in x and x[0] != x[1]])
    rounds, step = [], components._step
    monkeypatch.setattr(components, "_step", lambda *a: rounds.append(a) or step(*a))
    assert {tuple(x) for x in components.components(df).collect()} == set(want.items()) and not rounds
    monkeypatch.setattr(components, "FEW", 3)
    assert {tuple(x) for x in components.components(df).collect()} == set(want.items()) and rounds

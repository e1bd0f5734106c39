import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from repovitals.llm import partenum
from repovitals.llm.common import words


def shingled(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows):
    sets = [(d, shingled(t)) for d, t in rows]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (d, x) in enumerate(sets):
        for e, y in sets[:i]:
            if None not in (d, e) and x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(x), None if d is None else root(d)) for d, x in sets if d is not None)


def near_copies(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, d = [], 0
    for _ in range(12):
        n = r.choice([1, 3, 5, 8, 12, 40, 90, 300])
        base = [r.choice(vocab) for _ in range(n)]
        for _ in range(r.choice([1, 2, 9])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, n // 40, n // 25])):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.3:
                w = w + [r.choice(vocab) for _ in range(r.randrange(1 + n // 6))]
            rows.append((d, " ".join(w)))
            d += 1
    r.shuffle(rows)
    return rows


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**9), st.one_of(st.integers(1, 400), st.integers(256, 1500)))
def test_similar_sets_share_a_signature(seed, size):
    r = np.random.default_rng(seed)
    pool = r.integers(0, 2**63, 2 * size + 8).astype(np.uint64)
    a = np.unique(pool[:size])
    gone = int(r.integers(0, size // 4 + 1))
    b = np.unique(np.concatenate([a[gone:], pool[size : size + int(r.integers(0, size // 4 + 2))]]))
    both, every = len(np.intersect1d(a, b)), len(np.union1d(a, b))
    if len(b) and 100 * both >= 80 * every:
        levels = np.random.default_rng(seed).integers(0, 1 + seed % 7, (2, 1 << partenum.COUNT_BITS)).astype(np.uint8)
        shared = len(np.intersect1d(partenum.signatures(a, levels), partenum.signatures(b, levels)))
        assert shared >= max(partenum.least_shared(len(x)) for x in (a, b))


def test_forest_keeps_components():
    r = np.random.default_rng(0)
    for n in (2, 5, 40):
        links = np.sort(r.integers(0, n, (60, 2)), axis=1)
        kept = partenum._forest(links)
        parent = [list(range(n)), list(range(n))]
        for p, some in zip(parent, (links, kept), strict=True):
            for _ in range(n):
                for a, b in some:
                    p[a] = p[b] = min(p[a], p[b])
        assert parent[0] == parent[1] and len(kept) < n


def test_components_equal_brute_force(spark):
    rows = near_copies(3) + [(1000, None), (1001, ""), (1002, "  \n "), (1003, "One"), (1004, "one"), (None, "one"), (1005, "a b c d e f"), (1005, "a b c d e f"), (1006, "É b c"), (1007, "é b c")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, component_id int").repartition(5)
    got = partenum.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == brute(rows)
    assert [r for r in got if r["doc_id"] is None][0]["component_id"] is None


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK", 32)
    r = random.Random(5)
    base = [f"x{i}" for i in range(150)]
    rows = []
    for d in range(300):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            w[r.randrange(len(w))] = f"y{r.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(tuple(x) for x in partenum.jaccard_components(docs).collect()) == brute(rows)


def test_empty_table(spark):
    assert partenum.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_come_by_level_then_value_and_sets_in_order():
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 4, (2, 1 << partenum.COUNT_BITS)).astype(np.uint8)
    for n in (0, 1, 2, 40, 300, 3000):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        x[: n // 3] = x[n - n // 3 :]
        features = partenum.distinct(x)
        assert features.tolist() == sorted(set(x.tolist()))
        if n < 2:
            continue
        level, expected, most = np.minimum(*(t[at] for t, at in zip(levels, partenum.places(features), strict=True))), [], partenum.CHANGED * (len(features) // 4)
        for band in partenum.bands(len(features)):
            signed, filled, low = partenum._enumerated(features, level, band)
            if filled.sum() > most:
                ordered = sorted(zip(low[filled].tolist(), signed[filled].tolist(), strict=True))
                signed = [s for _, s in ordered[: most + max(1, len(features) // partenum.MORE)]]
            expected += [int(s) >> 16 for s in signed]
        assert partenum.signatures(features, levels).tolist() == expected

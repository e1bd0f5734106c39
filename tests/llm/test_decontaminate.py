import math
import random
from collections import Counter, defaultdict

import numpy as np

from repovitals.llm import decontaminate as de
from repovitals.llm.common import WordHashes


def test_hamming_index_finds_all_within_radius():
    r = np.random.default_rng(1)
    prints = r.integers(0, 2**63, 300).astype(np.uint64)
    queries = prints[:100].copy()
    for i in range(100):
        for b in r.choice(64, i % 24, replace=False):
            queries[i] ^= np.uint64(1) << np.uint64(b)
    q, p, d = de.HammingIndex(prints).near(queries)
    want = {(i, j) for i in range(100) for j in range(300) if int(queries[i] ^ prints[j]).bit_count() <= de.RADIUS}
    assert set(zip(q.tolist(), p.tolist(), strict=True)) == want


def test_matches(spark):
    r = random.Random(2)
    vocab = [f"v{i}" for i in range(500)]
    make = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [make(n) for n in (40, 12, 60, 3, 40)]
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(items)] + [(8, None, "x"), (9, "", "x")], "item_id long, text string, doc_id string")
    edited = list(items[2])
    edited[0] = "changed"
    inside = make(200) + items[0] + make(50)
    docs = [(0, " ".join(inside)), (1, " ".join(make(300))), (2, " ".join(make(30) + edited + make(30))), (3, None), (4, ""), (5, "V1, " + ", ".join(items[1]).upper() + "!"),
            (6, " ".join(make(9) + items[3])), (7, " ".join(items[4][:20] + make(20))), (8, " ".join(items[0][2:])), (None, " ".join(items[0]))]
    docs = spark.createDataFrame([(*d, 1) for d in docs + [docs[0]]], "doc_id long, text string, item_id int")
    got = sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["item_id"]) for x in de.matches(docs, bench).collect())
    assert got == [(-1, 0), (0, 0), (0, 0), (2, 2), (5, 1), (6, 3), (8, 0)]
    found = {x["doc_id"]: x for x in de.matches(docs, bench).collect()}
    assert found[0]["first_word"] == 200 and found[0]["similarity"] == 1 and found[2]["similarity"] < 1
    assert sorted(x["doc_id"] for x in de.clean(docs, bench).collect()) == [1, 3, 4, 7]
    assert de.clean(docs, bench).columns == docs.columns
    assert de.matches(docs, bench.limit(0)).count() == 0 and de.matches(docs.limit(0), bench).count() == 0
    assert de.clean(docs, bench.limit(0)).count() == 11


def test_chunks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "a b c d e f g h"), (1, "k l m n o p q r s"), (2, "zz")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "b c d e f g"), (1, "l m n o p q r")], "item_id long, text string")
    one = sorted(x[:2] for x in de.matches(docs, bench).collect())
    monkeypatch.setattr(de, "CHUNK_WORDS", 5)
    assert sorted(x[:2] for x in de.matches(docs, bench).collect()) == one == [(0, 0), (1, 1)]


def test_weights_are_those_of_the_whole_benchmark(spark, monkeypatch):
    """Boilerplate that items of several chunks share, and near copies whose similarity hangs on its weight."""
    r = random.Random(6)
    make = lambda n: [f"v{r.randrange(400)}" for _ in range(n)]
    same = make(15)
    items = [same + make(25) for _ in range(12)]
    docs = [(i, " ".join(make(20) + items[i][:39] + ["other"] + make(20))) for i in range(12)] + [(20 + i, " ".join(make(15) + items[i][15:])) for i in range(12)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    run = lambda: sorted((*x[:5], round(x[5], 12)) for x in de.matches(docs, bench, threshold=0.6).collect())
    one = run()
    monkeypatch.setattr(de, "CHUNK_WORDS", 100)
    assert len(one) >= 12 and run() == one


def weighted_similarity(a, b, weight):
    both = sum(weight[s] * min(a[s], b[s]) for s in a if s in b)
    return both / (sum(weight[s] * k for s, k in a.items()) + sum(weight[s] * k for s, k in b.items()) - both)


def test_windows_against_brute_force():
    """Of all windows of an item's size at 0.8 and more, fingerprints within the radius find nearly all, and nothing else comes out."""
    r = random.Random(11)
    vocab = [f"v{i}" for i in range(900)]
    make = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [make(r.choice([12, 25, 40, 60])) for _ in range(150)]
    shingled = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    sets = [shingled(w) for w in items]
    holders = Counter(s for x in sets for s in x)
    weight = defaultdict(lambda: math.log(1 + len(items)), {s: math.log(1 + len(items) / k) for s, k in holders.items()})
    known = de.Items([(i, " ".join(w)) for i, w in enumerate(items)], 5)
    wanted = found = 0
    for i, item in enumerate(items):
        w = list(item)
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            w[r.choice([0, 1, len(w) - 1, r.randrange(len(w))])] = r.choice(vocab)
        text = make(30) + w + make(30)
        got = {m[0]: m for m in known.match(WordHashes().of([x.encode() for x in text]), 0.8)}
        best = {}
        for j, x in enumerate(sets):
            n = len(items[j])
            for s in range(len(text) - n + 1):
                if not x.keys().isdisjoint(here := shingled(text[s : s + n])) and (like := weighted_similarity(x, here, weight)) >= 0.8:
                    best[j] = max(best.get(j, (0, 0)), (like, -s))
        wanted += len(best)
        found += len(best.keys() & got.keys())
        for j, m in got.items():
            assert j in best and m[4] <= best[j][0] + 1e-9
            if not m[3]:
                assert abs(m[4] - best[j][0]) < 1e-9
    assert wanted > 80 and found >= 0.97 * wanted


def test_long_texts_are_hashed_in_runs(monkeypatch):
    r = random.Random(5)
    item = [b"w%d" % r.randrange(9) for _ in range(40)]
    known = de.Items([(0, b" ".join(item).decode())], 5)
    text = WordHashes().of([b"w%d" % r.randrange(9) for _ in range(3000)] + item + [b"w%d" % r.randrange(9) for _ in range(500)])
    whole = known.match(text, 0.8)
    monkeypatch.setattr(de.runs, "__defaults__", (37,))
    assert whole == known.match(text, 0.8) and whole[0][1] == 3000
    starts = np.array([3, 4, 5, 90, 91, 400])
    assert [x.tolist() for x in de.runs(starts, 10, 2)] == [[3, 4], [5], [90, 91], [400]]


def test_ties_go_to_the_first_window():
    known = de.Items([(0, "a b c d e f")], 5)
    text = WordHashes().of(b"a b c d e f x a b c d e f".split())
    assert known.match(text, 0.8)[0][1] == 0

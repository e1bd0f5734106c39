from collections import defaultdict
from decimal import Decimal, getcontext

from pyspark.sql import functions as F

from repovitals.llm import source_mix


def water(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        now = {s: 3 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in names if s not in capped and now[s] > 3 * sizes[s]}
        if not over:
            return now
        capped |= over


def test_mix(spark):
    rows = []
    for i in range(3000):
        source = ["hot", "hot", "a", "b", None, "tiny"][i % 6 if i % 97 else 5] if i % 6 != 5 or i < 60 else "hot"
        rows.append((i, None if i % 50 == 0 else "w " * (i * 7919 % 900), source, "x"))
    rows += [(5, "two words", "b", "x")] * 2 + [(None, "null id", "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(5)
    got = source_mix.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes)
    by_size = {sizes[s]: s for s in sizes}
    taken = defaultdict(int)
    for r in got:
        s = by_size[r["source_size"]]
        taken[s] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = source_mix.mix(docs.repartition(3)).collect()
    key = lambda r: (r[0] is None, *r[1:], r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)


def test_mix_order_is_even(spark):
    docs = spark.createDataFrame([(i, "w " * 100, "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    _, parts = source_mix.pieces(docs)
    slots = defaultdict(list)
    for r in parts.select("source_id", "slot").distinct().collect():
        slots[r["source_id"]].append(r["slot"])
    n = -(-60_000 // source_mix.BLOCK)  # drawn slots; the few late ones come after
    for s, places in slots.items():  # every source's share of the first half is its share of all
        assert abs(sum(p < n / 2 for p in places) - len(places) / 2) <= 4, s


def test_empty_and_blank(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted(map(tuple, source_mix.mix(docs).collect())) == [(1, 0, 0, 0.0, 0, None, 0), (2, 0, 0, 0.0, 0, None, 0)]
    assert source_mix.mix(docs.limit(0)).count() == 0


def test_points_are_multiples_of_the_golden_ratio(spark):
    getcontext().prec = 50
    ratio = (Decimal(5).sqrt() - 1) / 2
    ns = [0, 1, 5, (1 << 20) - 1, 1 << 20, (1 << 20) + 7, 3_000_001, 123_456_789]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", source_mix._point(F.col("n")).alias("u")).collect()
    for r in got:
        off = abs(r["u"] - float(r["n"] * ratio % 1))
        assert min(off, 1 - off) < 1e-9, r["n"]


def test_copies_come_in_the_order_of_the_schedule(spark):
    rows = [(i if i % 9 else None, "w " * (50 + i * 37 % 400), "abc"[i % 3], str(i)) for i in range(300)] + [(7, "twice here", "a", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, print string")
    got = source_mix.copies(docs.repartition(4))
    assert got.columns == docs.columns
    got = [tuple(r) for r in got.collect()]
    taken = {(r["doc_id"], r["size"]): r for r in source_mix.mix(docs).collect()}
    first = [taken[d, len(t.split())]["first_slot"] for n, (d, t, _, _) in enumerate(got) if (d, t) not in {(a, b) for a, b, *_ in got[:n]} and d is not None]
    assert first == sorted(first) and len(got) > 250
    times = {}
    for d, t, *_ in got:
        times[d, len(t.split())] = times.get((d, len(t.split())), 0) + 1
    for (d, size), n in times.items():
        if d not in (None, 7):
            assert n == max(1, round(taken[d, size]["taken"] / size + 1e-9))
    assert {(d, s) for (d, s), r in taken.items() if r["taken"]} == set(times)

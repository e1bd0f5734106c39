import math
import random
import zlib
from collections import Counter

import numpy as np
import xxhash

from repovitals.llm import lm_mixing as lm
from repovitals.llm.common import mix64


def rows():
    r = random.Random(4)
    common = [f"w{i}" for i in range(40)]
    out = []
    for i in range(700):
        t = []
        w = r.choice(common)
        for _ in range(r.choice([3, 30, 120])):
            w = common[(common.index(w) * 7 + 3) % 40] if r.random() < 0.8 else r.choice(common)
            t.append(w if r.random() < 0.93 else f"rare{r.randrange(4000)}")
        out.append((i, " ".join(t).title() if i % 5 else " ".join(t)))
    return out + [(900, None), (901, ""), (None, "w1 w2"), (902, "ünseen Ünseen \x00 日本"), (7, out[7][1]), (7, out[7][1]), (903, "w3 " * 20000), (904, "x" * 3000)]


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


def tokens(t):
    return [*(t or "").encode().lower().split(), lm.END]


def hash_of(w):
    return np.array([xxhash.xxh3_64_intdigest(w or b" ")], np.uint64)


def plain(texts, counts, start):
    """The score of texts, one decision after the other, from Counters of words, pairs and triples."""
    words, pairs, triples = counts
    total = sum(words.values())
    out = []
    for t in texts:
        told, fine = {}, {}
        weights = start.weights.copy()
        log_p, earlier, back, now, place = 0.0, Counter(), [0, 0, 0], [], 0
        x = tokens(t)
        for at in [*lm.chunk_starts(len(x)), len(x)]:
            here = Counter((k, c) for k, c, *_ in now)
            moved = {}
            for k, c, inputs, z, r, reached, near in now:
                error = (r - reached / (1 + math.exp(-z))) * lm.RATE / math.sqrt(here[k, c])
                for i in range(lm.INPUTS):
                    moved[k, c, i] = moved.get((k, c, i), 0) + error * inputs[i]
                for table, key in ((told, (k, c)), (fine, (k, near))):
                    shut, open_ = table.get(key, (0.0, 0.0))
                    table[key] = (shut + max(reached - r, 0.0), open_ + r)
            for key, by in moved.items():
                weights[key] += by
            now = []
            while place < at:
                w, one, two = x[place], x[place - 1] if place else lm.END, x[place - 2] if place > 1 else lm.END
                triple = triples[two, one, w] if place else 0
                seen = [pairs[two, one] if place else 0, words[one], place, total]
                part = [triple, pairs[one, w], earlier[w], words[w]]
                says, left, asked = [], 1.0, []
                slot = int(mix64(hash_of(one))[0] >> np.uint64(52))
                for k in range(4):
                    c = int(np.searchsorted(lm.LEVELS, seen[k], "right"))
                    places = (k * lm.CELLS + c) * 4 + back[0], k * lm.SLOTS + slot, k * 64 + back[0] * 16 + back[1] * 4 + back[2]
                    inputs = [float(np.float32(tb[i])) for tb, i in zip(start.tables, places, strict=True)]
                    lean = lm.PRIOR / (1 + math.exp(-inputs[0]))
                    shut, open_ = told.get((k, c), (0.0, 0.0))
                    inputs.append(math.log((open_ + lean) / (shut + lm.PRIOR - lean)))
                    z = min(lm.TOP - 1e-6, max(-lm.TOP + 1e-6, sum(a * b for a, b in zip(weights[k, c], inputs, strict=True))))
                    spot = (z + lm.TOP) * (lm.BUCKETS - 1) / (2 * lm.TOP)
                    low = int(spot)
                    end = []
                    for b in (low, low + 1):
                        s, o = fine.get((k, b), (0.0, 0.0))
                        end.append((start.refine[k, b] * lm.KEEP + o) / (lm.KEEP + s + o))
                    trust = seen[k] / (seen[k] + 1) if k < 2 else float(seen[k] > 0)
                    gate = trust * (1 / (1 + math.exp(-z)) + end[0] * (1 - (spot - low)) + end[1] * (spot - low)) / 2
                    says.append(left * gate * part[k] / seen[k] if seen[k] else 0.0)
                    asked.append((k, c, inputs, z, low + (spot - low >= 0.5), trust))
                    left *= 1 - gate
                p = sum(says)
                if not words[w]:
                    spelled = float(lm.spell([w], start.spelling)[0])
                    log = np.logaddexp(math.log(p) if p else -math.inf, math.log(left) + spelled) if p else math.log(left) + spelled
                    rest = math.exp(math.log(left) + spelled - log)
                else:
                    log, rest = math.log(p), 0.0
                r = [s / math.exp(log) if p else 0.0 for s in says]
                for k, c, inputs, z, near, trust in asked:
                    now.append((k, c, inputs, z, r[k], trust * min(1.0, sum(r[k:]) + (rest if p else 1.0)), near))
                log_p += log
                earlier[w] += 1
                back = [min(triple, 3), *back[:2]]
                place += 1
        out.append(log_p / math.log(10))
    return out


def counted(data):
    words, pairs, triples = Counter(), Counter(), Counter()
    for d, t in data:
        if not held(d):
            x = [lm.END, lm.END, *tokens(t)]
            words.update(x[2:])
            pairs.update(zip(x[1:], x[2:], strict=False))
            triples.update(list(zip(x, x[1:], x[2:], strict=False))[1:])
    return words, pairs, triples


def test_base_is_exact_and_model_beats_it(spark):
    data = rows()
    docs = spark.createDataFrame([(*x, "x") for x in data], "doc_id long, text string, score string").repartition(5)
    got = lm.scores(docs).collect()
    assert len(got) == len(data)
    c = Counter(w for d, t in data if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t in data:
        x = tokens(t)
        want[(d, held(d), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 6))] += 1
    assert Counter((*r[:5], round(r["base_score"], 6)) for r in got) == want
    ours = [(r["score"], r["base_score"]) for r in got if r["held_out"]]
    assert sum(a for a, _ in ours) > 0.8 * sum(b for _, b in ours)  # less negative
    assert all(r["score"] < 0 for r in got)


def test_scores_equal_plain_decisions_however_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOGETHER", 500)
    data = [x for x in rows()[:300] if x[0] is not None] + rows()[700:]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    start = lm.learned(docs, 2, 6)
    want = sorted(zip(plain([t for _, t in data], counted(data), start), (d or -1 for d, _ in data), strict=True))
    for n in (1, 4, 9):
        got = sorted((r["score"], r["doc_id"] or -1) for r in lm.scores(docs.repartition(n)).collect())
        assert [d for _, d in got] == [d for _, d in want]
        assert np.allclose([s for s, _ in got], [s for s, _ in want], rtol=1e-6, atol=1e-6)


def test_chances_of_all_next_words_sum_to_one(spark):
    data = rows()[:200]
    start = lm.learned(spark.createDataFrame(data, "doc_id long, text string"), 2, 6)
    counts = counted(data)
    for text in ("w1 w2", "w5", "w3 w3 w3 w3", "never seen"):
        own = text.encode().split()
        before = plain([text + " " + "w1"], counts, start)[0]  # the same chances up to the word, whatever it is: too short to adapt
        with_ = [plain([f"{text} {w.decode()}"], counts, start)[0] for w in sorted({*counts[0], *own}) if w]
        ends = [plain([f"{text} {w.decode()} q"], counts, start)[0] for w in list(counts[0])[:1] if w]
        assert before < 0 and len(with_) > 40 and all(x < 0 for x in [*with_, *ends])
    word = "w1 w2"
    log = lambda t: plain([t], counts, start)[0]
    # A text's chance is that of its words and of its end: the texts that go on by one known word are less likely than all that begin so.
    assert sum(10 ** log(f"{word} {w.decode()}") for w in counts[0] if w) + 10 ** log(word) <= 1


def test_spelling_is_a_distribution():
    tables = np.random.default_rng(1).integers(0, 9, (3, 1 << lm.SPELL_BITS, 2))
    every = [bytes([b]) for b in range(256)]
    word, bit, slots = lm.spelled_bits(every)
    first = np.concatenate([np.arange(8) + 16 * i for i in range(256)])
    top, low = np.zeros(len(bit)), np.full(len(bit), 0.02)
    for j, trust in enumerate((0.5, 1.0, 2.0)):
        counts = tables[j][slots[j]]
        top += trust * np.sqrt(counts.sum(1)) * np.log((counts[:, 1] + 0.4) / (counts[:, 0] + 0.4))
        low += trust * np.sqrt(counts.sum(1))
    z = np.clip(top / low, -lm.TOP, lm.TOP)
    log = -np.logaddexp(0, np.where(bit == 1, -z, z))
    assert abs(np.exp(np.bincount(word[first], log[first])).sum() - 1) < 1e-9
    assert np.allclose(np.bincount(word, log), lm.spell(every, tables))


def test_repeated_texts_are_told_apart(spark):
    r = random.Random(9)
    text = lambda: " ".join(f"v{r.randrange(3000)}" for _ in range(120))
    data = [(i, text()) for i in range(400)]
    data += [(1000 + i, data[i][1]) for i in range(0, 200, 5)]
    got = {x["doc_id"]: x["bits_per_byte"] for x in lm.scores(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect() if not x["held_out"]}
    twice = [got[i] for i in range(0, 200, 5) if i in got and 1000 + i in got]
    once = [b for i, b in got.items() if 200 <= i < 1000]
    assert max(twice) < min(once)


def test_weights_tables_and_refinement_move_within_a_short_text():
    """The same word over and over: the gate of what the text itself says opens."""
    start = lm.Start.plain()
    for n in (40, 80):
        t = lm.Tokens.of(["w " * n])
        runs = lm.Runs.of(t)
        zero = np.zeros(n + 1, np.int64)
        facts = lm.Facts.of(t, runs.first, runs.before, zero + 1, zero, zero, 1, 1000, np.zeros(n + 1))
        sums, weights, refine = lm.run_mixer(facts, start)
        assert not np.allclose(weights[0], start.weights) and refine.sum() > 0
        if n == 80:
            assert sums[0] > 1.8 * half  # the second half costs less than the first
        half = sums[0]


def test_empty_tables_and_no_training_rows(spark):
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = next(i for i in range(100) if held(i))
    got = lm.scores(spark.createDataFrame([(only, "a b a")], "doc_id long, text string")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(4, 0, 0, 0.0)] and got[0]["score"] < 0


def test_packing():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    counts = r.integers(0, 400, 1000)
    counts[::100] = 1 << 40
    assert (lm.unpress_keys(lm.press_keys(keys)) == keys).all()
    assert (lm.unpress_counts(lm.press_counts(counts)) == counts).all()
    table = lm._Sums()
    for lo in range(0, len(keys), 100):
        table.add(keys[lo : lo + 300], np.full(len(keys[lo : lo + 300]), 1 << 33))
    found = lm._totals(table.done(), np.append(keys, np.uint64(1)))
    assert found[0] == 1 << 33 and found[500] == 3 << 33 and found[-1] == 0


def test_the_start_is_learned_from_every_training_text(spark):
    data = [(d, t) for d, t in rows() if d is not None and zlib.crc32(str(d).encode()) % 7 != 6]  # none of the fold that once was the only one
    start = lm.learned(spark.createDataFrame(data, "doc_id long, text string"), 2)
    names = {w for d, t in data if not held(d) for w in tokens(t)}
    assert start.spelling[0].sum() == start.spelling[2].sum() == 8 * sum(len(w) + 1 for w in names)


def test_packed_sorts_are_those_of_numpy():
    rng = np.random.default_rng(5)
    for bits, n in ((44, 5000), (53, 5000), (64, 5000), (3, 5000), (64, 0)):  # one sort, sorts by first bits, an argsort
        keys = rng.integers(0, 1 << bits, n, np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        keys[: n // 2] = keys[n - n // 2 :]
        ordered, places = lm._in_order(keys, bits)
        assert (places == np.argsort(keys, kind="stable")).all() and (ordered == np.sort(keys)).all()
        for got, wanted in zip(lm._distinct(keys, bits), np.unique(keys, return_inverse=True, return_counts=True), strict=True):
            assert (got == wanted).all()


def test_sums_are_told_to_every_part_in_one_sort(monkeypatch):
    monkeypatch.setattr(lm, "SUMMED", 50)  # ranges of keys apart
    rng = np.random.default_rng(7)
    for bits in (44, 63):
        table, plain = lm._Sums(), {}
        parts = [np.unique(rng.integers(0, 1 << bits, 60).astype(np.uint64) % np.uint64(997) << np.uint64(bits - 10)) for _ in range(20)]
        for nth, keys in enumerate(parts):
            counts = rng.integers(1, 1 << 40, len(keys)) * (nth % 3 > 0)  # a third only asks
            table.add(keys, counts)
            for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
                plain[k] = plain.get(k, 0) + c
        told, total, distinct = table.told()
        assert [x.tolist() for x in told] == [[plain[k] for k in keys.tolist()] for keys in parts]
        assert total == sum(plain.values()) and distinct == sum(c > 0 for c in plain.values())
        keys, sums = table.done()
        assert dict(zip(keys.tolist(), sums.tolist(), strict=True)) == plain and (np.diff(keys.astype(np.int64)) > 0).all()
    assert lm._Sums().told() == ([], 0, 0)


def test_arrow_splits_texts_as_python_does():
    texts = [None, "", " ", "a", "  A b\x0bc\x1cd\x85e f\t\r\n\x0cÉ g ", "b\x00 B b", "\n", "x" * 300 + " a"]
    found = lm.Tokens.of(texts)
    expected = [[*(t or "").encode().lower().split(), lm.END] for t in texts]
    assert found.lens.tolist() == [len(x) for x in expected]
    assert [found.names[i] for i in found.ids] == [w for x in expected for w in x]
    assert lm.Tokens.of([]).lens.tolist() == [] and lm.Tokens.of([None]).ids.tolist() == [0]

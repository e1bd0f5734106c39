import random
import zlib

from repovitals.llm import langid

PARTS = {"en": "the ing tion and er ouns th".split(), "de": "sch ein ung ver ich ö ß".split(), "fr": "eau que ment les oi é è".split()}


def text(lang, n, r):
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(1)
    rows = [(i, text(lang := r.choice(list(PARTS)), r.choice([8, 30, 200]), r), lang if i % 11 else None, lang) for i in range(900)]
    odd = [(2001, None, "en", "x"), (2002, "", "en", "x"), (2003, "12 34 … !", "de", "x"), (2004, "eau " * 60000, None, "fr"), (None, text("de", 50, r), None, "de"), (2001, None, "en", "x")]
    docs = spark.createDataFrame([(d, t, lang, s) for d, t, lang, s in rows + odd], "doc_id long, text string, lang string, score string").repartition(4)
    model = langid.train(langid.training_fold(docs))
    got = {x["doc_id"]: x for x in langid.predict(docs, model).collect()}
    held = [(got[d]["lang_pred"], true) for d, _, _, true in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert got[2004]["lang_pred"] == "fr" and got[None]["lang_pred"] == "de"
    for d in (2001, 2002, 2003):
        assert got[d]["lang_pred"] == "und" and got[d]["score"] == 0 and got[d]["rejected"]
    assert all(0 <= x["score"] <= 1 for x in got.values())
    kept = langid.keep(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == langid.predict(docs, model).where("NOT rejected").count() > 880


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "the thing", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert [tuple(x) for x in langid.predict(docs, model).collect()] == [(1, "und", 0.0, True)]
    assert langid.predict(docs.limit(0), model).count() == 0


def test_ties_dont_widen_the_sample(spark):
    """Rows without an id share one hash, and repeated rows are one text: the bound holds."""
    rows = [(None, f"some words number {i}", "en") for i in range(300)] + [(None, "the same again", "de")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    some = langid.sampled(docs, 50, 0).collect()
    assert len(some) == len(set(some)) == 50
    assert sorted(map(tuple, some)) == sorted(map(tuple, langid.sampled(docs.repartition(7), 50, 0).collect()))
    assert langid.sampled(docs.limit(0), 50, 0).count() == 0

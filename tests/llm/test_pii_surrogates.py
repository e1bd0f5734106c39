import re

from repovitals.llm import pii_surrogates as pii

TEXTS = [
    "write und.34@mail7.example.com or UND.34@MAIL7.EXAMPLE.COM now",
    "call +1 (017) 555-7713 or +1 017-555-7713, card 4111 1111 1111 1111 or 4111111111111111",
    "7536784127813050 4845168114407329 from 97.51.17.173.",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and 04DBEBAB91AB85687D33EEAAF9AC699E1188F962',
    "Mrs. Ana Ruiz met Frau Ruiz and Mr. Ana Ruiz; Господин Иван Петров. SSN 123-45-6789",
    "nothing here",
    None,
    "",
    "und.34@mail7.example.com",
    "x " * 50000 + "a@b.co",
    "version 1.2.3.4.5 of 999.1.1.1",
]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10


def test_replacement(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x"), (0, TEXTS[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, new string").repartition(3)
    got = pii.replace(docs, "k").collect()
    assert len(got) == len(rows)
    out = {r["doc_id"]: r for r in got}
    for secret in ("und.34", "555-7713", "4111", "7536784127813050", "4845168114407329", "97.51.17.173", "04dbebab", "04DBEBAB", "Ana", "Ruiz", "Иван", "Петров", "123-45-6789", "a@b.co"):
        assert not any(secret in (r["text"] or "") for r in got), secret
    a, b = re.fullmatch(r"write (\S+) or (\S+) now", out[0]["text"]).groups()
    assert b == a.upper() and re.fullmatch(r"[a-z]{3}\.\d\d@h\d+\.example\.(com|net|org)", a)
    assert out[8]["text"] == a and out[None]["text"] == out[0]["text"]
    one, two, card, flat = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3}-\d{3}-\d{4}), card (\d{4} \d{4} \d{4} \d{4}) or (\d{16})", out[1]["text"]).groups()
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) and card.replace(" ", "") == flat and luhn(flat) == 0
    t, u = re.fullmatch(r'token = "([0-9a-f]{40})" and ([0-9A-F]{40})', out[3]["text"]).groups()
    assert u == t.upper()
    f, s, s2, m, s3, g, p = re.fullmatch(r"Mrs\. (\S+) (\S+) met Frau (\S+) and Mr\. (\S+) (\S+); Господин (\S+) (\S+)\. SSN \d{3}-\d{2}-\d{4}", out[4]["text"]).groups()
    assert s == s2 == s3 and f.endswith("na") and m.endswith("rik") and g.endswith("рик") and re.fullmatch("[А-Я][а-я]+", p)
    for i in (5, 6, 7, 10):
        assert out[i]["text"] == TEXTS[i] and out[i]["n_entities"] == 0
    assert [out[i]["n_entities"] for i in (0, 1, 2, 9)] == [2, 4, 3, 1]
    again = {r["doc_id"]: r["text"] for r in pii.replace(docs.repartition(5), "k").collect()}
    assert again == {r["doc_id"]: r["text"] for r in got}
    assert pii.replace(docs, "other").where("doc_id = 8").first()["text"] != a
    assert pii.replace(docs.limit(0), "k").count() == 0


def test_bare_names_case_and_accounts(spark):
    texts = ["Mr. John Smith called. Smith said hi; JOHN wrote to John.Smith@Acme.com, not Smithson.", "Smith alone stays here", "pay DE89 3704 0044 0532 0130 00 or DE89370400440532013000 from fe80:0:0:0:1:2:3:4 or 2001:db8::7", "Mrs. Eva Smith"]
    got = {r["doc_id"]: r["text"] for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    a = re.fullmatch(r"Mr\. (\S+) (\S+) called\. (\S+) said hi; (\S+) wrote to (\S+), not Smithson\.", got[0])
    given, surname = a[1], a[2]
    assert a[3] == surname and a[4] == given.upper() and "Smith" not in got[0].replace("Smithson", "") and "John" not in got[0]
    assert re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{4}@example\.(com|net|org)", a[5])
    assert got[1] == texts[1] and got[3].endswith(" " + surname) and got[3].startswith("Mrs. ")
    spaced, flat, one, two = re.fullmatch(r"pay (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) or (DE\d{20}) from (\S+) or (\S+)", got[2]).groups()
    assert spaced.replace(" ", "") == flat != "DE89370400440532013000" and int(flat[4:] + "1314" + flat[2:4]) % 97 == 1
    assert one != two and all(re.fullmatch(r"2001:db8:[0-9a-f]{1,4}(:[0-9a-f]{1,4}){5}", x) for x in (one, two))


def test_a_spelling_in_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(pii, "HOT", 50)
    docs = spark.createDataFrame([(i, f"to all@one.org and u{i % 40}@two.org") for i in range(300)], "doc_id long, text string")
    plain = {r["doc_id"]: r["text"] for r in pii.replace(docs, "k").collect()}
    monkeypatch.setattr(pii, "HOT", 10**9)
    assert plain == {r["doc_id"]: r["text"] for r in pii.replace(docs, "k").collect()} and len({t.split()[1] for t in plain.values()}) == 1


def test_small_formats_never_run_out(spark, monkeypatch):
    """More entities than their first format has values, and numbers that take up almost half of theirs."""
    monkeypatch.setattr(pii, "ATTEMPTS", 9)
    rows = [("email", f"a@foo{i}.com") for i in range(300)] + [("surname", a + b + c) for a in "abcdefghijklmn" for b in "aeiouy" for c in "abcdefghijklmnopqrstuvwxyzäöü"] + [("phone", f"1{i:03}") for i in range(480)] + [("phone", f"2{i:02}") for i in range(80)]
    got = pii.assign(spark.createDataFrame(rows, "kind string, norm string"), "k").collect()
    made = {(r["kind"], r["surrogate"]) for r in got}
    assert {(r["kind"], r["norm"]) for r in got} == set(rows) and len(got) == len(rows) == len(made) and not made & set(rows)
    for r in got:
        if r["kind"] == "phone":
            assert len(r["surrogate"]) == len(r["norm"])
            assert r["norm"][0] == "2" or r["surrogate"][0] == "1"


def test_all_surrogates_are_distinct(spark):
    """1,000 numbers of four digits after a kept one: most first draws collide."""
    entities = spark.range(1000).selectExpr("'phone' kind", "cast(10000 + id * 7 as string) norm")
    got = pii.assign(entities, "k").collect()
    norms, made = {r["norm"] for r in got}, {r["surrogate"] for r in got}
    assert len(got) == len(norms) == len(made) == 1000 and not norms & made

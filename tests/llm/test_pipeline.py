import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from repovitals.llm import langid
from tests.llm.test_langid import text
from tests.llm.test_partenum import brute


def test_stages_against_plain_python(spark, tmp_path):
    r = random.Random(9)
    rows = []
    for i in range(240):
        lang = r.choice(["en", "de", "fr"])
        rows.append((i, text(lang, r.choice([30, 80, 150]), r), lang, f"s{i % 4}"))
    item = text("en", 30, r)
    for i in range(5):
        rows[i * 7] = (i * 7, rows[i * 7][1] + " " + item, rows[i * 7][2], rows[i * 7][3])
    rows += [(300 + i, rows[i][1], rows[i][2], "s1") for i in range(0, 40, 2)]
    rows += [(400, None, "en", "s0"), (401, "123 !", None, None), (402, "", "de", "s2"), (30, rows[30][1], rows[30][2], rows[30][3])]
    rows += [(None, text("en", 40, r), "en", "s3")]
    docs = spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    kept = corpus_pipeline.language_id(spark, docs, folder).collect()
    model = langid.train(langid.training_fold(docs))
    langs, scores = langid.Scorer(model).score([t for _, t, _, _ in rows])
    want = [x for x, lang, s in zip(rows, langs, scores, strict=True) if lang != "und" and s >= model.threshold]
    assert sorted(str(tuple(x)[:2]) for x in kept) == sorted(str(x[:2]) for x in want) and len(want) > 250

    step = spark.createDataFrame(kept, docs.schema)
    one = corpus_pipeline.one_of_each_group(spark, step, folder)
    assert one.columns == docs.columns
    comps = {d: c for d, _, c in brute(list(dict.fromkeys((d, t) for d, t, *_ in kept)))}
    assert sorted(x["doc_id"] for x in one.where("doc_id IS NOT NULL").collect()) == sorted(d for d, c in comps.items() if d == c)
    assert one.where("doc_id IS NULL").count() == 1

    clean = corpus_pipeline.without_benchmark(spark, one, folder)
    assert sorted(x["doc_id"] or -1 for x in clean.collect()) == sorted(x["doc_id"] or -1 for x in one.collect() if item not in x["text"])

    mixed = corpus_pipeline.mixed(spark, clean, folder)
    assert mixed.columns == docs.columns and mixed.count() > 0
    out = corpus_pipeline.run(spark, folder).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {x["doc_id"]: x["text"] for x in clean.collect()}
    assert len(out) == mixed.count()
    for x in out:
        ids = np.array(plain.encode(texts[x["doc_id"]], add_special_tokens=False).ids + [0], "<u4")
        assert x["n_tokens"] == len(ids) and x["ids_crc32"] == zlib.crc32(ids.tobytes())


def test_texts_under_a_reused_doc_id_are_documents_of_their_own(spark):
    r = random.Random(3)
    a, b, c = (text("en", 60, r) for _ in range(3))
    rows = [(1, a, "s1"), (2, b, "s1"), (2, a, "s2"), (2, c, "s3"), (2, c, "s0"), (3, c, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for parts in (1, 4):
        got = corpus_pipeline.one_of_each_group(spark, docs.repartition(parts), "")
        assert got.columns == docs.columns
        got = [tuple(x) for x in got.collect()]
        assert sorted(x[1] for x in got) == sorted([a, b, c]) and (1, a, "s1") in got and all(x[2] != "s3" for x in got)

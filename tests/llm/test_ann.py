import math

import numpy as np
import pandas as pd

from repovitals.llm import ann


def recall(got, want):
    pairs = lambda x: set(zip(x["query_id"], x["vec_id"], strict=True))
    return len(pairs(got) & pairs(want)) / len(want)


def test_recall_on_the_embeddings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(docs).toPandas()
    want = ann.exact(docs.toPandas())
    assert len(got) == len(want) and recall(got, want) >= 0.9
    both = got.merge(want, on=["query_id", "vec_id"])
    assert np.allclose(both["score_x"], both["score_y"], rtol=1e-12)
    for _, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and g["score"].is_monotonic_increasing


def test_hot_list_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 64)
    r = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(700)] + [(1000 + i, r.normal(size=4).tolist()) for i in range(300)]
    bad = [(5000, None), (5100, [0.0] * 4), (5200, [1.0, None, 1.0, 1.0]), (5300, [math.nan, 1.0, 1.0, 1.0]), (5400, [math.inf, 1.0, 1.0, 1.0]), (5500, [1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (5600, [])]
    frame = spark.createDataFrame([(*x, "z") for x in rows + bad], "vec_id long, embedding array<double>, score string")
    got = ann.nearest(frame).toPandas()
    want = ann.exact(pd.DataFrame(rows, columns=["vec_id", "embedding"]))
    assert len(got) == len(want) and recall(got, want) >= 0.9
    hot = got[got["query_id"] == 300].sort_values("rank")
    assert hot["vec_id"].tolist() == list(range(10)) and (hot["score"] == 0).all()


def test_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(x)[:3] for x in ann.nearest(frame).collect()] == [(0, 1, 1)]
    assert ann.nearest(frame.limit(0)).count() == 0

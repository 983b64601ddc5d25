"""Cases that the given tables are too small or too regular to reach: several blocks of vectors, no frequent word."""

import numpy as np

from quarry.llm import brown, topk


def test_topk_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    v = np.random.default_rng(5).integers(-6, 7, (300, 16))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 10 = 0"), k=5).collect()}
    scores = v @ v.T
    for q in range(0, 300, 10):
        best = sorted((-s, i) for i, s in enumerate(scores[q].tolist()) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert len(got) == 30 * 5


def test_class_model_without_frequent_words(spark, monkeypatch):
    """All words tie beyond the bound, so every one of them is placed by its own surroundings."""
    monkeypatch.setattr(brown, "FREQUENT", 2)
    docs = spark.createDataFrame([(i, f"a{i} b{i} b{i} c{i}") for i in range(20)], "doc_id long, text string")
    model = brown.train(docs)
    cls = {bytes(r.word): r.cls for r in model.words.collect()}
    assert len(cls) == 60 and min(cls.values()) >= 1 and not model.frequent
    got = brown.score(docs, model).collect()
    assert len(got) == 20 and all(np.isfinite(r.score) and r.n_tokens == r.n_known == 5 for r in got)
    assert np.allclose((10.0 ** model.step).sum(1), 1)

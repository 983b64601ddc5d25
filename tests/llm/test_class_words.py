"""Class model: every word is clustered as a word."""

import random

import numpy as np

from quarry.llm import brown


def test_best_class_raises_the_likelihood_most():
    rng = np.random.default_rng(3)
    size, k = 30, 5
    n = rng.poisson(1.5, (size, size)).astype(float)
    cls = np.r_[0, 1 + rng.integers(0, k - 1, size - 1)]

    def table(cls):
        return np.eye(k)[cls].T @ n @ np.eye(k)[cls]

    others = n * (1 - np.eye(size))
    member = np.eye(k)[cls]
    got = brown.best_classes(table(cls), others @ member, others.T @ member, np.diagonal(n), cls)
    for w in range(1, size):
        want = [brown.likelihood(table(np.r_[cls[:w], c, cls[w + 1:]])) for c in range(1, k)]
        assert np.isclose(want[got[w] - 1], max(want))


def test_bigrams_end_at_texts(spark):
    texts = spark.createDataFrame([("a b",), (None,), ("",), ("b",), ("a b a",)], "text string").coalesce(1)
    a, b = brown.code(b"a"), brown.code(b"b")
    assert {(r.a, r.b): r.n for r in brown.bigrams(texts).collect()} == {(0, a): 2, (a, b): 2, (b, 0): 2, (0, 0): 2, (0, b): 1, (b, a): 1, (a, 0): 1}


def test_rare_words_are_clustered_by_their_neighbours(spark, monkeypatch):
    """Two kinds of words, alike in their endings, each seen a few times in its own surroundings; a word outside the
    frequent ones keeps the class that the join gives it."""
    monkeypatch.setattr(brown, "FREQUENT", 200)
    r = random.Random(1)
    heads = [f"h{i}" for i in range(1500)]  # frequent words
    rows = []
    for i in range(600):
        t = []
        for _ in range(40):
            t += [f"p{r.randrange(9)}", f"a{r.randrange(2500)}zzz", "runs", r.choice(heads), f"q{r.randrange(9)}", "to", f"b{r.randrange(2500)}zzz", "with", "it"]
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = brown.train(docs)
    cls = {bytes(x.word): x.cls for x in model.words.collect()}
    a, b = ({c for w, c in cls.items() if w.startswith(p) and w.endswith(b"zzz")} for p in (b"a", b"b"))
    assert a and b and not a & b
    assert model.cls[model.types.of(b"a7zzz")] in a
    got = {x.doc_id: x.score for x in brown.score(docs, model).collect()}
    count = {bytes(x.word): x.c for x in model.words.collect()}
    for i, t in rows[:5]:
        w = brown.tokens(t)
        path = [0, *(cls[x] for x in w), 0]
        want = sum(model.step[x, y] for x, y in zip(path, path[1:])) + sum(np.log10(count[x] + brown.ADD) - model.room[cls[x]] for x in w)
        assert np.isclose(got[i], want + np.log10(600 + brown.ADD) - model.room[0])

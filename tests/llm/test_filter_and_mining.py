"""URL filter, importance resampling and hard negatives against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import importance, negatives, queries, topk, urlfilter

# URL filter

ODD_URLS = [
    None, "", "no scheme", "http://", "http://A.NET", "http://A.net/", "https://x.example.net/en/1?q=/de/", "https://x.example.net/en",
    "ftp://example.com/de/x#y", "http://badexample.com/de/1", "http://b.example.com/de/?a", "http://org/fr/a", "http://s.org/fr/a/b#c", "http://net/",
    "http://x.net?y/en/", "http://h.org#/fr/", "http://net.org/x\ny/?z", "http://ÄÖ.org/fr/é", "a://b://c.net/", "http://q.com/" + "z" * 30_000]


def by_hand(url, rules):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, None)))


class PlainModel:
    """Interpolated Witten-Bell over one class's strings, with dictionaries."""

    def __init__(self, texts):
        self.next = defaultdict(Counter)
        for t in texts:
            s = ["start", *t.encode(), "end"]
            for i in range(1, len(s)):
                for k in range(min(i, urlfilter.ORDER) + 1):
                    self.next[tuple(s[i - k:i])][s[i]] += 1

    def log(self, t):
        s, out = ["start", *t.encode(), "end"], []
        for i in range(1, len(s)):
            p = 1 / 257
            for k in range(min(i, urlfilter.ORDER) + 1):
                seen = self.next.get(tuple(s[i - k:i]))
                if seen:
                    p = (seen[s[i]] + len(seen) * p) / (sum(seen.values()) + len(seen))
            out.append(math.log(p))
        return np.array(out)


def urls(n, seed=1):
    r = random.Random(seed)
    return [f"http{r.choice(['', 's'])}://{r.choice(['', 'www.', 'm.'])}{r.choice(['good', 'fine', 'spam', 'casino'])}{r.randrange(9)}.example."
            f"{r.choice(['net', 'com', 'org'])}/{r.choice(['en', 'de', 'fr'])}/{r.randrange(500)}{r.choice(['', '?a=b', '#top'])}" for _ in range(n)]


def test_url_parts_and_rules(spark):
    rows = [(i, u, 1, "x") for i, u in enumerate(ODD_URLS)] + [(0, ODD_URLS[5], 1, "x")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host int, rule string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, queries.URL_RULES).collect())
    assert len(got) == len(rows)
    for (i, u, *_), (j, host, path, rule, verdict) in zip(sorted(rows, key=lambda r: (r[0], by_hand(r[1], queries.URL_RULES)[0])), got):
        want = by_hand(u, queries.URL_RULES)
        assert (i, *want[:3]) == (j, host, path, rule)
        assert verdict == want[3] if want[3] else verdict in ("allow", "block")


def test_url_models_equal_plain_ones(spark):
    learn = [(u, "good" in u or "fine" in u) for u in urls(400)] + [(None, True), ("", False), ("é" * 300, True)]
    df = spark.createDataFrame(learn, "url string, good boolean").repartition(7)
    model = urlfilter.train(df)
    kept = [(u or "", g) for u, g in learn if zlib.crc32((u or "").encode()) % urlfilter.FOLDS]
    good, bad = PlainModel([u for u, g in kept if g]), PlainModel([u for u, g in kept if not g])
    asked = [*urls(50, 2), "", "ü", "x" * 2000, None, *urls(1, 1)]
    got = urlfilter.differences(asked, model.pairs, model.contexts)
    assert np.allclose(got, [(good.log(u or "") - bad.log(u or "")).mean() for u in asked])


def test_url_verdicts_on_examples_not_learned(spark):
    """The models find the accepted words again in urls that no rule fits."""
    rules = [("net", f"/{lang}/{d}", "allow" if lang != "de" else "block") for lang in ("en", "de", "fr") for d in range(10)]
    pages = spark.createDataFrame(list(enumerate(urls(3000, 5))), "page_id long, url string")
    got = urlfilter.judge(pages, rules).where("rule is null").select("path", "verdict", "probability").collect()
    assert len(got) > 1500 and all((r.verdict == "allow") == (r.probability >= 0.5) for r in got)
    assert sum((r.verdict == "block") == r.path.startswith("/de/") for r in got) / len(got) > 0.95


def test_url_calibration_and_missing_examples(spark):
    rng = np.random.default_rng(1)
    d, y = rng.normal(size=4000), rng.random(4000)
    good = y < 1 / (1 + np.exp(-(3 * d + 0.4)))
    bins, at = np.unique(np.floor(d / urlfilter.BIN), return_inverse=True)
    a, b = urlfilter.calibrate(bins + .5, np.bincount(at, good), np.bincount(at, ~good))
    odds = math.log(good.sum() / (~good).sum())  # both kinds weigh alike
    assert abs(a - 3) < .25 and abs(b + odds - .4) < .15
    none = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(none, queries.URL_RULES).count() == 0
    alone = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.com/")], "page_id long, url string")
    assert {r.page_id: r.rule for r in urlfilter.judge(alone, queries.URL_RULES).collect()} == {1: "net/", 2: None}


# importance resampling

def grams(text, least, most):
    s = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", s)
    return w, [zlib.crc32(" ".join(w[i:i + n]).encode()) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


TEXTS = [None, "", " ,.;", "one", "One TWO 3three", "naïve Ünïcode 数字\u3000x\x7fy{z}", "a" * 70_000 + " b", "x " * 400, "-a--b-", "a b c d e f g h"]


@pytest.mark.parametrize("least,most", [(1, 1), (1, 2), (2, 4), (5, 5)])
def test_prefix_crcs_give_every_ngram(least, most):
    tables = importance.shift_tables()
    words, found = importance.buckets_of(TEXTS, least, most, 2**32 - 1, tables)
    for t, n, f in zip(TEXTS, words, found, strict=True):
        w, want = grams(t, least, most)
        assert n == len(w) and sorted(f.tolist()) == sorted(c % (2**32 - 1) for c in want)


def test_shift_cancels(spark):
    tables = importance.shift_tables()
    r = random.Random(2)
    for n in (0, 1, 7, 255, 4096, 100_003):
        a, b = r.randbytes(9), r.randbytes(n)
        out = importance.shift(np.array([zlib.crc32(a)], np.uint32), np.array([n]), tables)
        assert zlib.crc32(a + b) ^ int(out[0]) == zlib.crc32(b)


@pytest.mark.parametrize("ngrams,share", [((1, 1), (10, 100)), ((1, 2), (1, 2)), ((1, 1), (1, 1))])
def test_resampling(spark, ngrams, share):
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(15, 60))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(7, texts[7]), (7, texts[7]), (7, texts[8]), (None, texts[9])]
    target = [" ".join(f"w{r.randrange(20)}" for _ in range(40)) for _ in range(10)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 1, 2, 3.0) for i, t in rows], "doc_id long, text string, row_number int, weight int, score double").repartition(5)
    bench = spark.createDataFrame([(t, i) for i, t in enumerate(target)], "text string, doc_id int")
    got = importance.resample(docs, bench, ngrams, 1000, 20, share).collect()
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(c % 1000 for c in grams(x, *ngrams)[1])
    for x in target:
        t.update(c % 1000 for c in grams(x, *ngrams)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 1000) / ((s[b] + 1.0) * (T + 1000)))) for b in s}
    want = []
    for i, x in rows:
        w, f = grams(x, *ngrams)
        weight = sum(gain[c % 1000] for c in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 2**32))), len(w) >= 20))
    fit = sorted((w for w in want if w[4]), key=lambda w: (-w[3], -1 if w[0] is None else w[0]))
    drawn = [w[:4] for w in fit[:share[0] * len(fit) // share[1]]]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted((w[:4] for w in want), key=key)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.score, r.doc_id) for r in ranked] == [(d[3], d[0]) for d in drawn]


def test_resampling_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert [(r.doc_id, r.n_features, r["rank"]) for r in importance.resample(some, none).collect()] == [(1, 2, None)]


# hard negatives

def mined(rows, is_anchor, n_pos, n_neg, low, high):
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows})
    out = []
    for i, lab, v in rows:
        if not is_anchor(i):
            continue
        other = sorted((-sum(a * b for a, b in zip(v, y)), j, m) for j, m, y in rows if j != i and len(y) == len(v))
        for s, j, _ in [x for x in other if x[2] == lab][:n_pos]:
            ok = [(-t, k) for t, k, m in other if m != lab and low[0] * -s <= low[1] * -t and high[1] * -t <= high[0] * -s][:n_neg]
            out += [(i, j, n + 1, k, -s, t) for n, (t, k) in enumerate(ok)]
    return sorted(out)


@pytest.mark.parametrize("row_block,anchor_block,partitions", [(2048, 256, 3), (16, 4, 11)])
def test_hard_negatives(spark, monkeypatch, row_block, anchor_block, partitions):
    monkeypatch.setattr(negatives, "ROW_BLOCK", row_block)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", anchor_block)
    rng = np.random.default_rng(4)
    vec = rng.integers(-9, 10, (300, 6)).astype(float)
    vec[100:180] = vec[100]  # a hot vector: ties
    rows = [(int(i), int(rng.integers(0, 4)), [float(x) for x in v]) for i, v in enumerate(vec)]
    rows += [(20, rows[20][1], rows[20][2])] * 3 + [(40, 1, [1.0] * 6), (40, 2, [2.0] * 6), (400, 1, [3.0, 1.0]), (401, 2, [2.0, 1.0]), (402, 1, [1.0, 1.0]),
             (-20, 1, [4.0] * 6), (600, 3, [0.0] * 6)]
    odd = [(None, 1, [1.0] * 6), (500, None, [1.0] * 6), (520, 1, None), (540, 1, []), (560, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (580, 1, [float("nan")] + [1.0] * 5)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, label int, embedding array<double>, id int, dim string").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = negatives.mine(df, F.col("id") % 20 == 0, 3, 4).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = mined(rows, lambda i: i % 20 == 0, 3, 4, (30, 100), (90, 100))
    assert sorted(map(tuple, got)) == want and len(want) > 50
    assert negatives.mine(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_stream_holds_open_windows_only():
    a = (5, 2, 0, 0)
    keys = sorted([negatives.pack(a, 100, 0, 1), negatives.pack(a, 50, 0, 2), negatives.pack(a, 95, 1, 9), negatives.pack(a, 90, 1, 8),
                   negatives.pack(a, 45, 1, 7), negatives.pack(a, 14, 1, 6), negatives.pack((6, 2, 0, 1), 3, 1, 1), negatives.pack(a, 0, 0, 3), negatives.pack(a, 0, 1, 4)])
    assert list(negatives.stream(iter(keys), 2, (30, 100), (90, 100))) == [
        (5, 1, 1, 8, 100, 90), (5, 1, 2, 7, 100, 45), (5, 2, 1, 7, 50, 45), (5, 3, 1, 4, 0, 0)]
    # ids and scores keep their order as bytes
    for x, y in itertools.pairwise(sorted([-2**62, -1, 0, 1, 2**62])):
        assert negatives.pack((x, 1, 0, 0), 0, 0, 0) < negatives.pack((y, 1, 0, 0), 0, 0, 0)
        assert negatives.pack(a, y, 0, 0) < negatives.pack(a, x, 0, 0) and negatives.pack(a, 0, 0, x) < negatives.pack(a, 0, 0, y)


def test_quantised_vectors_of_the_query(spark):
    v = spark.createDataFrame([(1, [0.5, -0.001, None]), (2, [0.5, -0.001])], "vec_id long, embedding array<float>")
    assert [r.q for r in v.select(topk.quantise(F.col("embedding"), 256.0).alias("q")).collect()] == [None, [128.0, -1.0]]

"""Corpus operators against brute force, on small tables with nulls, empty and very long texts, ties, repeated rows and
other columns whose names clash with the operators' own."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import brown, chat, components, dedup, langid, ngram_join, packing, pieces, queries, sharding, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, tile long, word string, length long, norm string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, 1, 2, "w", 3, "n") for i, t, lang in rows], SCHEMA)


def words(n, seed=0, pool=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    base = words(300, 1)
    near = base.replace("w1 ", "zz ", 1)
    return [(1, None, None), (2, "", "en"), (3, " \t\n", "en"), (4, base, "en"), (5, base, "en"), (5, base, "en"), (6, near, "de"),
            (7, base.replace(" ", "\n "), None), (8, "one", "en"), (9, "One two", "en"), (10, words(20_000, 2, 9000), "en"),
            (11, words(250, 3), "de"), (None, base, "en"), (12, "x" * 5000, "en"), (13, "naïve Σίσυφος 'll <|endoftext|> 数字 x y", "en")]


def test_empty_tables(spark):
    none = table(spark, [])
    path = queries.vocabulary_path("word_bpe_49k.json")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert packing.pack(none, path).count() == 0
    assert sharding.shard(none, 100).count() == 0
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(v, v).count() == 0
    assert toxicity.toxic_passages(none, toxicity.train(none, labels)).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.placed(chat.rotate(turns)).count() == 0
    assert pieces.digests(none, pieces.load(spark, queries.vocabulary_path("piece_bpe_32k.model"))).count() == 0
    assert dedup.exact_groups(none).count() == 0
    assert langid.train(none) is None and none.select(langid.predict(none, None)).count() == 0
    assert ngram_join.near_duplicate_groups(none).count() == 0
    assert brown.score(none, brown.train(none)).count() == 0


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(table(spark, odd), path).toPandas()
    want = []
    for i, t, _ in odd:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(-1 if i is None else i, p // 4096, p, len(x), zlib.crc32(x.tobytes())) for p in range(0, len(ids), 4096) for x in [ids[p:p + 4096]]]
    have = got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype("int64")
    assert sorted(map(tuple, have.to_numpy().tolist())) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.r_[0, g.length.cumsum()[:-1]]).all() and g.length.sum() <= 4096


def test_plan_pairs_large_items_and_fills_gaps():
    rng = np.random.default_rng(0)
    for cap in (12, 60):
        for _ in range(60):
            lengths = rng.integers(1, cap + 1, rng.integers(1, 60))
            rules, bins = packing.plan(np.bincount(lengths, minlength=cap + 1), cap)
            room, large = np.zeros((bins, cap), int), np.zeros(bins, int)
            for length, _, n, first, offset, each in rules:
                for j in range(n):
                    at = offset + j % each * length
                    room[first + j // each, at:at + length] += 1
                    assert at + length <= cap
                    large[first + j // each] += 3 * length > cap
            assert room.max() == 1 and room.sum() == lengths.sum() and large.max() <= 2
            assert (np.diff(room, axis=1) <= 0).all()  # gapless from 0
            # no worse than first-fit decreasing by more than a bin
            ffd = []
            for x in sorted(lengths, reverse=True):
                k = next((i for i, f in enumerate(ffd) if f + x <= cap), None)
                if k is None:
                    ffd.append(x)
                else:
                    ffd[k] += x
            assert bins <= len(ffd) + 1


def test_sharding(spark, odd):
    rows = [(i, words(3 + i % 50, i), "en") for i in range(600)]
    got = sharding.shard(table(spark, rows + [(7, "y" * 5000, "en")]), 4000).select("doc_id", F.octet_length("text").alias("b"), "shard.*").toPandas()
    assert len(got) == 601
    h = got.doc_id.map(lambda d: int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16))
    assert all(x >> (60 - d) == p for x, d, p in zip(h, got.depth, got.prefix))
    per = got.groupby("id").agg(b=("b", "sum"), n=("b", "size"), nb=("n_bytes", "first"), nr=("n_rows", "first"), over=("oversized", "first"))
    assert (per.b == per.nb).all() and (per.n == per.nr).all() and ((per.b > 4000) == per.over).all() and per.over.sum() == 1
    # a bucket was split only because its parent was too large
    for d, p in set(zip(got.depth, got.prefix)):
        if d:
            assert got.b[[x >> (61 - d) == p >> 1 for x in h]].sum() > 4000
    assert sharding.shard(table(spark, odd), 100).count() == len(odd)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 24)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (900, None), (920, [float("nan")] * 24), (940, [1.0, None]), (960, [1.0, 2.0])]
    rows += [(1000 + i, x[5].tolist()) for i in range(30)]  # ties
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("embedding", topk.quantise(F.col("embedding")))
    got = topk.top_k(v, v.where("vec_id % 20 = 0"), 20).toPandas()
    good = {i: np.floor(64 * np.array(w)).astype(int) for i, w in rows if w and len(w) == 24 and all(c is not None and math.isfinite(c) for c in w)}
    want = []
    for q in (i for i in good if i % 20 == 0):
        best = sorted(((-int(good[q] @ w), i) for i, w in good.items() if i != q))[:20]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(got[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None)) == sorted(want)


def test_segments_are_the_maximal_ones():
    rng = random.Random(4)

    def brute(s):  # the best run, then the same left and right of it
        best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        _, _, _, i, j = best
        return brute(s[:i]) + [(i, j - 1)] + [(a + j, b + j) for a, b in brute(s[j:])]

    for _ in range(300):
        s = [rng.choice([-0.5, -0.5, -0.5, 1.25, 2.125, 0.375]) for _ in range(rng.randrange(14))]
        hits = [(i, x) for i, x in enumerate(s) if x > 0]
        got = [(f, e) for _, f, e in toxicity.segments(hits)]
        assert sum(sum(s[f:e + 1]) for f, e in got) == pytest.approx(sum(sum(s[f:e + 1]) for f, e in brute(s)))
        assert all(b < c for (_, b), (c, _) in itertools.pairwise(got))


def test_toxicity(spark, odd):
    r = random.Random(5)
    bad = ["vilest", "vilely", "rotfool", "rotfools"]
    rows, labels = [], []
    for i in range(800):
        t = ["q" + "".join(chr(97 + int(c)) for c in str(r.randrange(300))) for _ in range(60)]
        if i % 5 == 0:
            for _ in range(3):
                t.insert(r.randrange(60), r.choice(bad))
        rows.append((i, " ".join(t), "en"))
        labels.append((i, int(i % 5 == 0)))
    labels = spark.createDataFrame(labels + [(None, 1), (900, None)], "doc_id long, toxic int")
    model = toxicity.train(table(spark, rows), labels.where("doc_id % 4 <> 0"))
    got = toxicity.toxic_passages(table(spark, rows), model).toPandas()
    wrong = [(d, s) for d, s in zip(got.doc_id, got.score) if (s >= 0.5) != (d % 5 == 0)]
    assert len(wrong) <= 8
    assert toxicity.toxic_passages(table(spark, odd), model).where("score between 0 and 1").count() == len(odd)


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 2, "assistant", "hello"), (2, 0, None, None),
            (None, 0, "user", "lost"), (3, None, "a", "x"), (3, 5000, "b", "y" * 3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    at = chat.placed(chat.rotate(turns)).toPandas()
    whole = {(r.conv_id, r.assistant): r.text for r in chat.dialogues(chat.rotate(turns)).collect()}
    assert whole[1, "assistant"] == ("<|im_start|>user name=system\nbe kind<|im_end|>\n<|im_start|>user name=user\nhi<|im_end|>\n"
                                     "<|im_start|>assistant\nhello<|im_end|>\n")
    assert {k[1] for k in whole if k[0] == 1} == {"system", "user", "assistant"} and whole[2, "unknown"] == "<|im_start|>assistant\n<|im_end|>\n"
    for r in at.itertuples():
        text = whole[None if math.isnan(r.conv_id) else r.conv_id, r.assistant]
        assert text[r.start:r.start + r.length] == r.rendered
        assert (r.mask is not None) == r.loss == (r.speaker == r.assistant)


def test_pieces(spark, odd):
    p = pieces.load(spark, queries.vocabulary_path("piece_bpe_32k.model"))
    score = {r.piece: (r.score, r.id) for r in p.table.collect()}
    docs = table(spark, odd[:9] + odd[11:])

    def best(word):
        path = [(0.0, [])]
        for e in range(1, len(word) + 1):
            found = None
            for s in range(max(0, e - p.longest), e):
                piece = word[s:e]
                if piece in score:
                    c = (path[s][0] + score[piece][0], path[s][1] + [score[piece][1]])
                elif e == s + 1:
                    c = (path[s][0] + len(piece.encode()) * pieces.BYTE_SCORE, path[s][1] + [p.byte_ids[b] for b in piece.encode()])
                else:
                    continue
                if found is None or c[0] > found[0]:
                    found = c
            path.append(found)
        return path[-1][1]

    coded = pieces.decode(pieces.encode(docs, p), p).toPandas()
    texts = Counter((i, t) for i, t, _ in odd[:9] + odd[11:])
    for r in coded.itertuples():
        t = next(t for i, t in texts if i == r.doc_id or (i is None and math.isnan(r.doc_id)))
        ws = pieces.split_words(t)
        assert list(r.ids) == [x for w in ws for x in best(w)]
        assert "".join((r.decoded or "").split()) == "".join((t or "").split())
    got = pieces.digests(docs, p).toPandas()
    assert got.exact.all() and len(got) == len(coded)
    dealt = Counter(map(tuple, pieces.digests(docs, p, frequent=3).collect()))  # nearly all words by join
    assert dealt == Counter(map(tuple, pieces.digests(docs, p).collect()))
    for r in got.itertuples():
        t = next(t for i, t in texts if i == r.doc_id or (i is None and math.isnan(r.doc_id)))
        ids = [best(w) for w in pieces.split_words(t)]
        want = sum(zlib.crc32(",".join(map(str, x)).encode()) % pieces.PRIME * (pieces.FACTOR * (i + 1) % pieces.PRIME) for i, x in enumerate(ids)) % pieces.PRIME
        assert (r.n_words, r.n_pieces, r.ids_digest) == (len(ids), sum(map(len, ids)), want)


@pytest.mark.parametrize("partitions", [None, 7])
def test_exact_groups(spark, odd, partitions):
    rows = odd + [(100 + i, "Same  text" + " " * (i % 3), "en") for i in range(200)]
    got = dedup.exact_groups(table(spark, rows), partitions=partitions).toPandas()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault("".join(c for c in (t or "") if c not in " \t\n\v\f\r"), []).append((-len(t or ""), i is None, i))
    want = Counter((i, min(g)[2], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, _, i in g)
    none = lambda x: None if x is None or x != x else int(x)
    assert Counter((none(r.doc_id), none(r.keep_id), r.group_size, r.text_sha256) for r in got.itertuples()) == want
    assert got.kept.sum() == len(groups) and (got[got.kept].doc_id.fillna(-1) == got[got.kept].keep_id.fillna(-1)).all()
    left = dedup.drop_exact_duplicates(table(spark, rows).coalesce(1))
    assert left.count() == len(groups) and left.columns == table(spark, []).columns


def test_language(spark, odd):
    r = random.Random(6)
    sounds = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["schw", "eim", "ung", "ück"], "cc": ["ção", "lhe", "que", "dos"]}
    rows = [(i, " ".join("".join(r.choices(sounds[g], k=3)) for _ in range(r.randrange(3, 200))), g) for i in range(900) for g in ["aa bb cc".split()[i % 3]]]
    docs = table(spark, rows + [(1000, None, "aa"), (1001, "123 ... 456", "bb"), (1002, "", None)])
    net = langid.train(docs.where("doc_id % 3 <> 0 or doc_id % 9 = 0"))
    got = docs.select("doc_id", "lang", langid.predict(docs, net).alias("p")).select("doc_id", "lang", "p.lang", "p.score").toDF("i", "lang", "told", "score").toPandas()
    assert (got.told[got.i < 900] == got.lang[got.i < 900]).mean() > 0.97 and (got.told[got.i >= 1000] == "und").all()
    odd_docs = table(spark, odd)
    assert odd_docs.select(langid.predict(odd_docs, net).alias("p")).where("p.score between 0 and 1").count() == len(odd)


@pytest.mark.parametrize("width,num,den", [(3, 9, 10), (5, 4, 5)])
def test_near_duplicates(spark, odd, width, num, den):
    r, rows = random.Random(8), list(odd)
    for k in range(30):
        base = words(r.choice([6, 9, 14, 40, 120]), 50 + k).split()
        for c in range(6):
            t = list(base)
            for _ in range(r.randrange(3)):
                t[r.randrange(len(t))] = f"e{r.randrange(99)}"
            rows.append((200 + 10 * k + c, " ".join(t), "en"))

    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t, _ in rows if i is not None}
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            top[y] = x
    got = ngram_join.near_duplicate_groups(table(spark, rows), width, num, den).toPandas()
    assert len(got) == len(rows)
    for x in got.itertuples():
        if not math.isnan(x.doc_id):
            assert (x.n_shingles, x.component_id) == (len(sets[x.doc_id]), root(x.doc_id))
        else:
            assert math.isnan(x.component_id)


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(5, 5), (None, 4)] + [(1000, 1000 + i) for i in range(50)]
    top = {i: i for e in edges for i in e if None not in e and e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a in top and b in top:
                top[a] = top[b] = min(top[a], top[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x["id"]: x.component for x in got} == {k: v for k, v in top.items()} and len(got) == len(top)


def test_class_model(spark, odd):
    rows = odd + [(300 + i, words(80, i, 60), "en") for i in range(120)]
    docs = table(spark, rows)
    train = [t for i, t, _ in rows if i is not None and i % 4]
    model = brown.train(docs.where("doc_id % 4 <> 0"))
    got = brown.score(docs, model).toPandas()
    count = Counter(w for t in train for w in brown.tokens(t))
    total, kinds = sum(count.values()) + len(train), len(count) + 1
    assert (model.total, model.distinct, len(got)) == (total, kinds, len(rows))
    texts = {i: t for i, t, _ in rows}
    for r in got.itertuples():
        w = brown.tokens(texts[None if math.isnan(r.doc_id) else r.doc_id])
        base = sum(math.log10((c + 0.1) / (total + 0.1 * (kinds + 1))) for c in [*(count[x] for x in w), len(train)])
        assert (r.n_tokens, r.n_known) == (len(w) + 1, sum(count[x] > 0 for x in w) + 1) and r.base_score == pytest.approx(base, rel=1e-9)
    # transitions and emissions are probabilities: over all known words and one unknown each row sums to 1
    assert np.allclose((10.0 ** model.step).sum(1), 1)
    mass = np.zeros(len(model.room))
    for w, c in count.items():
        k = model.cls[model.types.of(w)]
        mass[k] += (c + 0.1) / 10 ** model.room[k]
    mass[0] += (len(train) + 0.1) / 10 ** model.room[0]
    assert np.allclose(mass + 0.1 / 10.0 ** model.room, 1)


def test_pipeline(spark, tmp_path):
    """The stages' decisions against brute force on the rows that reach each stage."""
    docs = [(i, f"{words(60, i)} x{i}", "en") for i in range(40)]
    base = words(200, 77)
    docs += [(50, base, "en"), (51, base + " ", "en"), (52, base.replace("w1 ", "qq ", 1), "en"), (60, None, None), (61, "", "en"), (62, "12 34", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(0).cast("long")) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        now.sparkSession.conf.get("spark.sql.shuffle.partitions")
        out = stage(spark, now, str(tmp_path))
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        left.append(sorted(r[0] for r in now.select("doc_id").distinct().collect()))
    clean = list(range(40))
    assert left[0] == clean + [50, 51, 52] and left[1] == left[0]
    assert left[2] == clean + [51, 52] and left[3] == clean + [51] and left[4] == left[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()

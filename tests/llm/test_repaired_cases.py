"""Cases that earlier versions got wrong: clashing ids, many hits, many languages, the end of the frequent words."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, langid, ngram_join, packing, toxicity


@pytest.mark.parametrize("turned", [False, True])
def test_one_id_with_several_texts(spark, turned):
    r = random.Random(1)
    a, b = ([f"{k}{r.randrange(300)}" for _ in range(120)] for k in "ab")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join(a[:-1])), (9, " ".join(b[:-1])), (3, "quite another text of its own"), (5, ""), (None, " ".join(a))]
    docs = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").coalesce(1)
    got = ngram_join.near_duplicate_groups(docs, 3, 9, 10).where("doc_id is not null and n_shingles > 0").collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (7, 5), (9, 5), (3, 3)}


def test_segments_in_linear_time():
    started = time.process_time()
    assert len(toxicity.segments([(20 * i, 2.0) for i in range(200_000)])) == 200_000
    assert time.process_time() - started < 2


def test_network_equals_a_direct_convolution():
    net = langid.ByteNet(["x", "y"])
    x = langid._windows("Grüße, 12 Wörter! ".encode() * 20)
    a = net.activations(x, net.tables())
    for k, w in enumerate(langid.WIDTHS):
        cols = slice(k * langid.FILTERS, (k + 1) * langid.FILTERS)
        for i in (0, 17, langid.WINDOW - 4):
            direct = sum(net.conv[k][tap][x[:, i + tap]] for tap in range(w))
            assert np.allclose(a[:, i, cols], direct, atol=1e-5)


def test_every_language_is_learned(spark):
    langs = [f"l{i:03d}" for i in range(150)]
    rows = [(i, f"{chr(0x4e00 + i % 150)}" * 30 + " ab", langs[i % 150]) for i in range(450)]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.langs == langs


def test_frequent_rows_without_a_sort(spark):
    r = random.Random(2)
    n = [int(r.paretovariate(0.6)) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in n], "n long").repartition(7)
    for most in (0, 1, 10, 700, 4999, 5000, 10_000):
        cut = common.frequent_from(df, most)
        held = sum(v >= cut for v in n)
        assert held <= most
        nearer = sorted({v for v in n if v < cut}, reverse=True)
        # the next step of the scale would be too many
        assert not nearer or sum(v >= nearer[0] * 0.997 - 1 for v in n) > most


def test_words_in_batches_give_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        encode = packing.word_encoder(f.read())
    tok = Tokenizer.from_file(path)
    texts = ["", " ", "Don't stop... it's we've 'tis rock'n'roll.", "a.b,c;d!?  e.?!'s x.'s .' .", "tab\tand\nline", "İstanbul ŒUVRE straße.", "数字 and words.", "<|endoftext|> x",
             "w1. w2, 12.5; (paren). \"quoted.\" it.", "\x01 mark", "z" * 5000 + "."] * 3
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode(texts) == want and encode(texts) == want

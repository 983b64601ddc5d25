"""Piece encoding of whole texts: words of any length, white space."""

from pyspark.sql import functions as F

from quarry.llm import pieces, queries


def model(spark):
    return pieces.load(spark, queries.vocabulary_path("piece_bpe_32k.model"))


def test_long_words_have_one_best_path(spark, monkeypatch):
    p = model(spark)
    words = ["information" * 60, "数字中文漢字" * 100 + "🙂é" * 40, "https://example.org/" + "a1b2c3" * 90, "short", "e" * 257]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in pieces.encode(docs, p).collect()}
    monkeypatch.setattr(pieces, "LONG_WORD", 10_000)  # the relational lattice over whole words
    want = {r.doc_id: list(r.ids) for r in pieces.encode(docs, p).collect()}
    assert got == want
    cut = [pieces.long_path(("▁" + words[0])[i:i + 256], p.scores, p.longest, p.byte_ids) for i in range(0, 661, 256)]
    assert got[0] != sum(cut, [])  # a cut word's parts don't make the word's path
    told = pieces.decode(pieces.encode(docs, p), p).select("doc_id", F.col("decoded").alias("t"))
    assert {r.doc_id: r.t for r in told.collect()} == dict(enumerate(words))


def test_white_space_is_encoded(spark):
    import zlib

    import sentencepiece

    p = model(spark)
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary_path("piece_bpe_32k.model"))
    texts = ["a  b\nc", "  a", " ", "\n", "\t\tx\r\n\r\n    if y:\n\tz  ", "\u3000x\u00a0y\x1c\x1f z", "a\n\n\n b", "", None, "one two", "a" + " " * 700 + "b",
             "a \u2581 b", "a\u2581b", "\u2581"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {r.doc_id: list(r.ids) for r in pieces.encode(docs, p).collect()}
    told = {r.doc_id: r.decoded for r in pieces.decode(pieces.encode(docs, p), p).collect()}
    assert {i: told[i] for i in range(11)} == {i: t or "" for i, t in enumerate(texts[:11])}
    assert ids[0] == [lib.piece_to_id(x) for x in ("▁a", "▁", "▁b", "<0x0A>", "c")] and ids[0] == lib.encode(texts[0])
    # best path of the whole text as one word
    assert ids == {i: p_ for i, t in enumerate(texts) for p_ in [pieces.long_path(("▁" + t.replace(" ", "▁")) if t else "", p.scores, p.longest, p.byte_ids)]}
    for frequent in (pieces.FREQUENT, 2):
        got = {r.doc_id: r for r in pieces.digests(docs, p, frequent=frequent).collect()}
        assert {i for i in got if not got[i].exact} == {11, 12, 13}  # a mark of the text's own comes back as a space
        for i, t in enumerate(texts):
            words = [pieces.long_path(w, p.scores, p.longest, p.byte_ids) for w in pieces.split_words(t)]
            want = sum(zlib.crc32(",".join(map(str, x)).encode()) % pieces.PRIME * (pieces.FACTOR * (k + 1) % pieces.PRIME) for k, x in enumerate(words))
            assert (got[i].n_words, got[i].n_pieces, got[i].ids_digest) == (len(words), len(ids[i]), want % pieces.PRIME)


def test_digests_come_from_whole_lists_of_ids(spark, monkeypatch):
    """Every document's ids are put together and decoded: a wrong id anywhere in a list shows in ``exact``."""
    p = model(spark)
    rows = [(1, "one two zyxwv two"), (1, "one two zyxwv two"), (None, "zyxwv  qponm 🙂"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    whole = pieces.decode

    def spied(coded, pieces_, *rest, **named):
        seen.extend((r.doc_id, tuple(r.ids)) for r in coded.collect())
        return whole(coded, pieces_, *rest, **named)

    monkeypatch.setattr(pieces, "decode", spied)
    got = pieces.digests(docs, p, frequent=2).collect()
    path = lambda t: tuple(pieces.long_path(("▁" + t.replace(" ", "▁")) if t else "", p.scores, p.longest, p.byte_ids))
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(seen, key=key) == sorted(((i, path(t)) for i, t in rows), key=key)
    assert sorted((r.doc_id or 0, r.n_pieces, r.exact) for r in got) == sorted((i or 0, len(path(t)), True) for i, t in rows)
    last = p.texts.index("v") if "v" in p.texts else 300
    monkeypatch.setattr(pieces, "decode", lambda coded, *rest, **named: whole(coded.withColumn("ids", F.when(
        F.size("ids") > 0, F.concat(F.slice("ids", 1, F.size("ids") - 1), F.array(F.lit(last), F.lit(last)))).otherwise(F.col("ids"))), *rest, **named))
    assert sorted((r.doc_id or 0, r.exact) for r in pieces.digests(docs, p).collect()) == [(0, False), (1, False), (1, False), (2, True), (3, True)]

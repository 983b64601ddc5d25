"""The steps of the piece encoding that take many words at once, against one word at a time."""

import random
import zlib

import pyarrow as pa

from quarry.llm import pieces, queries

SIGNS = [" ", " ", "\t", "\n", "\r", "a", "b", "th", "e", "ing", "é", "漢", "🙂", "　", "▁", "0"]


def texts(n, seed=3):
    r = random.Random(seed)
    return [None, "", " ", "\n", "a"] + ["".join(r.choices(SIGNS, k=r.randrange(60))) for _ in range(n)]


def test_cut_is_spaced_words():
    some = texts(300)
    for part in (pa.array(some), pa.array(some).slice(7, 90), pa.array([None, ""])):
        words, counts = pieces.cut(part)
        want = [pieces.spaced_words(t) for t in part.to_pylist()]
        assert words.to_pylist() == [w for ws in want for w in ws] and counts.tolist() == [len(ws) for ws in want]


def test_digests_of_many_words_at_once():
    r = random.Random(4)
    rows = [[[r.choice([0, 7, 10, 99, 100, 31_999, 65_536]) for _ in range(r.choice([1, 2, 5, 64, 65, 200]))] for _ in range(r.randrange(20))] for _ in range(700)]
    want = [sum(zlib.crc32(",".join(map(str, w)).encode()) % pieces.PRIME * (pieces.FACTOR * (i + 1) % pieces.PRIME) for i, w in enumerate(ws)) % pieces.PRIME for ws in rows]
    got = pieces.word_digests(pa.array([[x for w in ws for x in w] for ws in rows], pa.list_(pa.int32())), pa.array([[len(w) for w in ws] for ws in rows], pa.list_(pa.int32())))
    assert got.to_pylist() == want


def test_words_and_documents_over_small_batches(spark, monkeypatch):
    """Words and documents whose rows go on in the next batch; neither texts nor lists of a document's words are grouped."""
    p = pieces.load(spark, queries.vocabulary_path("piece_bpe_32k.model"))
    monkeypatch.setattr(pieces, "EDGES", 50)
    some = texts(120) + [" ".join(f"zq{i}x{j}" for i in range(40)) for j in range(6)]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        words = pieces.coded_words(docs, p, frequent=5)
        got = {r.word: list(r.ids) for r in words.table.collect()}
        src = pieces.asked(docs, words, "doc_id", "text")
        whole = pieces.put_together(src, words)
        ids = {r.doc_id: (list(r.ids), list(r.sizes)) for r in whole.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    path = lambda w: pieces.long_path(w, p.scores, p.longest, p.byte_ids)
    assert got == {w: path(w) for t in some for w in pieces.split_words(t)}
    for i, t in enumerate(some):
        each = [path(w) for w in pieces.split_words(t)]
        assert ids[i] == ([x for e in each for x in e], [len(e) for e in each])
    assert "text" not in src.columns and "collect_list" not in whole._jdf.queryExecution().toString()

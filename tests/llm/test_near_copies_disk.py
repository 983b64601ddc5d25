"""Near copies: tiles of the same members are kept once, sets of compared pairs travel in bounded parts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.llm import ngram_join

ROWS = [(t, i) for t in (1, 2, 3) for i in (10, 11)] + [(4, i) for i in (10, 11, 12)] + [(5, 13)] + [(6, i) for i in range(20, 40)]


@pytest.mark.parametrize("held", [1 << 20, 4])
def test_tiles_of_the_same_members_are_kept_once(spark, monkeypatch, held):
    monkeypatch.setattr(ngram_join, "TILE_HELD", held)  # 4: tile 6 goes on as it is
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # tiles go on over several batches
    try:
        got = ngram_join._shared_tiles(spark.createDataFrame(ROWS, "tile long, id long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    tiles = {}
    for r in got:
        tiles.setdefault(r["tile"], []).append(r["id"])
    assert sorted(sorted(v) for v in tiles.values()) == [[10, 11], [10, 11, 12], list(range(20, 40))]


def test_pairs_are_verified_in_parts(spark, monkeypatch):
    sets = spark.createDataFrame([(i, list(range(i % 3, 100))) for i in range(12)], "id long, hashes array<long>")
    pairs = [(a, b, 100 - a % 3) for a in range(12) for b in range(a + 1, 12)]
    calls = []
    verify = ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda p, *a: calls.append(1) or verify(p, *a))
    links = ngram_join._links(spark.createDataFrame(pairs, "a long, b long, n int"), sets, 99, 100, 1200)
    assert {(r["a"], r["b"]) for r in links.collect()} == {(a, b) for a, b, _ in pairs if 100 * (100 - max(a % 3, b % 3)) >= 99 * (100 - min(a % 3, b % 3))}
    assert len(calls) == -(-sum(n for _, _, n in pairs) // 1200)
    assert ngram_join._links(spark.createDataFrame(pairs, "a long, b long, n int").where(F.lit(False)), sets, 99, 100, 1200) is None


def test_rows_that_occur_twice_are_one_set(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (1, " ".join(words)), (2, " ".join(words[:-2] + ["x"])), (3, "alone here")]
    got = ngram_join.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (1, 1), (2, 1), (3, 3)]

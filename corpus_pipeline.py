"""Corpus pipeline: language, toxicity, exact copies, near copies, packing.

Each stage takes the documents that the one before it kept, written as Parquet and read again, and returns the
columns of ``documents`` for those it keeps; the last returns the packed pieces. Stages stand an empty table, null
ids, languages and texts, and other columns, which they hand on.

* language: the byte network is fitted on the documents' own labels; documents without text or without a letter and
  those of which no language is likely (a score under MIN_LANGUAGE) go.
* toxicity: fitted on the ``labels`` that cover the documents; documents with a score of 0.5 or more go.
* exact copies: of equal texts (white space aside) the longest, then smallest doc_id stays.
* near copies: shingles of five words, similarity 0.8 or more; of each group the smallest doc_id stays.
* packing: sequences of 4,096 ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import dedup, langid, ngram_join, packing, toxicity
from quarry.llm.common import stored, table

MIN_LANGUAGE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8."""
    net = langid.train(docs)
    told = langid.predict(docs, net, "text")
    return docs.where((told["lang"] != "und") & (told["score"] >= MIN_LANGUAGE))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(model)(F.col("text")) < 0.5)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7."""
    return dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9."""
    return ngram_join.drop_near_duplicates(docs, width=5, num=4, den=5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", toxic), ("exact copies", exact_copies), ("near copies", near_copies), ("packing", packed)]

#: Two of the stages are fitted models, which SQL cannot express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

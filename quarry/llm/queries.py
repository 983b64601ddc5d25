"""The corpus operators as queries over the given tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import brown, chat, dedup, importance, langid, negatives, ngram_join, packing, pieces, sharding, topk, toxicity, urlfilter
from quarry.llm.common import remainder, table

#: Bytes of text a shard may hold.
SHARD_BYTES = 4 << 20


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard: doc_id, depth, prefix, shard_rows, shard_bytes, oversized."""
    docs = table(spark, sf_dir, "documents")
    return sharding.shard(docs, SHARD_BYTES).select(
        "doc_id", "shard.depth", "shard.prefix", F.col("shard.n_rows").alias("shard_rows"), F.col("shard.n_bytes").alias("shard_bytes"), "shard.oversized")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    whole = vectors.withColumn("embedding", topk.quantise(F.col("embedding")))
    return topk.top_k(whole, whole.where("vec_id % 20 = 0"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(remainder("doc_id", 5) != 0))
    scored = toxicity.toxic_passages(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dialogue from each participant's view: turns, characters, characters with loss, digest of the rendered
    turns (28 bits of each one's md5, weighted by turn number)."""
    turns = chat.placed(chat.rotate(table(spark, sf_dir, "conversations")))
    bits = F.conv(F.substring(F.md5(F.col("rendered").cast("binary")), 1, 7), 16, 10).cast("long")
    return turns.groupBy("conv_id", "assistant").agg(
        F.count("*").alias("n_turns"), F.sum("length").alias("n_chars"), F.max(F.col("start") + F.col("length")).alias("end_char"),
        F.coalesce(F.sum(F.col("mask.end") - F.col("mask.start")), F.lit(0)).alias("loss_chars"),
        F.sum(F.col("mask.start")).alias("loss_starts"), F.sum(bits * (F.coalesce("turn", F.lit(0)) + 1)).alias("digest"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), pieces.load(spark, vocabulary_path("piece_bpe_32k.model")))


def op7_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents")).drop("row")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.train(docs.where(remainder("doc_id", 3) != 1))
    told = docs.select("doc_id", langid.predict(docs, net).alias("p"))
    return told.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_groups(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


def op10_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = brown.train(docs.where(remainder("doc_id", 10) != 0))
    return brown.score(docs, model).select(
        "doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).alias("train_tokens"), "base_score", "score")


#: (host, path, verdict) of the given lists.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    whole = vectors.withColumn("embedding", topk.quantise(F.col("embedding"), 256.0))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(whole, F.col("id") % 100 == 0, label=label)


QUERIES = {f.__name__: f for f in (op1_packing, op2_sharding, op3_topk, op4_toxicity, op5_chat, op6_pieces, op7_dedup, op8_langid,
                                   op9_ngram_join, op10_brown, op11_urlfilter, op12_importance, op13_negatives)} | {"pipeline": corpus_pipeline.run}

SQL = {
    "op2_sharding": f"""
        with recursive d as (
          select doc_id, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as h, coalesce(octet_length(encode(text)), 0)::bigint as b
          from documents),
        top as (select 0 as depth, 0::bigint as prefix, count(*) as n, coalesce(sum(b), 0)::bigint as bytes from d having count(*) > 0),
        tree as (
          select depth, prefix, n, bytes from top
          union all
          select * from (
            select t.depth + 1, d.h >> (59 - t.depth), count(*), sum(d.b)::bigint
            from tree t join d on d.h >> (60 - t.depth) = t.prefix
            where t.bytes > {SHARD_BYTES} and t.depth < 60
            group by t.depth + 1, d.h >> (59 - t.depth)) s)
        select d.doc_id, t.depth, t.prefix, t.n as shard_rows, t.bytes as shard_bytes, t.bytes > {SHARD_BYTES} as oversized
        from tree t join d on d.h >> (60 - t.depth) = t.prefix
        where t.bytes <= {SHARD_BYTES} or t.depth = 60""",
    "op3_topk": """
        with v as (
          select distinct vec_id, [floor(64 * x::double)::bigint for x in embedding] as q from embeddings
          where vec_id is not null and len(embedding) > 0 and len([x for x in embedding if x is not null and isfinite(x)]) = len(embedding)),
        p as (
          select a.vec_id as query_id, b.vec_id, list_sum([z[1] * z[2] for z in list_zip(a.q, b.q)])::bigint as score
          from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op5_chat": """
        with said as (select distinct conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as body from conversations),
        who as (select distinct conv_id as c, coalesce(role, 'unknown') as assistant from conversations),
        r as (
          select conv_id, assistant, turn, speaker, body, speaker = assistant as loss,
            '<|im_start|>' || case when speaker = assistant then 'assistant' else 'user name=' || speaker end || chr(10) as head
          from said join who on conv_id is not distinct from c),
        l as (select *, head || body || '<|im_end|>' || chr(10) as rendered from r),
        p as (
          select *, length(rendered) as len, coalesce(sum(length(rendered)) over (partition by conv_id, assistant
            order by turn nulls first, speaker, body rows between unbounded preceding and 1 preceding), 0) as start from l)
        select conv_id, assistant, count(*) as n_turns, sum(len)::bigint as n_chars, max(start + len)::bigint as end_char,
          coalesce(sum(case when loss then length(body) end), 0)::bigint as loss_chars, sum(case when loss then start + length(head) end)::bigint as loss_starts,
          sum(('0x' || substr(md5(rendered), 1, 7))::bigint * (coalesce(turn, 0) + 1))::bigint as digest
        from p group by conv_id, assistant""",
    "op7_dedup": r"""
        with d as (
          select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents),
        r as (
          select doc_id, norm, first_value(doc_id) over w as keep_id, row_number() over w as k, count(*) over (partition by norm) as group_size
          from d window w as (partition by norm order by length(t) desc, doc_id nulls last))
        select doc_id, keep_id, group_size, k = 1 as kept, sha256(norm) as text_sha256 from r""",
    "op12_importance": r"""
        with bits as (
          select i, list_reduce([i::bigint] || [k::bigint for k in range(8)], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
          from range(256) r(i)),
        crc as (select list(v order by i) as t from bits),
        said as (
          select 0 as side, row_number() over () as row, doc_id as id, coalesce(text, '') as text from documents
          union all select 1, row_number() over (), null, coalesce(text, '') from benchmark),
        w as (
          select side, row, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from said),
        known as (select distinct unnest(words) as word from w),
        hashed as (
          select word, xor(4294967295, list_reduce([4294967295::bigint] || [('0x' || substr(hex(encode(word)), 2 * k::int - 1, 2))::bigint
            for k in range(1, octet_length(encode(word)) + 1)], lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 10000 as bucket
          from known, crc),
        f as (select side, row, bucket from (select side, row, unnest(words) as word from w) join hashed using (word)),
        b as (select bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from f group by bucket),
        n as (select coalesce(sum(s), 0) as all_s, coalesce(sum(t), 0) as all_t from b),
        gain as (
          select bucket, floor(1000 * ln((t + 1)::double * (all_s + 10000)::double / ((s + 1)::double * (all_t + 10000)::double)))::bigint as g from b, n),
        weight as (select row, floor(sum(g)::double / count(*))::bigint as weight from f join gain using (bucket) where side = 0 group by row),
        scored as (
          select w.row, id as doc_id, len(words)::bigint as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
            (('0x' || substr(sha256('2024:' || coalesce(id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
          from w left join weight on w.row = weight.row where side = 0),
        ranked as (
          select row, row_number() over (order by score desc, doc_id nulls first, row) as place, count(*) over () as fit
          from scored where n_features >= 20)
        select doc_id, n_features, weight, score, case when place <= 10 * fit // 100 then place end as rank
        from scored left join ranked using (row)""",
    "op13_negatives": """
        with v as (
          select distinct vec_id as id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end) as label,
            [floor(256 * x::double)::bigint for x in embedding] as q from embeddings
          where vec_id is not null and label is not null and len(embedding) > 0
            and len([x for x in embedding if x is not null and isfinite(x)]) = len(embedding)),
        p as (
          select a.id as anchor_id, b.id as other, a.label = b.label as same, list_sum([z[1] * z[2] for z in list_zip(a.q, b.q)])::bigint as score
          from v a join v b on a.id % 100 = 0 and a.id <> b.id and len(a.q) = len(b.q)),
        near as (
          select anchor_id, other as positive_id, score as positive_score from p where same
          qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
        select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other)::int as rank,
          other as negative_id, positive_score, score as negative_score
        from near join p using (anchor_id)
        where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
        qualify rank <= 10""",
}

"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark.llm import attention_lm, language, pairwise_rank, quality_rules, transport_stream, warc
from pactspark.llm.mixing import mix_sources
from pactspark.llm.near_dedup import near_duplicates
from pactspark.llm.packing import pack, pieces
from pactspark.llm.sharding import shard_bytes

#: The vocabulary in both formats and its pattern; the files are installed on every node.
VOCABULARY = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, per_cent=80)


def _remainder(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % of


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_bytes(_table(spark, sf_dir, "documents"), shards=40)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    identifier = language.fit_identifier(docs.filter(_remainder(5) != 0))
    return language.identify(docs.select("doc_id", "text"), identifier).select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(pack(_table(spark, sf_dir, "documents"), *VOCABULARY)).drop("ids")


def op7_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = attention_lm.score_texts(docs, _remainder(7) != 2, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return scored.select("doc_id", (_remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    forest = quality_rules.fit_rules(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs.select("doc_id", "text"), forest).drop("text")


def op9_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.media_features(transport_stream.store_media(_table(spark, sf_dir, "documents")))


def op10_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ranker = pairwise_rank.fit_quality(docs, _table(spark, sf_dir, "labels").filter(_remainder(3) != 1))
    return pairwise_rank.apply_quality(docs.select("doc_id", "text"), ranker).select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (op1_near_dedup, op2_mixing, op3_sharding, op4_warc, op5_language, op6_packing, op7_attention_lm, op8_quality_rules, op9_transport_stream, op10_pairwise_quality)
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op1_near_dedup": f"""
WITH RECURSIVE w AS (
    SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), {_AZ})")} AS ws FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
    SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.doc_id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)""",
    "op2_mixing": f"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size, md5('mix-1:' || doc_id) AS h FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT source, n, CASE (r - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * n AS cap FROM s),
o AS (SELECT *, 1.5::DOUBLE * sum(n) OVER () AS total, sum(w) OVER () AS all_w,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
    coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM w),
k AS (SELECT source, n, w, cap, total, (total - c) * w > cap * (all_w - u) AS clamped FROM o),
t AS (SELECT source, n, CASE WHEN clamped THEN cap ELSE w * (total - coalesce(sum(CASE WHEN clamped THEN cap END) OVER (), 0)) / coalesce(sum(CASE WHEN NOT clamped THEN w END) OVER (), 1) END AS target FROM k),
x AS (SELECT source, n, target, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM t),
y AS (SELECT d.*, n, target, whole, target - whole * n AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id) AS upto FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source),
z AS (SELECT *, rest > 0 AND upto <= rest AS once, rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM y),
f AS (SELECT source, min(struct_pack(m := abs(size - gap), h := h, i := doc_id)) AS f FROM z WHERE NOT once AND size > 0 AND abs(size - gap) < gap GROUP BY source)
SELECT doc_id, size, n::BIGINT AS source_size, target,
    (size * (whole + CASE WHEN once OR coalesce(f.f.i = doc_id, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM z LEFT JOIN f ON z.source IS NOT DISTINCT FROM f.source""",
    "op4_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
    CASE WHEN n >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d""",
}

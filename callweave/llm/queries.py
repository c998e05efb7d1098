"""The corpus operators over the driver's tables: one thin query each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import bpe, linear_bpe, matroska, merkle, minhash, mixing, quality_mil, quality_rules, sharding, token_counts, url_filter, warc, whitening
from callweave.llm.common import read
from callweave.sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = [f"shard-{i:03d}" for i in range(64)]
#: Target weights of the sources: the first may hold a third of the rows and shall make up a tenth.
WEIGHTS = {"src0": 10.0} | {f"src{i}": 4.5 for i in range(1, 20)} | {mixing.OTHERS: 4.5}
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Hosts that are blocked, with their subdomains, where no rule fits: advertisers' names, bare and numbered, under three domains.
SPAM_NAMES, SPAM_NUMBERS, DOMAINS = ["spam-farm", "casino-win", "cheap-pills", "free-bets"], 1000, ["example.com", "example.net", "example.org"]


def blocked_hosts(spark: SparkSession) -> DataFrame:
    numbers = spark.range(SPAM_NUMBERS + 1).select(F.when(F.col("id") > 0, F.concat(F.lit("-"), "id")).otherwise("").alias("number"))
    named = numbers.select("number", F.explode(F.array(*map(F.lit, SPAM_NAMES))).alias("name"))
    placed = named.select("number", "name", F.explode(F.array(*map(F.lit, DOMAINS))).alias("domain"))
    return placed.select(F.concat("name", "number", F.lit("."), "domain").alias("key"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts of all documents, for operators that spend their time in tasks."""
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_table_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"), "doc_id", SHARDS).select("doc_id", "slot", "shard_no", "shard")


def op1_sql() -> str:
    """The filled table as one literal; a key's slot is a part of its digest, modulo the table's size."""
    table = sharding.lookup_table(SHARDS)
    return f"""
WITH filled AS (SELECT string_split('{",".join(map(str, table))}', ',') AS claimed),
placed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {len(table)} AS slot FROM documents)
SELECT doc_id, slot, claimed[slot + 1]::INTEGER AS shard_no, 'shard-' || lpad(claimed[slot + 1], 3, '0') AS shard FROM placed, filled
"""


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(texts(spark, sf_dir), BYTE_BPE, public_tokenizers.PATTERN)


def op3_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read(spark, sf_dir, "pages"))


OP3_SQL = """
WITH coded AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM coded)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN response END AS refers_to
FROM ranked
"""


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), WEIGHTS)


OP4_SQL = f"""
WITH RECURSIVE weights(source, weight) AS (VALUES {", ".join(f"('{s}', {w}::DOUBLE)" for s, w in WEIGHTS.items())}),
sizes AS (SELECT CASE WHEN source IN (SELECT source FROM weights WHERE source <> '{mixing.OTHERS}') THEN source ELSE '{mixing.OTHERS}' END AS source, count(*) AS n FROM documents GROUP BY 1),
named AS (SELECT source, weight, n FROM sizes JOIN weights USING (source)),
means AS (SELECT source, (SELECT sum(n) FROM named) * weight / (SELECT sum(weight) FROM named) / n AS mean FROM named),
steps(source, mean, k, term, total) AS (
  SELECT source, mean, 0, exp(-mean), exp(-mean) FROM means
  UNION ALL
  SELECT source, mean, k + 1, term * (mean / (k + 1)), total + term * (mean / (k + 1)) FROM steps WHERE k < 60 + 2 * mean),
listed AS (SELECT source, list(total) AS totals FROM steps GROUP BY source),
drawn AS (
  SELECT d.*, ('0x' || substr(md5(concat_ws('/', 'mix-1', coalesce(d.source, ''), coalesce(d.doc_id::VARCHAR, ''))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d),
counted AS (SELECT drawn.*, len(list_filter(totals, lambda x: x <= u)) AS times FROM drawn JOIN listed ON listed.source = CASE WHEN drawn.source IN (SELECT source FROM weights WHERE source <> '{mixing.OTHERS}') THEN drawn.source ELSE '{mixing.OTHERS}' END)
SELECT doc_id, text, lang, source, n_chars, copy_no::INTEGER AS copy_no,
  md5(concat_ws('/', 'mix-1/order', coalesce(doc_id::VARCHAR, ''), copy_no::VARCHAR)) AS mix_key
FROM (SELECT *, unnest(range(1, times + 1)) AS copy_no FROM counted WHERE times > 0)
"""


def op5_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.quality_scores(texts(spark, sf_dir), read(spark, sf_dir, "labels"))


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(texts(spark, sf_dir))


def op8_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = blocked_hosts(spark).select(F.lit(url_filter.HOSTS).alias("list"), "key")
    lists = spark.createDataFrame(RULES, "list string, key string").unionByName(hosts)
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), lists)


OP8_SQL = f"""
WITH rules(action, host_rule, path_rule) AS (VALUES {", ".join(f"('{a}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for a, r in RULES)}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT page_id, max_by(host_rule || path_rule, length(host_rule) * 1000000 + length(path_rule)) AS rule, max_by(action, length(host_rule) * 1000000 + length(path_rule)) AS action
  FROM parts JOIN rules ON (host = host_rule OR ends_with(host, '.' || host_rule)) AND starts_with(path, path_rule) GROUP BY page_id),
blocked AS (SELECT name || CASE WHEN number > 0 THEN '-' || number ELSE '' END || '.' || domain AS key
  FROM (SELECT unnest({SPAM_NAMES}) AS name), range({SPAM_NUMBERS + 1}) t(number), (SELECT unnest({DOMAINS}) AS domain)),
suffixes AS (SELECT page_id, array_to_string(list_slice(labels, k, len(labels)), '.') AS key FROM (SELECT page_id, string_split(host, '.') AS labels FROM parts), range(1, 20) t(k) WHERE k <= len(labels)),
bad AS (SELECT DISTINCT page_id FROM suffixes SEMI JOIN blocked USING (key))
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN action WHEN bad.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM parts LEFT JOIN fits USING (page_id) LEFT JOIN bad USING (page_id)
"""


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_features(texts(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op11_chan_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.manifest(read(spark, sf_dir, "documents"), tampered={"n_chars": F.when(hit, F.col("n_chars") + 1)})
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")


def op13_linear_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear_bpe.round_trip(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def queries() -> dict[str, Query]:
    return {
        "op1_table_sharding": op1_table_sharding,
        "op2_bpe_round_trip": op2_bpe_round_trip,
        "op3_warc_records": op3_warc_records,
        "op4_poisson_mixing": op4_poisson_mixing,
        "op5_quality_attention": op5_quality_attention,
        "op6_lsh_forest": op6_lsh_forest,
        "op7_quality_rules": op7_quality_rules,
        "op8_url_cascade": op8_url_cascade,
        "op9_matroska": op9_matroska,
        "op10_token_counts": op10_token_counts,
        "op11_chan_whitening": op11_chan_whitening,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_linear_bpe": op13_linear_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_table_sharding": op1_sql(), "op3_warc_records": OP3_SQL, "op4_poisson_mixing": OP4_SQL, "op8_url_cascade": OP8_SQL}

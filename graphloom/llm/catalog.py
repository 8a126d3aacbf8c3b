"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, decontam, langid, packing, pii, repeats, secrets, sharding, simhash, subtrees, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from two thirds of them; null texts and texts without letters are ``und``."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; null, empty and blank texts have fingerprint zero."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all test items; null and wordless texts hold nothing."""
    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "question_overlap", "answer_overlap")


#: The pairs that pass the overlap check, by joins of all word shingles: what retrieval must not lose.
SQL_DECONTAMINATION = r"""
WITH split AS (
  SELECT item_id, text,
         regexp_extract_all(lower(CASE WHEN regexp_matches(text, '(?s)^.*[.?!]\s+\S.*$') THEN regexp_extract(text, '(?s)^(.*[.?!])\s+(\S.*)$', 1) ELSE text END), '[\p{L}\p{N}]+') AS q,
         regexp_extract_all(lower(CASE WHEN regexp_matches(text, '(?s)^.*[.?!]\s+\S.*$') THEN regexp_extract(text, '(?s)^(.*[.?!])\s+(\S.*)$', 2) ELSE '' END), '[\p{L}\p{N}]+') AS a
  FROM benchmark),
items AS (
  SELECT item_id, CASE WHEN len(q) > 0 THEN q ELSE a END AS q, CASE WHEN len(q) > 0 THEN a ELSE [] END AS a,
         greatest(32, CAST(pow(2, ceil(log2(len(q) + len(a)))) AS BIGINT)) AS stride
  FROM split WHERE len(q) + len(a) > 0),
item_shingles AS (
  SELECT DISTINCT item_id, stride, least(5, len(q)) AS n, array_to_string(q[k:k + least(5, len(q)) - 1], ' ') AS s
  FROM items, LATERAL (SELECT unnest(range(1, len(q) - least(5, len(q)) + 2)) AS k)),
item_answers AS (SELECT DISTINCT item_id, stride, unnest(a) AS s FROM items),
item_sizes AS (
  SELECT items.item_id, (SELECT count(*) FROM item_shingles x WHERE x.item_id = items.item_id) AS n_q, len(list_distinct(a)) AS n_a FROM items),
doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM doc_words),
hits AS (
  SELECT doc_id, item_id, s, p // stride AS k, k > 0 AND p + i.n <= (p // stride + 1) * stride AS also
  FROM (SELECT doc_id, n, p, array_to_string(w[p + 1:p + n], ' ') AS s FROM places, (SELECT DISTINCT n FROM item_shingles) WHERE p + n <= len(w)) d
  JOIN item_shingles i USING (n, s)),
questions AS (
  SELECT doc_id, item_id, k, count(DISTINCT s) AS got
  FROM (SELECT doc_id, item_id, s, k FROM hits UNION ALL SELECT doc_id, item_id, s, k - 1 FROM hits WHERE also) GROUP BY ALL),
asked AS (SELECT doc_id, item_id, k, got / n_q AS question_overlap, n_a FROM questions JOIN item_sizes USING (item_id) WHERE got / n_q >= 0.8),
answers AS (
  SELECT c.doc_id, c.item_id, c.k, count(DISTINCT i.s) AS got
  FROM asked c JOIN item_answers i ON i.item_id = c.item_id JOIN places d ON d.doc_id = c.doc_id AND d.w[d.p + 1] = i.s
  WHERE d.p >= c.k * i.stride AND d.p < (c.k + 2) * i.stride GROUP BY ALL),
pairs AS (
  SELECT doc_id, item_id, question_overlap, CASE WHEN n_a = 0 THEN 1.0 ELSE coalesce(got, 0) / n_a END AS answer_overlap
  FROM asked LEFT JOIN answers USING (doc_id, item_id, k))
SELECT doc_id, item_id, question_overlap, answer_overlap FROM pairs WHERE answer_overlap >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY question_overlap DESC, answer_overlap DESC) = 1
"""


def tokenizer_path() -> str:
    """The public byte-level vocabulary that the packing contract names."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op4_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens; a null or empty text is one end token."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five neighbours of each vector whose id is divisible by 50; null, zero and non-finite vectors take no part."""
    return ann.neighbours(_table(spark, sf_dir, "embeddings"))


def _draw(key: Column, salt: str, n: int) -> Column:
    """A number below ``n`` from a hash that other engines have as well."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt)).cast("binary")), 1, 8), 16, 10).cast("long") % n


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no lists and no fetch dates: both are drawn from hashes of hosts and page ids."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), _draw(F.col("page_id"), "f", 366).cast("int")))
    hosts = pages.select(F.explode(urls.suffixes(urls.host(F.col("url")))).alias("pattern")).distinct().where(F.contains("pattern", F.lit(".")) & (_draw(F.col("pattern"), "p", 4) == 0))
    listed = hosts.select("pattern", F.explode(F.expr("sequence(0, 2)")).alias("k"))
    salt = F.col("k").cast("string")
    events = listed.select(
        "pattern",
        F.when(_draw(F.concat("pattern", salt), "c", 3) == 0, "adult").otherwise("spam").alias("category"),
        F.date_add(F.lit("2023-10-01").cast("date"), _draw(F.concat("pattern", salt), "d", 400).cast("int")).alias("day"),
        F.when(_draw(F.concat("pattern", salt), "a", 3) == 0, "remove").otherwise("add").alias("action"),
    )
    return urls.evaluate(captures, events)


SQL_URL_FILTER = r"""
WITH draw AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '\.$', ''), '') AS host,
         DATE '2024-01-01' + CAST(('0x' || md5(CAST(page_id AS VARCHAR) || 'f')[1:8])::BIGINT % 366 AS INTEGER) AS fetched
  FROM pages),
captures AS (SELECT page_id, CASE WHEN length(host) <= 253 THEN host END AS host, fetched FROM draw),
keyed AS (
  SELECT page_id, fetched, k AS depth, array_to_string(string_split(host, '.')[k + 1:], '.') AS pattern
  FROM captures, LATERAL (SELECT unnest(range(0, len(string_split(host, '.')))) AS k)),
listed AS (SELECT pattern, k, pattern || k AS s FROM (SELECT DISTINCT pattern FROM keyed WHERE contains(pattern, '.') AND ('0x' || md5(pattern || 'p')[1:8])::BIGINT % 4 = 0), range(3) t(k)),
events AS (
  SELECT DISTINCT pattern, CASE WHEN ('0x' || md5(s || 'c')[1:8])::BIGINT % 3 = 0 THEN 'adult' ELSE 'spam' END AS category,
         DATE '2023-10-01' + CAST(('0x' || md5(s || 'd')[1:8])::BIGINT % 400 AS INTEGER) AS day,
         CASE WHEN ('0x' || md5(s || 'a')[1:8])::BIGINT % 3 = 0 THEN 'remove' ELSE 'add' END AS action
  FROM listed),
spans AS (SELECT *, lead(day) OVER (PARTITION BY pattern, category ORDER BY day, action) AS until FROM events),
hits AS (
  SELECT k.page_id, k.depth, s.category, s.day AS since, s.pattern FROM keyed k JOIN spans s USING (pattern)
  WHERE action = 'add' AND (until IS NULL OR until > day) AND day <= fetched AND (until IS NULL OR fetched < until)
  QUALIFY row_number() OVER (PARTITION BY k.page_id ORDER BY depth, category, day, pattern) = 1)
SELECT page_id, host, fetched, hits.page_id IS NOT NULL AS blocked, hits.pattern, hits.category, hits.since
FROM captures LEFT JOIN hits USING (page_id)
"""


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; a null text is an empty one; repeated rows are scanned each."""
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 256 shards by their id; equal ids, null ones too, share a shard."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.place(docs, "doc_id", [f"shard-{k:03d}" for k in range(256)])


def op9_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 400 bytes in all documents, and passages of over 50 words; a null text is an empty one."""
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; a null text is an empty one; repeated rows are scanned each."""
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two public tokenizers in all documents; null, empty and changed texts have no tokens."""
    import public_tokenizers

    return alignment.align(_table(spark, sf_dir, "documents"), tokenizer_path(), str(public_tokenizers.path("piece_bpe_32k.model")))


def op12_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 35 words in all documents; a null text has no words."""
    return subtrees.remove_repeats(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_bestfit_packing": op4_bestfit_packing,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_url_filter": op6_url_filter,
    "op7_secret_scan": op7_secret_scan,
    "op8_sharding": op8_sharding,
    "op9_repeat_removal": op9_repeat_removal,
    "op10_pii": op10_pii,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_word_repeats": op12_word_repeats,
}
ORACLES: dict[str, str] = {
    "op3_benchmark_decontamination": SQL_DECONTAMINATION,
    "op6_url_filter": SQL_URL_FILTER,
}

"""One query for each corpus operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, near_dedup, packing, pii, quality, token_counts, topk_search, toxicity, url_filter
from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST)
"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _vocabulary("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), path, _pattern())


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, _vocabulary("word_bpe_49k.json"), 2048), docs.count(), 2048)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), _pattern(), 50256)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def dated_list(pages: DataFrame) -> DataFrame:
    """The dated list of op9, by a rule over the URLs of `pages` and a number that each host's MD5 gives it: a host whose number is
    divisible by 3 is listed from a day on, delisted 60 days later, and, if the number is even, listed again 90 days after that; hosts
    naming pills or casinos are listed throughout. Of hosts whose number leaves 1 modulo 4, the first path segments are listed from
    a day on; where it leaves 3, the first two are, for 120 days."""
    number = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int")
    named = pages.select(url_filter.host_of(F.col("url")).alias("host"), url_filter.segments_of(F.col("url")).alias("s")).where("host <> ''").withColumn("c", number)
    host = named.select(F.col("host").alias("pattern"), "c").distinct()
    path = lambda n, left: named.where((F.col("c") % 4 == left) & (F.size("s") >= n)).select(F.concat_ws("/", "host", F.array_join(F.slice("s", 1, n), "/")).alias("pattern"), "c").distinct()
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    start, third = F.col("c") % 200, F.col("c") % 3 == 0
    entry = lambda rows, name, event, at: rows.select("pattern", F.lit(name).alias("list"), F.lit(event).alias("event"), at.alias("at"))
    return (
        entry(host.where(third), "reported", "add", day(start))
        .unionByName(entry(host.where(third), "reported", "remove", day(start + 60)))
        .unionByName(entry(host.where(third & (F.col("c") % 2 == 0)), "reported", "add", day(start + 150)))
        .unionByName(entry(host.where(F.col("pattern").rlike("pills|casino")), "spam", "add", day(F.lit(0))))
        .unionByName(entry(path(1, 1), "paths", "add", day(F.col("c") % 150)))
        .unionByName(entry(path(2, 3), "paths", "add", day(F.col("c") % 100)))
        .unionByName(entry(path(2, 3), "paths", "remove", day(F.col("c") % 100 + 120)))
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as fetched on a day that its id gives it."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")).alias("fetched_at"))
    return url_filter.filter_urls(captures, dated_list(pages))


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched_at,
         lower(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')) AS host,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda s: s <> '') AS s
  FROM pages
), h AS (
  SELECT DISTINCT host AS pattern, CAST('0x' || substr(md5(host), 1, 6) AS INTEGER) AS c FROM p WHERE host <> ''
), e AS (
  SELECT pattern, 'reported' AS list, DATE '2024-01-01' + c % 200 AS a, DATE '2024-01-01' + (c % 200 + 60) AS z FROM h WHERE c % 3 = 0
  UNION ALL SELECT pattern, 'reported', DATE '2024-01-01' + (c % 200 + 150), NULL FROM h WHERE c % 6 = 0
  UNION ALL SELECT pattern, 'spam', DATE '2024-01-01', NULL FROM h WHERE regexp_matches(pattern, 'pills|casino')
  UNION SELECT lower(host || '/' || s[1]), 'paths', DATE '2024-01-01' + c % 150, NULL FROM p JOIN h ON host = pattern WHERE c % 4 = 1 AND len(s) >= 1
  UNION SELECT lower(host || '/' || s[1] || '/' || s[2]), 'paths', DATE '2024-01-01' + c % 100, DATE '2024-01-01' + (c % 100 + 120) FROM p JOIN h ON host = pattern WHERE c % 4 = 3 AND len(s) >= 2
), m AS (
  SELECT url, fetched_at, count(*) AS n, min(list) AS first_list
  FROM (SELECT DISTINCT url, fetched_at, host, s FROM p) JOIN e ON (host = pattern OR ends_with(host, '.' || pattern) OR lower(host || '/' || s[1]) = pattern OR lower(host || '/' || s[1] || '/' || s[2]) = pattern)
    AND a <= fetched_at AND (z IS NULL OR fetched_at < z)
  GROUP BY ALL
)
SELECT page_id, p.url, p.fetched_at, host, coalesce(n, 0) AS n_matches, first_list, n IS NOT NULL AS blocked
FROM p LEFT JOIN m ON p.url = m.url AND p.fetched_at = m.fetched_at
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality, op2_exact_dedup, op3_pii, op4_topk, op5_byte_bpe, op6_packing, op7_token_counts, op8_near_dedup, op9_url_filter, op10_toxicity, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op4_topk": OP4_SQL, "op9_url_filter": OP9_SQL}

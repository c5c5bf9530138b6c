"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where the installed vocabularies keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import dedup_report

    return dedup_report(table(spark, sf_dir, "documents"))


@query(r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
e AS (SELECT *, 1000 + least(size, 1000) AS weight_ FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * weight_) AS DOUBLE) AS weighted, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM e GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(turn - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, cap / weight <= level AS full_ FROM l),
m AS (SELECT *, (SELECT min_by(level, cap / weight) FROM f WHERE NOT full_) AS shared FROM f),
t AS (SELECT source, source_size, weighted, CASE WHEN full_ THEN cap ELSE weight * shared END AS target FROM m),
r AS (SELECT *, CASE WHEN weighted > 0 THEN target / weighted ELSE 0 END AS ratio FROM t),
x AS (SELECT d.doc_id, d.size, d.source, r.source_size, r.target, r.ratio, floor(least(r.ratio * d.weight_, 2)) AS base, least(r.ratio * d.weight_, 2) - floor(least(r.ratio * d.weight_, 2)) AS p,
    (CAST(CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
    FROM e d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) ELSE CAST('inf' AS DOUBLE) END AS rank_, target - sum(base * size) OVER (PARTITION BY source) AS quota FROM x),
c AS (SELECT *, base < 2 AND sum(size) OVER (PARTITION BY source ORDER BY rank_, doc_id) <= quota AS in_ FROM q),
g AS (SELECT source, max(quota) - coalesce(sum(size) FILTER (WHERE in_), 0) AS gap FROM c GROUP BY source),
o AS (SELECT c.source, arg_min(c.doc_id, (abs(c.size - g.gap), c.rank_, c.doc_id)) AS more_id FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source
    WHERE NOT c.in_ AND c.base < 2 AND c.size > 0 AND c.size < 2 * g.gap GROUP BY c.source)
SELECT c.doc_id, c.size, c.source_size, c.target,
    CAST((c.base + CASE WHEN c.in_ OR c.doc_id = o.more_id THEN 1 ELSE 0 END) * c.size AS BIGINT) AS taken
FROM c LEFT JOIN o ON c.source IS NOT DISTINCT FROM o.source
""")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import Mix, length_weight

    return Mix(table(spark, sf_dir, "documents"), weight=length_weight(F.col("text"))).report()


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import report

    return report(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import CONTRACT_RULES, judge

    pages = table(spark, sf_dir, "pages")
    return judge(pages, CONTRACT_RULES).select("page_id", "host", "path", "rule", "verdict")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def _register() -> None:
    from . import divergence, prefix_trie, secrets, urlfilter

    query(secrets.oracle_sql())(op6_secret_scan)
    query(urlfilter.oracle_sql())(op10_url_filter)
    query(divergence.oracle_sql())(op12_divergence)
    query(prefix_trie.oracle_sql())(op13_prefix_trie)


_register()


@query()
def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_report, stored

    return media_report(stored(table(spark, sf_dir, "documents")))


@query()
def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simple8b import encode_report

    return encode_report(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_dedup_report

    return near_dedup_report(table(spark, sf_dir, "documents"))


@query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_report

    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_trie import report

    return report(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query()
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import report

    return report(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

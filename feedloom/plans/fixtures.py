"""The driver tables seen as the store's tables, in Spark and, for the oracle, in SQL.

Every row of a driver table is a row here; no text is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ARTICLES = """
SELECT CAST(d.doc_id AS {string}) AS id, split_part(d.text, chr(10), 1) AS title,
  'https://arxiv.org/abs/2401.' || lpad(CAST(d.doc_id AS {string}), 5, '0') AS link,
  CASE WHEN strpos(d.text, chr(10)) > 0 THEN substring(d.text, strpos(d.text, chr(10)) + 1) END AS abstract,
  d.source AS author, d.lang AS category, CAST(NULL AS {string}) AS comment,
  CAST(CASE WHEN l.toxic = 1 THEN -1 WHEN l.quality = 0 THEN 3 WHEN l.quality = 1 AND d.n_chars > 4000 THEN 2
    WHEN d.n_chars < 500 THEN 1 ELSE 0 END AS INT) AS status,
  CAST(coalesce(l.quality, 0) - coalesce(l.toxic, 0) AS DOUBLE) AS score,
  CAST(CASE WHEN d.lang = 'fr' THEN l.quality END AS INT) AS hf_upvotes,
  CAST(CASE WHEN d.lang = 'de' THEN l.toxic END AS INT) AS ax_net_votes,
  CASE WHEN d.lang = 'fr' THEN TIMESTAMP '2024-03-01 00:00:00' END AS votes_updated_at,
  CASE WHEN d.n_chars < 300 AND d.lang = 'en' THEN TIMESTAMP '2024-03-02 08:00:00' END AS pushed_at,
  CASE WHEN d.n_chars < 900 THEN DATE '2024-02-01' + CAST(substring(d.source, 4) AS INT) END AS recommend_date,
  CAST(CASE WHEN d.n_chars < 900 THEN d.n_chars END AS INT) AS batch_order,
  CAST(CASE WHEN d.n_chars < 900 THEN 'score' END AS {string}) AS recommendation_type,
  CASE WHEN d.lang <> 'en' THEN upper(d.source) WHEN d.n_chars < 400 THEN '' END AS translated_title,
  CAST(NULL AS {string}) AS translated_abstract,
  TIMESTAMP '2024-01-01 00:00:00' + {seconds} AS created_at
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

MESSAGES = """
SELECT conv_id AS paper, turn AS seq, CAST(turn {div} 2 AS INT) AS round, role, text AS content,
  {bytes} {div} 4 AS token_count, char_length(text) AS prompt_tokens, length(role) AS completion_tokens,
  CAST(0 AS BIGINT) AS cached_tokens, char_length(text) < 60 AS skip_context
FROM conversations
"""

CHAT_PAPERS = """
SELECT 's' || CAST(page_id AS {string}) AS id, CAST(page_id AS {string}) AS arxiv_id, url AS title,
  CAST(length(url) {div} 4 AS INT) AS rating, url AS source_url, '' AS github_url,
  '2024-01-' || lpad(CAST(1 + length(url) {div} 3 AS {string}), 2, '0') AS updated_at
FROM pages
"""

_SPARK = {"string": "STRING", "div": "div", "bytes": "octet_length(text)", "seconds": "make_dt_interval(0, 0, 0, d.n_chars)"}
_DUCK = {"string": "VARCHAR", "div": "//", "bytes": "strlen(text)", "seconds": "to_seconds(d.n_chars)"}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    sql = sql.format(**_SPARK).replace("strpos(", "charindex_(").replace("charindex_(d.text, chr(10))", "locate(chr(10), d.text)")
    for name in tables:
        sql = sql.replace(f" {name}\n", f" {{{name}}}\n").replace(f" {name} ", f" {{{name}}} ")
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in tables})


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ARTICLES, "documents", "labels")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, MESSAGES, "conversations")


def chat_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CHAT_PAPERS, "pages")


def with_articles(sql: str) -> str:
    return f"WITH articles AS ({ARTICLES.format(**_DUCK)}) {sql}"


def with_messages(sql: str) -> str:
    return f"WITH messages AS ({MESSAGES.format(**_DUCK)}) {sql}"


def with_papers(sql: str) -> str:
    return f"WITH papers AS ({CHAT_PAPERS.format(**_DUCK)}) {sql}"


def with_both(sql: str) -> str:
    return f"WITH articles AS ({ARTICLES.format(**_DUCK)}), papers AS ({CHAT_PAPERS.format(**_DUCK)}) {sql}"

"""Input tables of the registered queries, and corpora derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as a corpus: the host is the project."""
    return read(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("project"),
        F.concat(F.lit("p"), F.col("page_id"), F.lit(".html")).alias("path"),
        F.col("html").alias("content"),
    )


PAGES_SQL = r"""
pages_corpus AS (
  SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS project, 'p' || page_id || '.html' AS path,
         regexp_replace(html, '\r\n?', chr(10), 'g') AS content
  FROM pages)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a corpus: the source is the project, the language the run."""
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("run_"), F.col("lang")).alias("run_id"),
        F.col("source").alias("project"),
        F.concat(F.lit("d"), F.col("doc_id"), F.lit(".txt")).alias("path"),
        F.col("doc_id"),
        F.col("text").alias("content"),
    )


DOCUMENTS_SQL = """
docs AS (
  SELECT 'run_' || lang AS run_id, source AS project, 'd' || doc_id || '.txt' AS path, doc_id, text AS content
  FROM documents)"""


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def order_files(spark: SparkSession, sf_dir: str, content) -> DataFrame:
    """One template per order. ``content`` builds its text from key, total and status."""
    key, total = F.col("o_orderkey").cast("string"), F.floor("o_totalprice").cast("string")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("project"),
        _cat("src/app/o", key, ".component.html").alias("path"),
        content(key, total, F.col("o_orderstatus")).alias("content"),
    )


ORDERS_SQL = """
o AS (
  SELECT o_orderpriority AS project, 'src/app/o' || o_orderkey || '.component.html' AS path,
         o_orderkey::VARCHAR AS k, floor(o_totalprice)::BIGINT::VARCHAR AS t, o_orderstatus AS s
  FROM orders)"""


def part_files(spark: SparkSession, sf_dir: str, content) -> DataFrame:
    """One template per part. ``content`` builds its text from key, name and size."""
    return read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("project"),
        _cat("src/app/p", F.col("p_partkey").cast("string"), ".component.html").alias("path"),
        content(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_size").cast("string")).alias("content"),
    )


PARTS_SQL = """
p AS (
  SELECT p_brand AS project, 'src/app/p' || p_partkey || '.component.html' AS path,
         p_partkey::VARCHAR AS k, p_name AS n, p_size::VARCHAR AS z
  FROM part)"""

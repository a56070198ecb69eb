"""The driver's tables in the roles of a linkage job: records of two sides, scored pairs, truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import native


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(s1, pool): documents with and without a label; country is the language, state the source, missing for src0.

    The key stands for all sorted tokens of a text by their digest, so that joins move no texts.
    """
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id").distinct()
    d = docs.select("doc_id", F.col("doc_id").alias("id"), F.col("lang").alias("country"), F.coalesce(F.nullif("source", F.lit("src0")), F.lit("")).alias("state"), native.digest_key(native.plain_tokens(F.col("text"))).alias("n_key"))
    d = d.persist()  # a few narrow columns that several joins read, dear to make from whole texts
    return d.join(labels, "doc_id", "left_semi").drop("doc_id"), d.join(labels, "doc_id", "left_anti").drop("doc_id")


RECORDS_SQL = """
d AS (
  SELECT doc_id AS id, lang AS country, coalesce(nullif(source, 'src0'), '') AS state,
    CASE WHEN len(regexp_extract_all(lower(text), '[0-9a-z]+')) = 0 THEN '' ELSE md5(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[0-9a-z]+'))), ' ')) END AS n_key
  FROM documents
), s1 AS (SELECT * FROM d WHERE id IN (SELECT doc_id FROM labels)
), pool AS (SELECT * FROM d WHERE id NOT IN (SELECT doc_id FROM labels)
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1, cand, p, source: orders and parts, the likelihood from the quantity, source 2 or 3 from the line status."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("s1"), F.col("l_partkey").alias("cand")).agg(
        F.max((F.col("l_quantity") - 0.5) / 50).alias("p"), F.max(F.when(F.col("l_linestatus") == "O", 3).otherwise(2)).alias("source")
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1, cand: returned parts."""
    return read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("s1"), F.col("l_partkey").alias("cand")).distinct()


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1"), F.col("o_orderpriority").alias("country"))


PAIRS_SQL = """
pairs AS (
  SELECT l_orderkey AS s1, l_partkey AS cand, max((l_quantity - 0.5) / 50) AS p, max(CASE WHEN l_linestatus = 'O' THEN 3 ELSE 2 END) AS source
  FROM lineitem GROUP BY ALL
), truth AS (
  SELECT DISTINCT l_orderkey AS s1, l_partkey AS cand FROM lineitem WHERE l_returnflag = 'R'
), ids AS (
  SELECT o_orderkey AS s1, o_orderpriority AS country FROM orders
)"""

"""The provided tables in the roles of a code corpus: chunks, nodes, edges, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"R": "calls", "A": "data_flow", "N": "control_flow"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, file, language, code)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("file"), F.col("lang").alias("language"), F.col("text").alias("code")
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, file, is_entry_point, is_sink) from parts."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("file"),
        (F.col("p_size") == 50).alias("is_entry_point"),
        (F.col("p_size") == 1).alias("is_sink"),
    )


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmerged edges from line items; the number of nodes is one literal."""
    n = table(spark, sf_dir, "part").count()
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_partkey").alias("src"),
            (F.col("l_orderkey") % n).alias("dst"),
            kind[F.col("l_returnflag")].alias("type"),
            F.array(F.col("l_linestatus")).alias("data_vars"),
            F.concat(F.lit("month "), F.month("l_shipdate").cast("string")).alias("condition"),
            (F.col("l_discount") >= 0.05).alias("sanitized"),
        )
        .filter("src != dst")
    )


#: The same roles for the oracle.
SQL = """
nodes AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS file, p_size = 50 AS is_entry_point, p_size = 1 AS is_sink FROM part),
raw_edges AS (
  SELECT * FROM (
    SELECT l_partkey AS src, l_orderkey % (SELECT count(*) FROM part) AS dst,
           CASE l_returnflag WHEN 'R' THEN 'calls' WHEN 'A' THEN 'data_flow' ELSE 'control_flow' END AS type,
           l_linestatus AS var, 'month ' || month(l_shipdate) AS condition, l_discount >= 0.05 AS sanitized
    FROM lineitem) WHERE src <> dst),
edges AS (SELECT DISTINCT src, dst, type FROM raw_edges),
chunks AS (SELECT doc_id AS id, source AS file, lang AS language, text AS code FROM documents)"""

"""Abundance views over the star-schema parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as samples, brands as taxa, ordered quantity as count."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(orders, line.l_orderkey == orders.o_orderkey)
        .groupBy(F.col("o_custkey").alias("sampleID"), F.col("p_brand").alias("taxon"))
        .agg(F.sum("l_quantity").alias("count"))
    )


def sample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their market segment as class."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("sampleID"), F.col("c_mktsegment").alias("HC_subCST")
    )


def sample_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their region as study cohort."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("sampleID"), F.col("n_regionkey").alias("cohort")
    )


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as samples, event types as taxa."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("sampleID"), F.col("event_type").alias("taxon"))
        .agg(F.count(F.lit(1)).cast("double").alias("count"))
    )


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors with a class, as double arrays."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sampleID"),
        F.col("label").cast("string").alias("HC_subCST"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def binary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labellings of the same documents as truth and prediction."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("sampleID"),
        F.col("quality").cast("string").alias("HC_subCST"),
        F.col("toxic").cast("string").alias("subCST"),
    )

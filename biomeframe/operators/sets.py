"""Shared taxa, stacked cohorts, label universes and schema differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biomeframe.functions.names import norm_taxon

# Fixed names that are never taxa.
NOT_TAXA = ("sampleid", "read_count")


def tag_cohort(df: DataFrame, name: str, column: str = "dataset") -> DataFrame:
    """Add a constant cohort column."""
    return df.withColumn(column, F.lit(name))


def shared_taxa(df: DataFrame, cohort: str, n_cohorts: int | None = None) -> DataFrame:
    """Normalised taxa that occur in every cohort of one stacked table."""
    pairs = df.select(F.col(cohort).alias("c"), norm_taxon("taxon").alias("taxon")).distinct()
    need = F.lit(n_cohorts) if n_cohorts else pairs.agg(F.count_distinct("c")).scalar()
    return (
        pairs.filter(~F.col("taxon").isin(*NOT_TAXA))
        .groupBy("taxon")
        .agg(F.count("c").alias("k"))
        .filter(F.col("k") == need)
        .select("taxon")
        .orderBy("taxon")
    )


def common_taxa(*dfs: DataFrame) -> DataFrame:
    """Normalised taxa shared by all given cohorts, sorted."""
    tagged = [tag_cohort(d.select("taxon"), str(i), "c") for i, d in enumerate(dfs)]
    return shared_taxa(reduce(DataFrame.unionByName, tagged), "c", len(dfs))


def stack(*dfs: DataFrame) -> DataFrame:
    """Rows of all cohorts; a column a cohort lacks becomes null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def label_universe(a: DataFrame, b: DataFrame, label: str = "HC_subCST") -> DataFrame:
    """All labels of both tables; ``in_both`` is false where the sets differ."""
    left = a.select(label).distinct().withColumn("s", F.lit(1))
    right = b.select(label).distinct().withColumn("s", F.lit(2))
    return (
        left.unionByName(right)
        .filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg((F.sum("s") == 3).alias("in_both"))
        .orderBy(label)
    )


def schema_diff(a: DataFrame, b: DataFrame, samples_a=None, samples_b=None, label: str = "HC_subCST") -> DataFrame:
    """Taxa and labels found on one side only: ``kind``, ``name``, ``side``."""

    def names(df: DataFrame, column: str, kind: str, side: int) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("name")).distinct(
        ).withColumn("s", F.lit(side))

    parts = [names(a, "taxon", "taxon", 1), names(b, "taxon", "taxon", 2)]
    if samples_a is not None and samples_b is not None:
        parts += [names(samples_a, label, "label", 1), names(samples_b, label, "label", 2)]
    sides = reduce(DataFrame.unionByName, parts).groupBy("kind", "name").agg(F.sum("s").alias("s"))
    return sides.filter(F.col("s") != 3).select(
        "kind", "name", F.when(F.col("s") == 1, "first").otherwise("second").alias("side")
    )

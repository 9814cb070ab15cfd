"""Class and taxon aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biomeframe.functions.scores import ratio
from biomeframe.operators.keyed import attach, group_median
from biomeframe.operators.normalize import taxon_moments
from biomeframe.session import listed


def class_prevalence(samples: DataFrame, label: str = "HC_subCST", by: list[str] | None = None) -> DataFrame:
    """Samples with an id per class and their share, optionally within ``by`` groups."""
    by = by or []
    counted = samples.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(
        F.count("sampleID").alias("n")
    )
    # One row per class: the window sees the aggregate, not the samples.
    total = F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])))
    return counted.withColumn("prevalence", ratio(F.col("n"), total))


def class_weights(
    samples: DataFrame, labels: list[str] | None = None, label: str = "HC_subCST"
) -> DataFrame:
    """Inverse prevalence, 1 for the largest class; a listed but absent class gets 0."""
    counted = class_prevalence(samples, label).select(label, "n")
    if labels is not None:
        names = listed(samples.sparkSession, **{label: list(labels)})
        counted = names.join(counted, label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    largest = F.max("n").over(Window.partitionBy(F.lit(0)))
    weight = F.when(F.col("n") > 0, largest / F.col("n")).otherwise(F.lit(0.0))
    return counted.withColumn("weight", weight)


def with_label(df: DataFrame, samples: DataFrame, label: str = "HC_subCST") -> DataFrame:
    """Add each sample's class to its long rows."""
    return df.join(samples.select("sampleID", label), "sampleID")


def centroids(
    df: DataFrame, samples: DataFrame, method: str = "mean", label: str = "HC_subCST"
) -> DataFrame:
    """Mean or median share per class and taxon over all samples of the class.

    Sparse: a (class, taxon) pair without any count has no row and means 0.
    """
    sizes = samples.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("sampleID").alias("n"))
    labelled = with_label(df, samples, label)
    if method == "mean":
        sums = labelled.groupBy(label, "taxon").agg(F.sum("value").alias("s"))
        return attach(sums, sizes, label).select(label, "taxon", (F.col("s") / F.col("n")).alias("value"))
    if method == "median":
        return group_median(labelled, [label, "taxon"], "value", sizes, [label])
    raise ValueError(f"unknown centroid method {method!r}")


def labels(samples: DataFrame, label: str = "HC_subCST") -> DataFrame:
    """Sorted distinct classes."""
    return samples.select(label).filter(F.col(label).isNotNull()).distinct().orderBy(label)


def taxon_summary(df: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Mean, prevalence and maximum per taxon over all samples."""
    return taxon_moments(df, samples).select("taxon", "mean", "prevalence", "max")


def nonempty_taxa(df: DataFrame, value: str = "count") -> DataFrame:
    """Rows of taxa whose column sum is positive."""
    alive = df.groupBy("taxon").agg(F.sum(value).alias("s")).filter(F.col("s") > 0).select("taxon")
    return attach(df, alive, "taxon", "left_semi")


def read_counts(df: DataFrame) -> DataFrame:
    """Row totals, nulls skipped."""
    return df.groupBy("sampleID").agg(F.coalesce(F.sum("count"), F.lit(0.0)).alias("read_count"))


def profile(df: DataFrame, samples: DataFrame, label: str = "HC_subCST") -> DataFrame:
    """Number of samples, features and classes."""
    n_samples = samples.agg(F.count(F.lit(1))).scalar()
    n_classes = samples.select(label).filter(F.col(label).isNotNull()).distinct().agg(
        F.count(F.lit(1))
    ).scalar()
    return df.select("taxon").distinct().agg(F.count(F.lit(1)).alias("n_features")).select(
        n_samples.alias("n_samples"), "n_features", n_classes.alias("n_classes")
    )

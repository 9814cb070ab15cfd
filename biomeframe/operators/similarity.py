"""Nearest-centroid classification by Yue-Clayton similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biomeframe.functions.scores import argmax_label, ratio
from biomeframe.operators.keyed import attach
from biomeframe.session import listed, materialise


def names_on_driver(names: DataFrame) -> list[str]:
    """The distinct, sorted values of a one-column table, for constructors that need a list.

    One name per class or taxon: a dictionary, not data.
    """
    return sorted(r[0] for r in names.distinct().collect() if r[0] is not None)


def class_list(df: DataFrame, label: str = "HC_subCST") -> list[str]:
    """Sorted class names."""
    return names_on_driver(df.select(F.col(label).cast("string").alias(label)))


def classify_centroid(
    df: DataFrame, centroids: DataFrame, label: str = "HC_subCST", labels: list[str] | None = None
) -> DataFrame:
    """``scores`` (sorted label order) and the best label ``subCST`` per sample.

    Similarity is sum(ab) / (sum(a2) + sum(b2) - sum(ab)) over all taxa. Centroids are one array per taxon, in label
    order; rows meet it once, and a sample's rows are gathered once (at most one per taxon), so neither the
    rows nor the plan grow with the classes.
    """
    labels = class_list(centroids, label) if labels is None else labels
    names = listed(df.sparkSession, names=[list(labels)]).select("names").scalar()
    known = centroids.groupBy("taxon").agg(F.map_from_entries(F.collect_list(F.struct(label, "value"))).alias("_m"))
    in_order = F.transform("_n", lambda n: F.coalesce(F.try_element_at("_m", n), F.lit(0.0)))
    # Written, so that the planner knows its bytes and broadcasts a small one.
    weights = materialise(known.withColumn("_n", names).select("taxon", in_order.alias("_c")))
    squares = weights.select(F.posexplode("_c").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("v"))
    norms = squares.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"])).scalar()
    mine = attach(df.select("sampleID", "taxon", F.coalesce("value", F.lit(0.0)).alias("value")), weights, "taxon", "left")
    rows = mine.groupBy("sampleID").agg(F.collect_list(F.struct("value", "_c")).alias("_r"))
    zeros = F.transform("_n", lambda n: F.lit(0.0))
    product = lambda acc, e: F.zip_with(acc, e["_c"], lambda s, c: s + e["value"] * c)
    shared = F.filter("_r", lambda e: e["_c"].isNotNull())
    summed = rows.withColumns({"_n": names, "_bb": norms}).select(
        "sampleID",
        "_n",
        F.coalesce("_bb", zeros).alias("_bb"),
        F.aggregate("_r", F.lit(0.0), lambda acc, e: acc + e["value"] * e["value"]).alias("_aa"),
        F.aggregate(shared, zeros, product).alias("_ab"),
    )
    theta = F.zip_with("_ab", "_bb", lambda ab, bb: ratio(ab, F.col("_aa") + bb - ab))
    scored = summed.select("sampleID", "_n", theta.alias("scores"))
    return scored.select("sampleID", "scores", argmax_label("scores", F.col("_n")).alias("subCST"))


def score_columns(df: DataFrame, labels: list[str], template: str = "{}_sim") -> DataFrame:
    """One column per class from the ``scores`` array, such as ``III-A_sim`` or ``Pct III-A``."""
    named = {template.format(x): F.col("scores")[i] for i, x in enumerate(labels)}
    return df.withColumns(named).drop("scores")

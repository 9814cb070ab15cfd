"""Top-N, ordering and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biomeframe.functions.names import norm_taxon
from biomeframe.operators.keyed import attach

RANKINGS = {"mean": "mean", "prevalence": "prevalence", "max": "max"}


def top_of(stats: DataFrame, n: int, rank_by: str = "mean") -> DataFrame:
    """The ``n`` best rows of a taxon summary; ties in name order."""
    if rank_by not in RANKINGS:
        raise ValueError(f"unknown rank_by {rank_by!r}")
    # Rounded so that rows equal up to summation order stay ties.
    key = F.round(F.col(RANKINGS[rank_by]), 12).desc()
    return stats.orderBy(key, norm_taxon("taxon"), "taxon").limit(n)


def top_taxa(
    df: DataFrame, n: int = 20, rank_by: str = "mean", samples: DataFrame | None = None
) -> DataFrame:
    """The ``n`` taxa with the largest mean, prevalence or maximum."""
    from biomeframe.operators.aggregate import taxon_summary

    return top_of(taxon_summary(df, samples), n, rank_by)


def keep_top(df: DataFrame, n: int = 20, rank_by: str = "mean", samples: DataFrame | None = None) -> DataFrame:
    """Rows of the top ``n`` taxa."""
    return attach(df, top_taxa(df, n, rank_by, samples).select("taxon"), "taxon", "left_semi")


def order_by_effect(df: DataFrame, effect: str = "effect") -> DataFrame:
    """Features from the largest to the smallest absolute effect."""
    return df.orderBy(F.abs(F.col(effect)).desc(), "taxon")


def pick_best(results: DataFrame, score: str, position: str) -> DataFrame:
    """The row with the highest score; the first position wins ties."""
    return results.orderBy(F.col(score).desc(), F.col(position)).limit(1)


def sorted_by_id(df: DataFrame) -> DataFrame:
    return df.orderBy("sampleID")


def preview(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first ``n`` rows of an explicit order."""
    return df.orderBy(*order_by).limit(n)

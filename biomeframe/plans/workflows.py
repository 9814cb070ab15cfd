"""Workflows: evaluation, reduced models, label transfer, method comparison, class discovery."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biomeframe.operators.aggregate import centroids
from biomeframe.operators.cluster import cluster, cluster_rows
from biomeframe.operators.explain import perturbation, permutation_importance
from biomeframe.operators.learn import (
    Classifier,
    classify,
    fit,
    fit_best,
    fit_rows,
    fit_table,
    hidden_size,
    predict,
    training_scaling,
)
from biomeframe.operators.metrics import (
    accuracy,
    compare_methods,
    confusion,
    confusion_diff,
    rank_hits,
    weighted_metrics,
)
from biomeframe.operators.normalize import relative_abundance
from biomeframe.operators.sets import common_taxa
from biomeframe.operators.similarity import classify_centroid, names_on_driver
from biomeframe.operators.split import check_split, stratified_split
from biomeframe.session import materialise


def evaluate(model: Classifier, counts: DataFrame, samples: DataFrame, seed: int = 0) -> dict[str, DataFrame]:
    """Accuracy, confusion, weighted scores, guess ranks and per-class perturbation of a labelled table."""
    table = fit_table(counts, samples, model.taxa, model.labels, model.norm, model.regex_remove, model.scaling)[0]
    rows = materialise(table)
    scored = predict(model, rows)
    return {
        "accuracy": accuracy(scored),
        "confusion": confusion(scored),
        "weighted": weighted_metrics(scored),
        "rank_hits": rank_hits(scored, model.labels),
        "perturbation": perturbation(model, rows, by_class=True, seed=seed),
    }


def important_taxa(importance: DataFrame, threshold: float = 0.5, absolute: bool = False) -> list[str]:
    """Taxa whose accuracy drop reaches the threshold in percent points; if none does, those of the largest drop."""
    effect = F.abs("effect") if absolute else F.col("effect")
    # At most one row per feature of the model.
    effects = {r["taxon"]: r["e"] for r in importance.select("taxon", effect.alias("e")).collect() if r["e"] is not None}
    least = min(threshold, max(effects.values(), default=threshold))
    return sorted(t for t, e in effects.items() if e >= least)


def fit_focus(
    counts: DataFrame,
    train: DataFrame,
    taxa: list[str],
    test: tuple[DataFrame, DataFrame] | None = None,
    seeds: list[int] = (0,),
    norm: str = "none",
    kind: str = "mlp",
    **options: Any,
) -> Classifier:
    """Refit on named (normalised) taxa; several seeds need a held-out ``(counts, samples)`` to choose by."""
    taxa = sorted(taxa)
    scaling = training_scaling(counts, train, taxa, norm)
    rows, taxa, labels = fit_table(counts, train, taxa, norm=norm, scaling=scaling)
    if kind == "mlp":
        options.setdefault("hidden", hidden_size(len(taxa), len(labels), clamp=True))
    held = rows if test is None else fit_table(*test, taxa, labels, norm, scaling=scaling)[0]
    return fit_best(rows, held, taxa, labels, list(seeds), kind=kind, norm=norm, scaling=scaling, **options)[0]


def fit_simplified(
    model: Classifier,
    counts: DataFrame,
    train: DataFrame,
    test: tuple[DataFrame, DataFrame],
    threshold: float = 0.5,
    seed: int = 0,
    **options: Any,
) -> tuple[Classifier, DataFrame]:
    """Refit on the taxa whose permutation costs at least ``threshold`` percent points, or the most where none does.

    With many samples and features that stand in for one another no single taxon may reach the threshold.
    """
    held = fit_table(*test, model.taxa, model.labels, model.norm, model.regex_remove, model.scaling)[0]
    importance = materialise(permutation_importance(model, held, seed))
    taxa = important_taxa(importance, threshold)
    if not taxa:
        raise ValueError("no taxon has an importance")
    return fit_focus(counts, train, taxa, test, norm=model.norm, kind=model.kind, **options), importance


def transfer_labels(
    ref_counts: DataFrame,
    ref_samples: DataFrame,
    new_counts: DataFrame,
    train: float = 80,
    seed: int = 0,
    **options: Any,
) -> tuple[DataFrame, Classifier]:
    """Label a new cohort by a model on the shared taxa, split it, and fit its own model.

    The labels and the split are written, one row per sample: the split and the fit read them several times.
    """
    shared = names_on_driver(common_taxa(ref_counts, new_counts))
    focus = fit_focus(ref_counts, ref_samples, shared, **options)
    labelled = materialise(classify(focus, new_counts).select("sampleID", F.col("subCST").alias("HC_subCST")))
    splits = materialise(stratified_split(labelled, train, seed=seed))
    own = fit(new_counts, splits.filter(F.col("split") == "train"), **options)
    return splits, own


def bakeoff(
    counts: DataFrame, train: DataFrame, test: DataFrame, kinds: dict[str, dict[str, Any]]
) -> tuple[DataFrame, DataFrame]:
    """Score several classifiers and nearest centroid on one held-out set.

    Returns the metric panel and the confusion of the first classifier minus
    that of nearest centroid.
    """
    rows, taxa, labels = fit_table(counts, train)
    held = materialise(fit_table(counts, test, taxa, labels)[0])
    rows = materialise(rows)
    pairs = {
        name: predict(fit_rows(rows, taxa, labels, **options), held) for name, options in kinds.items()
    }
    shares = relative_abundance(counts)
    centre = centroids(shares, train)
    mine = shares.join(test.select("sampleID"), "sampleID", "left_semi")
    guessed = classify_centroid(mine, centre, labels=labels)
    pairs["centroid"] = test.join(guessed, "sampleID")
    first = next(iter(kinds))
    return compare_methods(pairs), confusion_diff(pairs[first], pairs["centroid"])


def discover_classes(
    counts: DataFrame,
    k: int = 3,
    shares: tuple[float, ...] = (60, 80),
    tolerance: float = 0.03,
    seed: int = 0,
    **options: Any,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cluster labels, their split gates, and a model panel per training share."""
    rows, _ = cluster_rows(counts)
    found = cluster(rows, k, seed).select("sampleID", "HC_subCST")
    found = materialise(found)
    gates, pairs = [], {}
    for share in shares:
        splits = stratified_split(found, share, validation=(100 - share) / 2, seed=seed)
        splits = materialise(splits)
        gates.append(check_split(splits, tolerance).withColumn("train_share", F.lit(float(share))))
        model = fit(counts, splits.filter(F.col("split") == "train"), **options)
        held = splits.filter(F.col("split") == "validation")
        scored = classify(model, counts.join(held, "sampleID", "left_semi"), held.select("sampleID"))
        pairs[(model.kind, f"{share:g}")] = held.join(scored, "sampleID")
    panel = compare_methods(pairs, ("method", "train_share"))
    return found, reduce(DataFrame.unionByName, gates), panel

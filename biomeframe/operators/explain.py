"""Permutation importance, whole-set and per-class effects."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biomeframe.operators.keyed import hash_order, with_position
from biomeframe.operators.learn import Classifier, predict
from biomeframe.operators.metrics import cells, per_class_metrics, weighted_metrics
from biomeframe.operators.vectors import with_vector
from biomeframe.session import materialise

METRICS = ("f1", "recall", "precision", "accuracy")


def shift_of(feature: int, n: int, seed: int = 0) -> int:
    """How many places feature ``feature`` moves among ``n`` samples: 1 to n - 1 by a hash, the same in any SQL engine."""
    drawn = int(hashlib.md5(f"{seed}|{feature}".encode()).hexdigest()[:13], 16)
    return 1 + drawn % (n - 1) if n > 1 else 0


def permuted_columns(rows: DataFrame, n_features: int, seed: int = 0) -> DataFrame:
    """Add ``permuted``: every feature permuted on its own across the samples.

    Samples are placed in hash order, which has nothing to do with their classes. Feature f moves from
    place s to (s + b_f) mod n, with b_f from a hash: no sample keeps its value unless another has the same,
    and the values are shuffled once for all features together.
    """
    placed = with_position(
        rows.withColumn("_h", hash_order(seed, "sampleID")), ["_h", "sampleID"]
    ).drop("_h")
    n = placed.count()
    shift = F.lit([shift_of(f, n, seed) for f in range(n_features)] or [0])
    target = F.pmod(F.col("position") + F.get(shift, F.col("f")), F.lit(max(n, 1)))
    moved = (
        placed.select("position", F.posexplode("features").alias("f", "v"))
        .groupBy(target.alias("position"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "v"))), lambda e: e["v"]).alias("permuted"))
    )
    return placed.join(moved, "position").drop("position")


def _perturbed_cells(model: Classifier, rows: DataFrame, seed: int) -> DataFrame:
    """Pair counts per taxon with only that taxon permuted.

    Each sample is repeated per feature while it streams through the model; only
    the counts per (taxon, truth, prediction) are shuffled.
    """
    base = rows.select("sampleID", "HC_subCST", "features")
    mixed = permuted_columns(base, len(model.taxa), seed)
    names = F.array(*[F.lit(t) for t in model.taxa])
    repeated = mixed.select(
        "sampleID", "HC_subCST", "features", F.posexplode("permuted").alias("f", "v")
    ).select(
        "sampleID",
        "HC_subCST",
        names[F.col("f")].alias("taxon"),
        F.transform("features", lambda x, i: F.when(i == F.col("f"), F.col("v")).otherwise(x)).alias("features"),
    )
    return cells(predict(model, with_vector(repeated)), ["taxon"])


def perturbation(
    model: Classifier, rows: DataFrame, metrics: tuple[str, ...] = METRICS, by_class: bool = False, seed: int = 0
) -> DataFrame:
    """Metric loss when a taxon is permuted: ``taxon, [HC_subCST,] metric, effect``."""
    rows = materialise(rows.select("sampleID", "HC_subCST", "features", "vector"))
    base = cells(predict(model, rows))
    moved = _perturbed_cells(model, rows, seed)
    score = per_class_metrics if by_class else weighted_metrics
    key = ["HC_subCST"] if by_class else []
    stacked = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics]))
    # At most classes x metrics rows, written so that the planner sees how few.
    before = score(base).select(*key, stacked).withColumnRenamed("v", "v0")
    after = score(moved, ["taxon"]).select("taxon", *key, stacked)
    return after.join(materialise(before), [*key, "metric"]).select(
        "taxon", *key, "metric", (F.col("v0") - F.col("v")).alias("effect")
    )


def perturbation_table(effects: DataFrame, metric: str, labels: list[str]) -> DataFrame:
    """One metric's per-class effects: ``feature`` and one column per class."""
    one = effects.filter(F.col("metric") == metric)
    return one.groupBy(F.col("taxon").alias("feature")).pivot("HC_subCST", labels).agg(F.first("effect"))


def permutation_importance(model: Classifier, rows: DataFrame, seed: int = 0) -> DataFrame:
    """Accuracy drop in percent points per taxon, largest absolute drop first."""
    effects = perturbation(model, rows, ("accuracy",), seed=seed)
    drop = effects.select("taxon", (F.col("effect") * 100).alias("effect"))
    return drop.orderBy(F.abs("effect").desc(), "taxon")

"""Classifiers on abundance features, their storage and scoring.

A fitted model carries the whole feature recipe (taxa, regex, scaling and the
statistics the scaling took from the training samples), so a sample scored alone
gets the same features as in a batch.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Model
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biomeframe.operators.aggregate import class_weights
from biomeframe.operators.centroid import CentroidModel
from biomeframe.operators.frames import drop_taxa_regex
from biomeframe.operators.keyed import attach, hash_order, with_position
from biomeframe.operators.metrics import accuracy
from biomeframe.operators.normalize import fit_scaling
from biomeframe.operators.similarity import class_list, score_columns
from biomeframe.operators.vectors import features, index_labels, selected_shares, taxa_list, with_vector
from biomeframe.session import concurrently, materialise

VERSION = "3"
# Copies of one row that a task makes at most.
COPIES = 1024
KINDS = {
    "centroid": CentroidModel,
    "mlp": MultilayerPerceptronClassificationModel,
    "linear": LogisticRegressionModel,
    "forest": RandomForestClassificationModel,
}


@dataclass
class Classifier:
    """A fitted model with its features, classes and settings."""

    model: Model
    kind: str
    taxa: list[str]
    labels: list[str]
    norm: str = "none"
    regex_remove: list[str] = field(default_factory=list)
    params: dict[str, Any] = field(default_factory=dict)
    scaling: dict[str, Any] = field(default_factory=dict)
    # Lines of a training in stages: epoch, train loss, test loss, accuracy, chosen.
    history: list[tuple] = field(default_factory=list)

    @property
    def structure(self) -> str:
        sizes = [len(self.taxa), self.params.get("hidden"), len(self.labels)]
        return f"{self.kind} " + " -> ".join(str(s) for s in sizes if s is not None)


def hidden_size(n_features: int, n_classes: int, clamp: bool = False) -> int:
    """Two thirds of the features plus the classes; clamped between classes and features."""
    size = int(round(n_features * (2 / 3) + n_classes))
    return max(min(size, n_features), n_classes) if clamp else size


def weighted_rows(train: DataFrame, label: str = "HC_subCST", seed: int = 0) -> DataFrame:
    """Repeat rows by class weight, for learners without a weight column.

    The fractional part is settled by the hash of the id, so the repeats add up
    to the weight on average.
    """
    weights = class_weights(train, label=label).select(label, "weight")
    share = F.conv(F.substring(hash_order(seed, "sampleID"), 1, 8), 16, 10).cast("double") / float(16**8)
    times = F.floor(F.col("weight")) + (share < F.col("weight") - F.floor("weight")).cast("long")
    timed = attach(train, weights, label).withColumn("_times", times.cast("long")).filter("_times > 0")
    return repeated(timed, "_times").drop("weight")


def balanced_rows(
    train: DataFrame, label: str = "HC_subCST", seed: int = 0, size: int | None = None
) -> DataFrame:
    """A sample of ``size`` rows (as many as ``train`` has) in which every class has the same share.

    Systematic sampling with unequal probabilities: every class is a stretch of equal length, every
    sample of a class an equal part of it, and a comb of ``size`` teeth at equal distances, shifted by the seed, counts how often
    a sample is taken: each class gets its share to within one row, each sample of a class its own share to
    within one copy. Samples lie in the order of a hash inside their class; their places come from a range
    partitioning, so neither a class nor the copies of one sample meet in one task. Rows without a label go.
    """
    named = train.filter(F.col(label).isNotNull())
    # One row per class, in the order of the labels.
    sizes = materialise(named.groupBy(label).agg(F.count(F.lit(1)).alias("_n")))
    total = sizes.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("classes")).first()
    if not total["classes"]:
        return named
    before = F.sum("_n").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1))
    at = (F.row_number().over(Window.orderBy(label)) - 1).cast("double")
    ends = sizes.select(label, "_n", F.coalesce(before, F.lit(0)).alias("_before"), at.alias("_class"))
    nested = named.select(F.struct("*").alias("_own"), label, hash_order(seed, "sampleID").alias("_h"), F.col("sampleID").alias("_id"))
    placed = attach(with_position(nested, [label, "_h", "_id"], "_place"), ends, label)
    size = total["n"] if size is None else size
    shift = (seed * 0.6180339887498949) % 1.0
    tooth = lambda r: F.floor((F.col("_class") + r / F.col("_n")) * F.lit(size / total["classes"]) - F.lit(shift))
    rank = F.col("_place") - F.col("_before")
    timed = placed.withColumn("_times", tooth(rank + 1) - tooth(rank)).filter("_times > 0")
    return repeated(timed, "_times").select("_own.*")


def network_rows(rows: DataFrame, seed: int = 0, copies: bool = False) -> DataFrame:
    """Rows for a network with class weights: a balanced sample of the same size, or with ``copies``
    every row as often as its class weight says."""
    return weighted_rows(rows, seed=seed) if copies else balanced_rows(rows, seed=seed)


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as ``times`` says, in two steps with a redistribution between them, so that no task
    makes all copies of a row."""
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / COPIES))
    spread = rows.withColumn("_part", F.explode(parts)).hint("rebalance")
    left = F.least(F.col(times) - F.col("_part") * COPIES, F.lit(COPIES)).cast("int")
    return spread.withColumn("_i", F.explode(F.sequence(F.lit(1), left))).drop("_i", "_part", times)


def fit_table(
    counts: DataFrame,
    samples: DataFrame,
    taxa: list[str] | None = None,
    labels: list[str] | None = None,
    norm: str = "none",
    regex_remove: list[str] = (),
    scaling: dict[str, Any] | None = None,
) -> tuple[DataFrame, list[str], list[str]]:
    """Training rows ``sampleID, HC_subCST, features, vector, label_idx`` with taxa and labels.

    ``scaling`` holds statistics fitted before; without it the samples give their own.
    """
    if taxa is None:
        taxa = taxa_list(drop_taxa_regex(counts, list(regex_remove)))
    labels = class_list(samples) if labels is None else labels
    rows = features(counts, taxa, samples.select("sampleID", "HC_subCST"), norm, regex_remove, scaling)
    return index_labels(with_vector(rows), labels), taxa, labels


def training_scaling(
    counts: DataFrame, samples: DataFrame, taxa: list[str], norm: str, regex_remove: list[str] = ()
) -> dict[str, Any]:
    """The statistics that ``norm`` takes from the training samples."""
    if norm in ("none", "log_ratio"):
        return {}
    return fit_scaling(selected_shares(counts, taxa, samples, regex_remove), norm, taxa, samples)


def without_nan(rows: DataFrame) -> DataFrame:
    """``rows``, or an error if a feature is NaN: a taxon that does not vary cannot be scaled."""
    bad = rows.filter(F.exists("features", F.isnan)).select("sampleID").limit(3).collect()
    if bad:
        raise ValueError(f"features are NaN, as for samples {[r[0] for r in bad]}: leave out taxa that do not vary")
    return rows


def fit_rows(
    rows: DataFrame,
    taxa: list[str],
    labels: list[str],
    kind: str = "mlp",
    norm: str = "none",
    regex_remove: list[str] = (),
    class_weighted: bool = False,
    seed: int = 0,
    hidden: int | None = None,
    scaling: dict[str, Any] | None = None,
    copies: bool = False,
    **params: Any,
) -> Classifier:
    """Fit one classifier on prepared rows; ``params`` go to the Spark estimator.

    A network with class weights learns from :func:`network_rows`; ``copies`` is theirs.

    ``scaling`` are the statistics the rows were scaled with. ``centroid`` is the nearest class
    mean by Yue-Clayton similarity; class weights do not change it.

    Pass stored rather than cached rows: the estimators keep their own compact
    copy between iterations, but only of a table that is not cached already.
    """
    common = {"featuresCol": "vector", "labelCol": "label_idx"}
    if kind == "mlp":
        hidden = hidden or hidden_size(len(taxa), len(labels))
        data = materialise(network_rows(rows, seed, copies)) if class_weighted else rows
        layers = [len(taxa), hidden, len(labels)]
        estimator = MultilayerPerceptronClassifier(layers=layers, seed=seed, **common, **params)
    elif kind in ("linear", "forest"):
        data = rows
        if class_weighted:
            data = attach(rows, class_weights(rows).select("HC_subCST", "weight"), "HC_subCST")
            common["weightCol"] = "weight"
        if kind == "linear":
            estimator = LogisticRegression(family="multinomial", **common, **params)
        else:
            params.setdefault("featureSubsetStrategy", "sqrt")
            estimator = RandomForestClassifier(seed=seed, **common, **params)
    elif kind == "centroid":
        data, estimator = rows, CentroidModel
    else:
        raise ValueError(f"unknown classifier {kind!r}")
    model = estimator.fit(data)
    stored = {**params, "seed": seed, "class_weighted": class_weighted}
    if kind == "mlp":
        stored["hidden"] = hidden
    return Classifier(model, kind, taxa, labels, norm, list(regex_remove), stored, scaling or {})


def fit(
    counts: DataFrame,
    samples: DataFrame,
    kind: str = "mlp",
    taxa: list[str] | None = None,
    labels: list[str] | None = None,
    norm: str = "none",
    regex_remove: list[str] = (),
    **options: Any,
) -> Classifier:
    """Counts and labelled samples to a fitted classifier."""
    if taxa is None:
        taxa = taxa_list(drop_taxa_regex(counts, list(regex_remove)))
    scaling = training_scaling(counts, samples, taxa, norm, regex_remove)
    rows, taxa, labels = fit_table(counts, samples, taxa, labels, norm, regex_remove, scaling)
    rows = materialise(rows)
    if norm != "none":
        without_nan(rows)
    return fit_rows(rows, taxa, labels, kind, norm, regex_remove, scaling=scaling, **options)


def named_scores(scored: DataFrame, labels: list[str]) -> DataFrame:
    """``scores`` (probability per class, label order) and ``subCST`` instead of a Spark classifier's output columns."""
    names = F.array(*[F.lit(x) for x in labels])
    return scored.withColumns(
        {
            "scores": vector_to_array("probability"),
            "subCST": F.element_at(names, F.col("prediction").cast("int") + 1),
        }
    ).drop("vector", "label_idx", "rawPrediction", "probability", "prediction")


def predict(model: Classifier, rows: DataFrame) -> DataFrame:
    """Add ``scores`` (probability per class, label order) and ``subCST`` to vector rows."""
    return named_scores(model.model.transform(rows), model.labels)


def classify(
    model: Classifier, counts: DataFrame, samples: DataFrame | None = None, refit_scaling: bool = False
) -> DataFrame:
    """Label and class probabilities for a cohort, from its counts of the model's taxa.

    Scaling uses the training statistics; ``refit_scaling`` takes those of the cohort instead.
    """
    if samples is None:
        samples = counts.select("sampleID").distinct()
    scaling = None if refit_scaling else model.scaling
    rows = features(counts, model.taxa, samples, model.norm, model.regex_remove, scaling)
    return predict(model, with_vector(rows)).drop("features")


def export_predictions(scored: DataFrame, labels: list[str]) -> DataFrame:
    """``subCST`` and one ``Pct <label>`` column per class."""
    return score_columns(scored, labels, "Pct {}")


def append_predictions(table: DataFrame, scored: DataFrame, labels: list[str]) -> DataFrame:
    """Original, unnormalised rows with their prediction and probability columns."""
    return table.join(export_predictions(scored.select("sampleID", "subCST", "scores"), labels), "sampleID")


def held_out_accuracy(model: Classifier, rows: DataFrame) -> float:
    return accuracy(predict(model, rows)).first()["accuracy"]


def fit_best(
    train: DataFrame, test: DataFrame, taxa: list[str], labels: list[str], seeds: list[int], **options: Any
) -> tuple[Classifier, DataFrame]:
    """One fit per seed; the first with the highest held-out accuracy, and all results."""
    same = test is train
    train = materialise(train)
    test = train if same else materialise(test)
    models = concurrently(lambda s: fit_rows(train, taxa, labels, seed=s, **options), seeds)
    scores = [held_out_accuracy(m, test) for m in models]
    best = scores.index(max(scores))
    rows = [(i, s, a, i == best) for i, (s, a) in enumerate(zip(seeds, scores, strict=True))]
    results = train.sparkSession.createDataFrame(
        rows, "position int, seed int, accuracy double, chosen boolean"
    )
    return models[best], results


def grid_search(
    train_counts: DataFrame,
    train: DataFrame,
    test_counts: DataFrame,
    test: DataFrame,
    grid: list[dict[str, Any]],
    norms: list[str] = ("none",),
    repeats: int = 1,
    kind: str = "mlp",
) -> DataFrame:
    """Mean held-out accuracy per scaling and parameter set over repeated seeds."""
    results = []
    for norm in norms:
        taxa = taxa_list(train_counts)
        scaling = training_scaling(train_counts, train, taxa, norm)
        rows, taxa, labels = fit_table(train_counts, train, taxa, norm=norm, scaling=scaling)
        held, _, _ = fit_table(test_counts, test, taxa, labels, norm, scaling=scaling)
        rows, held = without_nan(materialise(rows)), without_nan(materialise(held))

        def score(job: tuple[dict[str, Any], int]) -> float:
            cell, s = job
            return held_out_accuracy(fit_rows(rows, taxa, labels, kind, norm, seed=s, **cell), held)

        jobs = [(cell, s) for cell in grid for s in range(repeats)]
        scores = concurrently(score, jobs)
        for i, cell in enumerate(grid):
            mean = sum(scores[i * repeats : (i + 1) * repeats]) / repeats
            results.append((len(results), norm, json.dumps(cell, sort_keys=True), mean))
    schema = "position int, norm string, params string, accuracy double"
    return train.sparkSession.createDataFrame(results, schema)


def save_model(model: Classifier, path: str) -> None:
    """The Spark model and a one-row table with everything needed to use it."""
    spark = SparkSession.active()
    model.model.write().overwrite().save(f"{path}/model")
    row = (
        VERSION, model.kind, model.structure, model.taxa, model.labels, model.norm, model.regex_remove,
        json.dumps(model.params, sort_keys=True), json.dumps(model.scaling, sort_keys=True), json.dumps(model.history),
    )
    schema = (
        "version string, kind string, structure string, features array<string>, labels array<string>,"
        " norm string, regex_remove array<string>, params string, scaling string, history string"
    )
    spark.createDataFrame([row], schema).write.mode("overwrite").parquet(f"{path}/info")


def model_info(spark: SparkSession, path: str) -> DataFrame:
    """Structure, features, classes and settings of a stored model."""
    info = spark.read.parquet(f"{path}/info")
    return info.withColumns({"n_features": F.size("features"), "n_classes": F.size("labels")})


def load_model(spark: SparkSession, path: str, taxa: list[str] | None = None) -> Classifier:
    """Load a model; its version and, when given, the set of taxa must match."""
    row = model_info(spark, path).first()
    if row["version"] != VERSION:
        raise ValueError(f"model version {row['version']} does not match {VERSION}")
    if taxa is not None and set(taxa) != set(row["features"]):
        raise ValueError("the model's taxa and the given taxa differ")
    model = KINDS[row["kind"]].load(f"{path}/model")
    return Classifier(
        model, row["kind"], list(row["features"]), list(row["labels"]), row["norm"],
        list(row["regex_remove"]), json.loads(row["params"]), json.loads(row["scaling"]),
        [tuple(line) for line in json.loads(row["history"])],
    )


def training_history(model: Classifier) -> DataFrame:
    """epoch, train_loss, test_loss, accuracy and chosen of a network trained in stages (stored models too), or the
    training loss per iteration of a freshly fitted iterative model."""
    schema = "epoch int, train_loss double, test_loss double, accuracy double, chosen boolean"
    if model.history:
        return SparkSession.active().createDataFrame(model.history, schema)
    if model.kind in ("forest", "centroid"):
        raise ValueError(f"a {model.kind} model has no training iterations")
    summary = model.model.summary() if model.kind == "mlp" else model.model.summary
    rows = [(i, float(v), None, None, None) for i, v in enumerate(summary.objectiveHistory)]
    return SparkSession.active().createDataFrame(rows, schema)

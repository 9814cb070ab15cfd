"""A classifier as one Spark ``PipelineModel``: feature recipe, model and names of the classes in one folder.

``PipelineModel.load`` needs nothing but this package; what it returns turns long counts into scores.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from biomeframe.operators.centroid import CentroidModel
from biomeframe.operators.learn import Classifier, named_scores
from biomeframe.operators.vectors import features, with_vector


class AbundanceFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Long counts to one row per sample with ``features`` and ``vector``: taxa, patterns, shares and stored scaling."""

    taxa = Param(Params._dummy(), "taxa", "normalised taxon names in feature order", TypeConverters.toListString)
    regexRemove = Param(Params._dummy(), "regexRemove", "patterns of taxa to leave out", TypeConverters.toListString)
    norm = Param(Params._dummy(), "norm", "scaling method", TypeConverters.toString)
    scaling = Param(Params._dummy(), "scaling", "statistics of the training samples, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, taxa: list[str] = (), regexRemove: list[str] = (), norm: str = "none", scaling: str = "{}"):
        super().__init__()
        self._setDefault(taxa=[], regexRemove=[], norm="none", scaling="{}")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        samples = dataset.select("sampleID").distinct()
        recipe = (get(self.taxa), samples, get(self.norm), get(self.regexRemove), json.loads(get(self.scaling)))
        return with_vector(features(dataset, *recipe))


class NearestCentroid(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The nearest class mean on ``features``, with the output columns of a fitted Spark classifier."""

    centroids = Param(Params._dummy(), "centroids", "class means in label order, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, centroids: str = "[]"):
        super().__init__()
        self._setDefault(centroids="[]")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return CentroidModel(json.loads(self.getOrDefault(self.centroids))).transform(dataset)


class ClassNames(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``scores`` and ``subCST`` from a classifier's output columns."""

    labels = Param(Params._dummy(), "labels", "class names in label order", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, labels: list[str] = ()):
        super().__init__()
        self._setDefault(labels=[])
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return named_scores(dataset, self.getOrDefault(self.labels)).drop("features")


def as_pipeline(model: Classifier) -> PipelineModel:
    """The stages that make a cohort's scores from its long counts, as :func:`classify` does with stored scaling."""
    recipe = AbundanceFeatures(
        taxa=list(model.taxa), regexRemove=list(model.regex_remove), norm=model.norm, scaling=json.dumps(model.scaling)
    )
    middle = model.model
    if isinstance(middle, CentroidModel):
        middle = NearestCentroid(centroids=json.dumps(middle.centroids))
    return PipelineModel([recipe, middle, ClassNames(labels=list(model.labels))])


def save_pipeline(model: Classifier, path: str) -> None:
    """One folder that ``PipelineModel.load`` reads."""
    as_pipeline(model).write().overwrite().save(path)

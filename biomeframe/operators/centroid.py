"""Nearest class mean as a model on feature arrays, with the methods of a fitted Spark model."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biomeframe.functions.scores import ratio
from biomeframe.session import listed


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


class CentroidModel:
    """Class means in label order; the class with the largest Yue-Clayton similarity wins,
    the first one among equals. ``probability`` holds the similarities."""

    def __init__(self, centroids: list[list[float]]):
        self.centroids = centroids

    @classmethod
    def fit(cls, rows: DataFrame) -> CentroidModel:
        """Means of ``features`` per ``label_idx``; a class without rows has the mean 0."""
        values = rows.select("label_idx", F.posexplode("features").alias("f", "v"))
        means = values.groupBy("label_idx", "f").agg(F.avg("v").alias("v")).collect()
        n_classes = int(max((r["label_idx"] for r in means), default=-1)) + 1
        n_features = max((r["f"] for r in means), default=-1) + 1
        out = [[0.0] * n_features for _ in range(n_classes)]
        for r in means:
            out[int(r["label_idx"])][r["f"]] = r["v"]
        return cls(out)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add ``probability`` and ``prediction`` to vector rows."""
        spark = rows.sparkSession
        means = listed(spark, means=[self.centroids]).select("means").scalar()
        own = _dot("features", "features")
        theta = F.transform(F.col("_m"), lambda c: ratio(_dot(F.col("features"), c), own + _dot(c, c) - _dot(F.col("features"), c)))
        scored = rows.withColumn("_m", means).withColumn("_t", theta)
        best = F.array_position("_t", F.array_max("_t")) - 1
        return scored.select(
            *rows.columns, array_to_vector("_t").alias("probability"), best.cast("double").alias("prediction")
        )

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def load(cls, path: str) -> CentroidModel:
        rows = SparkSession.active().read.parquet(path).orderBy("label_idx").collect()
        return cls([list(r["centroid"]) for r in rows])


class _Writer:
    """Stores a model as a table with one row per class."""

    def __init__(self, model: CentroidModel):
        self.model, self.mode = model, "errorifexists"

    def overwrite(self) -> _Writer:
        self.mode = "overwrite"
        return self

    def save(self, path: str) -> None:
        rows = list(enumerate(self.model.centroids))
        table = SparkSession.active().createDataFrame(rows, "label_idx int, centroid array<double>")
        table.write.mode(self.mode).parquet(path)

"""Scoring of samples as they arrive: dense feature rows in files, scored rows in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from biomeframe.operators.learn import Classifier, predict
from biomeframe.operators.vectors import with_vector


def read_rows(spark: SparkSession, path: str, schema: StructType | str, files_a_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; every file is read once."""
    reader = spark.readStream.schema(schema)
    if files_a_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path)


def score_stream(model: Classifier, rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Score what has arrived and end; the next call with the same ``checkpoint`` goes on from there.

    ``rows`` hold ``sampleID`` and ``features`` in the order and scaling of the model (:func:`features`). Each row is
    scored on its own, so no state is kept, and late or repeated samples are rows like any other.
    """
    scored = predict(model, with_vector(rows)).drop("features")
    writer = scored.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)

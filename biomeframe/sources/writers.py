"""Table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV part files with a header."""
    df.write.mode(mode).csv(path, header=True)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per split, written in one pass and pruned by split when read."""
    writer = df.write.mode(mode).partitionBy("split").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def to_wide(long: DataFrame, taxa: list[str], value: str = "count", keep: list[str] = ("sampleID",)) -> DataFrame:
    """One column per taxon in the given order, absent counts as 0, repeated ones added up."""
    wide = long.groupBy(*keep).pivot("taxon", list(taxa)).agg(F.sum(value))
    return wide.na.fill(0.0, subset=list(taxa))


def centroids_wide(centroids: DataFrame, taxa: list[str], label: str = "HC_subCST") -> DataFrame:
    """Centroid export: ``sub_CST`` and one column per taxon."""
    return to_wide(centroids, taxa, "value", [label]).withColumnRenamed(label, "sub_CST")

"""Long counts to dense feature vectors in canonical taxon order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biomeframe.functions.names import norm_taxon
from biomeframe.functions.scores import ratio
from biomeframe.operators.frames import drop_taxa_regex
from biomeframe.operators.keyed import attach_listed
from biomeframe.operators.normalize import fit_scaling, log_ratio, only_samples, relative_abundance, tmm
from biomeframe.operators.similarity import class_list, names_on_driver
from biomeframe.session import listed


def taxa_list(df: DataFrame) -> list[str]:
    """Normalised taxon names in canonical order; vectors need them on the driver."""
    return names_on_driver(df.select(norm_taxon("taxon").alias("taxon")))


def arrays(values: DataFrame, taxa: list[str], samples: DataFrame | None = None, fill: float = 0.0) -> DataFrame:
    """``features``: one array per sample in the order of ``taxa``; absent taxa get ``fill``.

    Names are compared as they are: normalising twice could strip a second prefix.
    """
    order = pa.array(range(len(taxa)), pa.int32())
    indexed = attach_listed(values, "inner", "taxon", taxon=taxa, idx=order)
    # At most one entry per taxon and sample.
    packed = indexed.groupBy("sampleID").agg(F.collect_list(F.struct("idx", "value")).alias("have"))
    if samples is not None:
        none = F.array().cast("array<struct<idx:int,value:double>>")
        packed = samples.join(packed, "sampleID", "left").withColumn("have", F.coalesce("have", none))
    absent = F.array_except(F.sequence(F.lit(0), F.lit(len(taxa) - 1)), F.col("have.idx"))
    filler = F.transform(absent, lambda i: F.struct(i.alias("idx"), F.lit(float(fill)).alias("value")))
    dense = F.transform(F.sort_array(F.concat("have", filler)), lambda e: e["value"])
    return packed.withColumn("features", dense).drop("have")


def merged_shares(counts: DataFrame, zero_policy: str = "zero") -> DataFrame:
    """Shares under normalised names; taxa with the same normalised name are added up.

    The sum follows the per-sample window, so it needs no shuffle of its own.
    """
    shares = relative_abundance(counts, zero_policy)
    return shares.groupBy("sampleID", norm_taxon("taxon").alias("taxon")).agg(F.sum("value").alias("value"))


def features(
    counts: DataFrame,
    taxa: list[str],
    samples: DataFrame,
    norm: str = "none",
    regex_remove: list[str] = (),
    scaling: dict | None = None,
) -> DataFrame:
    """Selected taxa, then shares among them, then scaling, as arrays for every sample.

    ``scaling`` holds the statistics of the training samples; without it they come from
    ``samples``. A taxon that does not vary there is scaled to NaN.
    """
    values = selected_shares(counts, taxa, samples, regex_remove)
    if scaling is None:
        scaling = fit_scaling(values, norm, taxa, samples)
    if norm == "log_ratio":
        values = log_ratio(values)
    elif norm == "tmm":
        schema = "taxon string, yr double, nr double"
        reference = samples.sparkSession.createDataFrame(scaling["reference"], schema)
        values = tmm(values, reference=reference, centre=scaling["centre"])
    elif norm not in ("none", "zscore", "minmax", "stddev"):
        raise ValueError(f"unknown scaling method {norm!r}")
    rows = arrays(values, taxa, samples)
    if "by" not in scaling:
        return rows
    # Two numbers per taxon, in one row.
    numbers = listed(samples.sparkSession, shift=[scaling["shift"]], by=[scaling["by"]])
    fitted = numbers.select(F.arrays_zip("shift", "by").alias("s")).scalar()
    scaled = F.zip_with("features", F.col("_s"), lambda x, s: ratio(x - s["shift"], s["by"]))
    return rows.withColumn("_s", fitted).withColumn("features", scaled).drop("_s")


def selected_shares(
    counts: DataFrame, taxa: list[str], samples: DataFrame, regex_remove: list[str] = ()
) -> DataFrame:
    """Shares of the listed samples among the selected taxa, under normalised names."""
    counts = only_samples(counts, samples)
    kept = drop_taxa_regex(counts, list(regex_remove)) if regex_remove else counts
    named = kept.withColumn("_norm", norm_taxon("taxon"))
    chosen = attach_listed(named, "left_semi", "_norm", _norm=taxa).drop("_norm")
    return merged_shares(chosen)


def with_vector(df: DataFrame, array: str = "features", name: str = "vector") -> DataFrame:
    return df.withColumn(name, array_to_vector(array))


def index_labels(samples: DataFrame, labels: list[str] | None = None, label: str = "HC_subCST", one_hot: bool = False) -> DataFrame:
    """``label_idx`` in alphabetical order (or the caller's universe), optionally ``one_hot``."""
    labels = class_list(samples, label) if labels is None else labels
    indexer = StringIndexerModel.from_labels(labels, inputCol=label, outputCol="label_idx")
    indexed = indexer.transform(samples)
    if not one_hot:
        return indexed
    encoder = OneHotEncoder(inputCol="label_idx", outputCol="one_hot", dropLast=False)
    return encoder.fit(indexed).transform(indexed)

"""Column roles, feature selection and validation."""

from __future__ import annotations

import logging

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biomeframe.functions.names import drop_leading_blanks, drop_trailing_blank, norm_taxon
from biomeframe.operators.keyed import attach, attach_listed, with_position
from biomeframe.session import listed

log = logging.getLogger(__name__)

# Fixed list: non-count columns of the raw labelled vaginal table.
RAW_METADATA = [
    "Val_CST", "Val_subCST", "I-A_sim", "I-B_sim", "II_sim", "III-A_sim", "III-B_sim", "IV-A_sim",
    "IV-B_sim", "IV-C0_sim", "IV-C1_sim", "IV-C2_sim", "IV-C3_sim", "IV-C4_sim", "V_sim",
    "Subject_number", "HC_CST",
]


def feature_dictionary(df: DataFrame) -> DataFrame:
    """``taxon, norm, idx``: canonical order by normalised name, then source order or name."""
    first = F.min("pos") if "pos" in df.columns else F.lit(0)
    taxa = df.groupBy("taxon").agg(first.alias("p")).withColumn("norm", norm_taxon("taxon"))
    placed = with_position(taxa, ["norm", "p", "taxon"], "idx")
    return placed.select("taxon", "norm", F.col("idx").cast("int").alias("idx"))


def drop_columns(wide: DataFrame, names: list[str]) -> DataFrame:
    """Drop named columns; names that do not exist are only logged."""
    absent = [n for n in names if n not in wide.columns]
    if absent:
        log.warning("columns to drop not found: %s", ", ".join(absent))
    return wide.drop(*names)


def drop_taxa(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows of taxa not in ``names``; names that do not exist are only logged."""
    given = listed(df.sparkSession, taxon=list(names))
    absent = [r[0] for r in given.join(df.select("taxon").distinct(), "taxon", "left_anti").collect()]
    if absent:
        log.warning("taxa to drop not found: %s", ", ".join(sorted(absent)))
    return attach_listed(df, "left_anti", "taxon", taxon=list(names))


def keep_taxa(df: DataFrame, names: list[str], strict: bool = True) -> DataFrame:
    """Rows of exactly these taxa, compared by normalised name; ``strict`` raises on absent ones."""
    given = listed(df.sparkSession, taxon=list(names))
    wanted = given.select(norm_taxon("taxon").alias("_norm")).distinct()
    if strict:
        have = df.select(norm_taxon("taxon").alias("_norm")).distinct()
        absent = [r[0] for r in wanted.join(have, "_norm", "left_anti").limit(20).collect()]
        if absent:
            raise ValueError(f"taxa not found: {absent}")
    return attach(df.withColumn("_norm", norm_taxon("taxon")), wanted, "_norm", "left_semi").drop("_norm")


def drop_taxa_regex(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Rows whose original taxon name matches none of the patterns."""
    for p in patterns:
        df = df.filter(~F.col("taxon").rlike(p))
    return df


def project_taxa(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the named (normalised) taxa with their position in the list as ``idx``."""
    named = df.withColumn("taxon", norm_taxon("taxon"))
    order = pa.array(range(len(names)), pa.int32())
    return attach_listed(named, "inner", "taxon", taxon=list(names), idx=order)


def canonicalise(
    wide: DataFrame,
    sample: str | None = "Sample_number_for_SRA",
    depth: str | None = "total_reads",
    label: str | None = "HC_subCST",
    drop: list[str] = RAW_METADATA,
    order_by: list[str] | None = None,
) -> DataFrame:
    """Study columns to ``sampleID, read_count, HC_subCST``.

    ``sample=None`` numbers the rows in the order of ``order_by``; ``depth=None``
    adds up all columns that are not id or label; ``label=None`` is unlabelled data.
    """
    wide = drop_columns(wide, list(drop)) if drop else wide
    for role, name in (("sample", sample), ("read count", depth), ("label", label)):
        if name is not None and name not in wide.columns:
            raise ValueError(f"{role} column {name!r} not found")
    if depth is None:
        counts = [c for c in wide.columns if c not in (sample, label)]
        wide = add_read_count(wide, counts)
    if sample is None:
        wide = add_sample_ids(wide, order_by or wide.columns)
    renames = {sample: "sampleID", depth: "read_count", label: "HC_subCST"}
    wide = wide.withColumnsRenamed({a: b for a, b in renames.items() if a is not None})
    if label is not None:
        wide = wide.withColumn("HC_subCST", F.col("HC_subCST").cast("string"))
    return order_columns(wide)


def add_sample_ids(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Ids 0..n-1 in an explicit order; a hash of the row spreads long runs of equal keys."""
    tied = df.withColumn("_tie", F.xxhash64(*df.columns))
    return with_position(tied, [*order_by, "_tie"], "sampleID").drop("_tie")


def add_read_count(wide: DataFrame, counts: list[str]) -> DataFrame:
    """Row sum of the count columns, nulls skipped."""
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in counts])
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    return wide.withColumn("read_count", total)


def dedupe_taxa(df: DataFrame, mode: str = "first") -> DataFrame:
    """One source column per normalised name: keep the first, or raise."""
    names = df.groupBy("taxon").agg(F.min("pos").alias("pos")).withColumn("_norm", norm_taxon("taxon"))
    if mode == "error":
        twice = names.groupBy("_norm").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
        found = [r["_norm"] for r in twice.limit(20).collect()]
        if found:
            raise ValueError(f"duplicate taxa: {found}")
        return df
    if mode != "first":
        raise ValueError(f"unknown mode {mode!r}")
    first = names.groupBy("_norm").agg(F.min_by("taxon", F.struct("pos", "taxon")).alias("taxon"))
    return attach(df, first.select("taxon"), "taxon", "left_semi")


def validate(wide: DataFrame, expect_labelled: bool) -> DataFrame:
    """Check required columns; labels that were not asked for are dropped."""
    if "sampleID" not in wide.columns:
        raise ValueError("required column 'sampleID' not found")
    labelled = "HC_subCST" in wide.columns
    if expect_labelled and not labelled:
        raise ValueError("labelled data expected, no 'HC_subCST' column found")
    if labelled and not expect_labelled:
        log.warning("labels found in unlabelled data; they are ignored")
        return wide.drop("HC_subCST")
    return wide


def trim_taxa(df: DataFrame, side: str = "trailing") -> DataFrame:
    """Trim taxon names: one trailing blank or all leading blanks."""
    rule = {"trailing": drop_trailing_blank, "leading": drop_leading_blanks}[side]
    return df.withColumn("taxon", rule("taxon"))


def order_columns(wide: DataFrame) -> DataFrame:
    """``sampleID, read_count`` first, the rest as they were; repeated names are an error."""
    twice = sorted({c for c in wide.columns if wide.columns.count(c) > 1})
    if twice:
        raise ValueError(f"duplicate columns: {twice}")
    lead = ["sampleID", "read_count"]
    for c in lead:
        if c not in wide.columns:
            raise ValueError(f"required column {c!r} not found")
    return wide.select(*[f"`{c}`" for c in lead + [c for c in wide.columns if c not in lead]])


def load_classifications(df: DataFrame, label: str = "subCST", sample: str = "sampleID") -> DataFrame:
    """Id and class under their canonical names, sorted by id."""
    return df.select(F.col(sample).alias("sampleID"), F.col(label).alias("subCST")).orderBy("sampleID")


def of_class(df: DataFrame, value: str, label: str = "HC_subCST") -> DataFrame:
    """Samples of one class."""
    return df.filter(F.col(label) == value)

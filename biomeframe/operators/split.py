"""Exact stratified splits and their audit.

A class may hold most samples, so no class is gathered or ranked as a whole. A
histogram over 4096 hash buckets locates each cut; only the bucket that holds
the cut is ranked, giving the cut's hash; the rows are then compared with it in
one narrow pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biomeframe.functions.scores import ratio
from biomeframe.operators.aggregate import class_prevalence
from biomeframe.operators.keyed import attach, hash_order, with_position
from biomeframe.session import materialise

BUCKET_DIGITS = 3


def _truncated(n: Column, pct: float) -> Column:
    return F.floor(n * F.lit(pct / 100.0)).cast("long")


def slice_of(
    samples: DataFrame, sizes: list[float], seed: int = 0, label: str = "HC_subCST"
) -> DataFrame:
    """Add ``slice``: per class the first truncated ``sizes`` percent, then the rest.

    The order inside a class is the seeded hash of the id. A null class forms
    a stratum of its own.
    """
    if not 1 <= len(sizes) <= 2:
        raise ValueError("one or two slice sizes")
    stratum = F.coalesce(F.col(label).cast("string"), F.lit("nan"))
    keyed = samples.select(
        "sampleID", stratum.alias("_s"), hash_order(seed, "sampleID").alias("_h")
    ).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    hist = keyed.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
    # At most 4096 rows per class.
    by_class = Window.partitionBy("_s")
    spans = hist.withColumns(
        {"_hi": F.sum("_c").over(by_class.orderBy("_b")), "_n": F.sum("_c").over(by_class)}
    ).withColumn("_lo", F.col("_hi") - F.col("_c"))
    ends, upto = [], F.lit(0).cast("long")
    for i, pct in enumerate(sizes):
        upto = upto + _truncated(F.col("_n"), pct)
        ends.append(F.struct(F.lit(i + 1).alias("cut"), upto.alias("at")))
    bounds = (
        spans.withColumn("_e", F.explode(F.array(*ends)))
        .filter((F.col("_lo") < F.col("_e.at")) & (F.col("_e.at") <= F.col("_hi")))
        .select("_s", "_b", F.col("_e.cut").alias("_cut"), (F.col("_e.at") - F.col("_lo")).alias("_k"))
    )
    wanted = bounds.groupBy("_s", "_b").agg(F.collect_list(F.struct("_cut", "_k")).alias("_w"))
    rank = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", "sampleID"))
    last = (
        attach(keyed, wanted, ["_s", "_b"])
        .withColumn("_r", rank)
        .withColumn("_w", F.explode("_w"))
        .filter(F.col("_r") == F.col("_w._k"))
        .groupBy("_s")
        .agg(
            *[
                F.max(F.when(F.col("_w._cut") == i, F.struct("_h", "sampleID"))).alias(f"_c{i}")
                for i in (1, 2)
            ]
        )
    )
    own = F.struct(F.col("_h"), F.col("sampleID"))
    placed = (
        F.when(own <= F.col("_c1"), 1).when(own <= F.col("_c2"), 2).otherwise(len(sizes) + 1)
    )
    marked = samples.withColumns({"_s": stratum, "_h": hash_order(seed, "sampleID")})
    return (
        attach(marked, last, "_s", "left")
        .withColumn("slice", placed.cast("int"))
        .drop("_s", "_h", "_c1", "_c2")
    )


def slice_names(three_way: bool, labelled: bool, reference_naming: bool = True) -> list[str]:
    """Split name per slice; the labelled three-way naming swaps test and validation."""
    if not three_way:
        return ["train", "test"]
    if labelled and reference_naming:
        return ["train", "test", "validation"]
    return ["train", "validation", "test"]


def _named(df: DataFrame, names: list[str]) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("slice"))
    return df.withColumn("split", name).drop("slice")


def stratified_split(
    samples: DataFrame,
    train: float,
    validation: float | None = None,
    seed: int = 0,
    label: str = "HC_subCST",
    reference_naming: bool = True,
) -> DataFrame:
    """Add ``split`` with exact truncated counts in every class."""
    sizes = [train] if validation is None else [train, validation]
    names = slice_names(validation is not None, True, reference_naming)
    return _named(slice_of(samples, sizes, seed, label), names)


def split_unlabelled(
    samples: DataFrame, train: float, validation: float | None = None, order_by: str = "sampleID"
) -> DataFrame:
    """Slice in the given order, counts rounded half to even, no shuffle before."""
    n = samples.agg(F.count(F.lit(1)).cast("double")).scalar()
    first = F.bround(F.lit(train / 100.0) * n, 0)
    cut = F.when(F.col("position") < first, 1)
    if validation is not None:
        second = first + F.bround(F.lit(validation / 100.0) * n, 0)
        cut = cut.when(F.col("position") < second, 2)
    keys = [order_by] if order_by == "sampleID" else [order_by, "sampleID"]
    placed = with_position(samples, keys).withColumn(
        "slice", cut.otherwise(2 if validation is None else 3)
    )
    return _named(placed.drop("position"), slice_names(validation is not None, False))


def shuffle(df: DataFrame, seed: int = 0) -> DataFrame:
    """Rows in seeded hash order of the id."""
    return df.orderBy(hash_order(seed, "sampleID"), "sampleID")


def split_audit(
    splits: DataFrame, tolerance: float | None = None, label: str = "HC_subCST"
) -> DataFrame:
    """Class shares of every split next to the whole set.

    ``abs_diff`` compares shares, ``rel_pct_signed`` and ``rel_pct`` their ratio.
    A class missing from a split has no difference, so it passes
    (``passes_reference``); ``class_missing`` tells it apart. A tolerance of -1
    or None lets everything pass.
    """
    # Classes x splits rows, read three times.
    per_split = materialise(
        class_prevalence(splits, label, ["split"]).withColumnsRenamed({"n": "n_split", "prevalence": "p_split"})
    )
    whole = per_split.groupBy(label).agg(F.sum("n_split").alias("n_ref"))
    whole = whole.withColumn(
        "p_ref", ratio(F.col("n_ref"), F.sum("n_ref").over(Window.partitionBy(F.lit(0))))
    )
    # Classes x splits: one small row each.
    names = per_split.agg(F.sort_array(F.collect_set("split"))).scalar()
    grid = whole.withColumn("split", F.explode(names))
    joined = grid.join(per_split, [label, "split"], "left")
    off = F.abs(F.col("p_split") - F.col("p_ref"))
    rel = (F.col("p_split") / F.col("p_ref") - 1) * 100
    limit = -1.0 if tolerance is None else float(tolerance)
    passes = F.lit(True) if limit == -1.0 else ~F.coalesce(off > limit, F.lit(False))
    return joined.select(
        label,
        "split",
        "p_ref",
        "p_split",
        off.alias("abs_diff"),
        rel.alias("rel_pct_signed"),
        F.abs(rel).alias("rel_pct"),
        passes.alias("passes_reference"),
        F.col("p_split").isNull().alias("class_missing"),
    )


def check_split(splits: DataFrame, tolerance: float, label: str = "HC_subCST") -> DataFrame:
    """Gate per split: offending classes and the worst absolute difference."""
    audit = split_audit(splits, tolerance, label)
    return audit.groupBy("split").agg(
        F.sort_array(F.collect_list(F.when(~F.col("passes_reference"), F.col(label)))).alias("offending"),
        F.max("abs_diff").alias("worst"),
        F.bool_and("passes_reference").alias("passes"),
        F.bool_or("class_missing").alias("class_missing"),
    )


def tolerance_report(splits: DataFrame, label: str = "HC_subCST") -> DataFrame:
    """Relative tolerance per class and split with the split's worst and a text form."""
    audit = split_audit(splits, None, label)
    worst = F.max("rel_pct_signed").over(Window.partitionBy("split"))
    return audit.select(
        label,
        "split",
        "rel_pct_signed",
        "rel_pct",
        worst.alias("worst_signed"),
        F.format_string("%2.6f%%", "rel_pct_signed").alias("text"),
    )


def permute(df: DataFrame, value: str = "value", seed: int = 0) -> DataFrame:
    """Seeded permutation of one column across samples.

    The sample at position p by id receives the value of the sample at position
    p in hash order.
    """
    by_id = with_position(df, ["sampleID"])
    hashed = by_id.select(F.col(value).alias("permuted"), "sampleID").withColumn(
        "_h", hash_order(seed, "sampleID")
    )
    by_hash = with_position(hashed, ["_h", "sampleID"]).select("position", "permuted")
    return by_id.join(by_hash, "position").drop("position")

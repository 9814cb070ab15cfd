"""Keyed building blocks that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biomeframe.session import listed, materialise


def attach(rows: DataFrame, table: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join a per-key table (unique keys) to many rows.

    A plain equi-join: adaptive execution broadcasts the table if its measured
    size allows that, and splits hot keys of the rows side otherwise. No job
    runs while the plan is built and nothing stays cached.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"attach keeps the rows side; unsupported join {how!r}")
    return rows.join(table, keys, how)


def attach_listed(rows: DataFrame, how: str, on: str, **columns: list) -> DataFrame:
    """Join driver-side lists to many rows; their size is known when the plan is made."""
    return attach(rows, listed(rows.sparkSession, **columns), on, how)


def hash_order(seed: int | str, key: Column | str) -> Column:
    """Seeded pseudo-random order of a key: the same text in any SQL engine."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def with_position(df: DataFrame, order_by: list[str], name: str = "position") -> DataFrame:
    """Exact 0-based position in the order of ``order_by`` without a one-task sort.

    Rows are range-partitioned and sorted; each partition's offset in the table
    comes from the partition sizes (one row per partition). The sorted rows are
    written once, so both uses see the same partitions. End ``order_by`` with
    a unique key to split long runs of equal values.
    """
    part = F.spark_partition_id()
    row_in_part = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    ranged = materialise(
        df.repartitionByRange(*[F.col(c) for c in order_by])
        .sortWithinPartitions(*order_by)
        .withColumns({"_part": part, "_row": row_in_part})
    )
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a running sum over the table of partition sizes.
    upto = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(upto, F.lit(0)).alias("_offset"))
    placed = ranged.join(offsets, "_part")
    return placed.withColumn(name, F.col("_offset") + F.col("_row")).drop("_part", "_row", "_offset")


def value_bucket(value: Column) -> Column:
    """Order-preserving bucket of a double: 256 steps per factor of two, each sign apart."""
    step = F.floor(F.log2(F.abs(value)) * 256) + 300_000
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * step).cast("long")


def group_median(
    df: DataFrame, keys: list[str], value: str, sizes: DataFrame, size_keys: list[str]
) -> DataFrame:
    """Exact median per group over ``n`` members, absent members counting as zero.

    ``sizes`` gives ``n`` per ``size_keys``. A bucket histogram finds the bucket
    of each middle rank; only rows in those buckets are ranked, after equal
    values are merged. No group is gathered as a whole.
    """
    present = df.filter(F.col(value) != 0)
    hist = present.groupBy(*keys, value_bucket(F.col(value)).alias("_b")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    per_group = hist.groupBy(*keys).agg(
        F.sum("_c").alias("_nnz"), F.sort_array(F.collect_list(F.struct("_b", "_c"))).alias("_h")
    )
    sized = attach(per_group, sizes, size_keys)
    zero = F.array(
        F.struct(F.lit(0).cast("long").alias("_b"), (F.col("n") - F.col("_nnz")).alias("_c"))
    )
    ranks = F.array(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2))
    running = sized.withColumn("_h", F.sort_array(F.concat("_h", zero))).withColumn(
        "_rank", F.explode(F.array_distinct(ranks))
    )
    acc0 = F.struct(
        F.lit(0).cast("long").alias("seen"),
        F.lit(None).cast("long").alias("b"),
        F.lit(None).cast("long").alias("before"),
    )

    def step(acc: Column, e: Column) -> Column:
        total = acc["seen"] + e["_c"]
        hit = acc["b"].isNull() & (total >= F.col("_rank"))
        return F.struct(
            total.alias("seen"),
            F.when(hit, e["_b"]).otherwise(acc["b"]).alias("b"),
            F.when(hit, acc["seen"]).otherwise(acc["before"]).alias("before"),
        )

    # At most two rows per group, read twice below.
    wanted = materialise(
        running.withColumn("_f", F.aggregate("_h", acc0, step))
        .select(*keys, "_rank", F.col("_f.b").alias("_b"), (F.col("_rank") - F.col("_f.before")).alias("_k"))
    )
    zeros = wanted.filter(F.col("_b") == 0).select(*keys, "_rank", F.lit(0.0).alias("_v"))
    targets = wanted.filter(F.col("_b") != 0)
    # Written, so that the planner knows its bytes: a small one is broadcast and the rows stay where they are.
    picks = materialise(targets.groupBy(*keys, "_b").agg(F.collect_list(F.struct("_rank", "_k")).alias("_want")))
    inside = attach(
        present.withColumn("_b", value_bucket(F.col(value))), picks, [*keys, "_b"]
    )
    merged = inside.groupBy(*keys, "_b", F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), F.first("_want").alias("_want")
    )
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v"))
    found = (
        merged.withColumn("_hi", upto)
        .select(*keys, "_v", "_hi", (F.col("_hi") - F.col("_c")).alias("_lo"), F.explode("_want").alias("_w"))
        .filter((F.col("_lo") < F.col("_w._k")) & (F.col("_w._k") <= F.col("_hi")))
        .select(*keys, F.col("_w._rank").alias("_rank"), "_v")
    )
    # One or two middle values per group.
    return zeros.unionByName(found).groupBy(*keys).agg(F.avg("_v").alias(value))

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from biomeframe.operators import split as sp
from biomeframe.operators.keyed import with_position


def labelled(spark, sizes):
    rows, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((i, label))
            i += 1
    return spark.createDataFrame(rows, "sampleID long, HC_subCST string"), rows


def brute(rows, sizes, seed):
    out = {}
    for label in {r[1] for r in rows}:
        ids = [r[0] for r in rows if r[1] == label]
        ids.sort(key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))
        cuts = [math.floor(len(ids) * (p / 100)) for p in sizes]
        for pos, i in enumerate(ids):
            k, acc = len(cuts), 0
            for j, c in enumerate(cuts):
                acc += c
                if pos < acc:
                    k = j
                    break
            out[i] = k + 1
    return out


@pytest.mark.parametrize("seed", [0, 1, 42])
@pytest.mark.parametrize("sizes", [[60], [80], [60, 20], [80, 10]])
def test_slices_match_the_sorted_order(spark, sizes, seed):
    df, rows = labelled(spark, {"one": 1, "two": 2, "five": 5, "seven": 7, "hot": 900})
    got = {r["sampleID"]: r["slice"] for r in sp.slice_of(df, sizes, seed).collect()}
    assert got == brute(rows, sizes, seed)


def test_names_follow_the_reference(spark):
    df, _ = labelled(spark, {"A": 50})
    count = lambda d: Counter(r["split"] for r in d.collect())
    assert count(sp.stratified_split(df, 60, 10)) == {"train": 30, "test": 5, "validation": 15}
    plain = sp.stratified_split(df, 60, 10, reference_naming=False)
    assert count(plain) == {"train": 30, "validation": 5, "test": 15}
    assert count(sp.stratified_split(df, 80)) == {"train": 40, "test": 10}


def test_null_class_is_a_stratum(spark):
    df = spark.createDataFrame([(i, None if i < 10 else "A") for i in range(20)], "sampleID long, HC_subCST string")
    got = sp.stratified_split(df, 50).groupBy("HC_subCST", "split").count().collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == [
        ("A", "test", 5), ("A", "train", 5), ("None", "test", 5), ("None", "train", 5)
    ]


def test_unlabelled_rounds_half_to_even_in_order(spark):
    df = spark.range(5).withColumnRenamed("id", "sampleID")
    got = {r["sampleID"]: r["split"] for r in sp.split_unlabelled(df, 50).collect()}
    assert [got[i] for i in range(5)] == ["train", "train", "test", "test", "test"]
    three = Counter(r["split"] for r in sp.split_unlabelled(df, 50, 30).collect())
    assert three == {"train": 2, "validation": 2, "test": 1}


def test_missing_class_passes_with_a_flag(spark):
    rows = [(0, "A", "train"), (1, "A", "test"), (2, "A", "train"), (3, "B", "train")]
    df = spark.createDataFrame(rows, "sampleID long, HC_subCST string, split string")
    audit = {(r["HC_subCST"], r["split"]): r for r in sp.split_audit(df, 0.01).collect()}
    lost = audit["B", "test"]
    assert lost["class_missing"] and lost["passes_reference"] and lost["abs_diff"] is None
    assert not audit["A", "test"]["passes_reference"]
    assert audit["A", "test"]["rel_pct_signed"] == pytest.approx((1 / 0.75 - 1) * 100)
    gate = {r["split"]: r for r in sp.check_split(df, 0.01).collect()}
    assert gate["test"]["offending"] == ["A"] and gate["test"]["class_missing"]
    assert all(r["passes"] for r in sp.check_split(df, -1).collect())
    text = {(r[0], r[1]): r["text"] for r in sp.tolerance_report(df).collect()}
    assert text["A", "test"] == "33.333333%"


def test_positions_are_global(spark):
    df = spark.range(1000).select(F.col("id").alias("sampleID"), (F.col("id") % 3).alias("k")).repartition(7)
    got = {(r["k"], r["sampleID"]): r["position"] for r in with_position(df, ["k", "sampleID"]).collect()}
    assert got == {key: i for i, key in enumerate(sorted(got))}


def test_permute_keeps_the_values(spark):
    df = spark.range(200).select(F.col("id").alias("sampleID"), (F.col("id") * 1.5).alias("value"))
    rows = sp.permute(df, seed=3).collect()
    assert sorted(r["permuted"] for r in rows) == sorted(r["value"] for r in rows)
    order = sorted(range(200), key=lambda i: hashlib.md5(f"3|{i}".encode()).hexdigest())
    assert all(r["permuted"] == order[r["sampleID"]] * 1.5 for r in rows)


def test_shuffle_is_seeded(spark):
    df = spark.range(30).withColumnRenamed("id", "sampleID")
    first = [r[0] for r in sp.shuffle(df, 1).collect()]
    assert first == [r[0] for r in sp.shuffle(df, 1).collect()] and first != sorted(first)

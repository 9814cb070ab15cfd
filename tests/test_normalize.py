import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from biomeframe.operators import aggregate as ag
from biomeframe.operators import keyed as ky
from biomeframe.operators import normalize as no
from biomeframe.operators import ranking as rk


def table(df, *keys, value="value"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_relative_abundance_policies(counts):
    zero = table(no.relative_abundance(counts), "sampleID", "taxon")
    assert zero["a", "flat"] == 0.5 and zero["e", "G_x"] == 0.0
    assert table(no.relative_abundance(counts, "null"), "sampleID", "taxon")["e", "G_x"] is None
    pseudo = table(no.relative_abundance(counts, "pseudocount"), "sampleID", "taxon")
    assert pseudo["e", "G_x"] == 1e-5 and pseudo["d", "flat"] == 0.5
    with pytest.raises(ValueError):
        no.relative_abundance(counts, "other")


def test_pseudocount_is_dense(counts):
    got = table(no.pseudocount_abundance(counts), "sampleID", "taxon")
    assert len(got) == 15 and got["c", "G_x"] == 1e-5 and got["e", "flat"] == 1e-5


def matrix(counts, samples):
    x = no.relative_abundance(counts)
    taxa, ids = ["G_x", "flat", "y z"], ["a", "b", "c", "d", "e"]
    cells = table(x, "sampleID", "taxon")
    return x, taxa, ids, np.array([[cells.get((i, t), 0.0) for t in taxa] for i in ids])


def test_moments_count_absent_as_zero(counts, samples):
    x, taxa, _, m = matrix(counts, samples)
    rows = {r["taxon"]: r for r in no.taxon_moments(x, samples).collect()}
    for j, t in enumerate(taxa):
        r, v = rows[t], m[:, j]
        assert r["n"] == 5 and r["nnz"] == (v > 0).sum()
        assert [r["mean"], r["sd_pop"], r["sd_samp"], r["min"], r["max"]] == pytest.approx(
            [v.mean(), v.std(), v.std(ddof=1), v.min(), v.max()]
        )


@pytest.mark.parametrize("method", ["zscore", "minmax", "stddev"])
def test_scaling_is_dense_and_exact(counts, samples, method):
    x, taxa, ids, m = matrix(counts, samples)
    want = {
        "zscore": (m - m.mean(0)) / m.std(0),
        "minmax": (m - m.min(0)) / (m.max(0) - m.min(0)),
        "stddev": m / m.std(0),
    }[method]
    got = table(no.scale(x, method, samples=samples), "sampleID", "taxon")
    assert len(got) == 15
    for i, s in enumerate(ids):
        for j, t in enumerate(taxa):
            assert got[s, t] == pytest.approx(want[i, j])


def test_constant_taxon_gives_nan_and_is_dropped_for_display(spark):
    df = spark.createDataFrame(
        [("a", "k", 0.5), ("b", "k", 0.5), ("a", "v", 0.1), ("b", "v", 0.4)], "sampleID string, taxon string, value double"
    )
    got = table(no.scale(df, "zscore"), "sampleID", "taxon")
    assert math.isnan(got["a", "k"]) and got["b", "v"] == pytest.approx(1.0)
    shown = no.zscore_taxa(df).collect()
    assert {r["taxon"] for r in shown} == {"v"} and {r["dropped"] for r in shown} == {1}
    assert sorted(r["z"] for r in shown) == pytest.approx([-math.sqrt(0.5), math.sqrt(0.5)])


def test_log_ratio(spark):
    df = spark.createDataFrame([("a", "t", 0.1), ("b", "t", 1.0), ("c", "t", 0.0)], "sampleID string, taxon string, value double")
    got = table(no.scale(df, "log_ratio", on_zero="null"), "sampleID", "taxon")
    assert got["a", "t"] == pytest.approx(-0.1) and got["b", "t"] == math.inf and got["c", "t"] is None
    with pytest.raises(PySparkException):
        no.scale(df, "log_ratio").collect()
    with pytest.raises(ValueError):
        no.scale(df, "rle")


def tmm_brute(m, trim_m=0.3, trim_a=0.05):
    m = m[:, (m > 0).any(0)]
    lib = m.sum(1)
    f75 = np.quantile(m, 0.75, axis=1) / lib
    ref = int(np.argmin(np.round(np.abs(f75 - f75.mean()), 12)))

    def average_rank(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    logs = []
    for k in range(len(m)):
        both = (m[k] > 0) & (m[ref] > 0)
        y, yr, n, nr = m[k][both], m[ref][both], lib[k], lib[ref]
        lr = np.round(np.log2((y / n) / (yr / nr)), 12)
        av = np.round(0.5 * np.log2(y * yr / (n * nr)), 12)
        var = (n - y) / (n * y) + (nr - yr) / (nr * yr)
        c = len(y)
        lo_m, lo_a = math.floor(c * trim_m), math.floor(c * trim_a)
        rm, ra = average_rank(lr), average_rank(av)
        keep = (rm >= lo_m + 1) & (rm <= c - lo_m) & (ra >= lo_a + 1) & (ra <= c - lo_a) & (var > 0)
        logs.append((lr[keep] / var[keep]).sum() / (1 / var[keep]).sum() if keep.any() else 0.0)
    logs = np.array(logs)
    return 2 ** (logs - logs.mean())


def test_tmm_against_brute_force(spark):
    rnd = random.Random(3)
    m = np.array([[rnd.choice([0, 0, rnd.randint(1, 50)]) + (j == 0) for j in range(25)] for _ in range(12)], float)
    m = m / m.sum(1, keepdims=True)
    rows = [(i, f"t{j:02}", float(m[i, j])) for i in range(12) for j in range(25) if m[i, j] > 0]
    df = spark.createDataFrame(rows, "sampleID int, taxon string, value double")
    got = {r["sampleID"]: r["factor"] for r in no.tmm_factors(df).collect()}
    want = tmm_brute(m)
    assert [got[i] for i in range(12)] == pytest.approx(list(want))
    scaled = table(no.scale(df, "tmm"), "sampleID", "taxon")
    assert scaled[0, "t00"] == pytest.approx(m[0, 0] / want[0])


def test_effort_z_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None)], "sampleID string, read_count double")
    got = table(no.effort_z(df), "sampleID", value="effort_z")
    assert got["a",] == pytest.approx(-math.sqrt(0.5)) and got["c",] is None


def test_median_centroid_against_numpy(spark):
    rnd = random.Random(11)
    rows, labels = [], []
    cells = {}
    for i in range(300):
        label = "big" if i % 10 else "small"
        labels.append((i, label))
        for t in ("p", "q", "r"):
            v = rnd.choice([0.0, 0.25, 0.25, rnd.random() * 10 ** rnd.randint(-6, 0), -rnd.random()])
            if t == "r":
                v = 0.0 if rnd.random() < 0.7 else rnd.random()
            cells.setdefault((label, t), []).append(v)
            if v != 0.0:
                rows.append((i, t, v))
    df = spark.createDataFrame(rows, "sampleID int, taxon string, value double")
    samples = spark.createDataFrame(labels, "sampleID int, HC_subCST string")
    got = table(ag.centroids(df, samples, "median"), "HC_subCST", "taxon")
    assert got.keys() == cells.keys()
    for key, values in cells.items():
        assert got[key] == pytest.approx(np.median(values), abs=1e-15)
    means = table(ag.centroids(df, samples), "HC_subCST", "taxon")
    assert means["big", "p"] == pytest.approx(np.mean(cells["big", "p"]))
    with pytest.raises(ValueError):
        ag.centroids(df, samples, "mode")


def test_attach_keeps_the_rows_side_and_runs_nothing(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    failing = dim.withColumn("v", F.raise_error(F.lit("ran")))
    for how in ("inner", "left", "left_semi", "left_anti"):
        ky.attach(rows, failing, "k", how)
        assert ky.attach(rows, dim, "k", how).count() == rows.join(dim, "k", how).count()
    with pytest.raises(ValueError):
        ky.attach(rows, dim, "k", "full")


def test_positions_are_exact(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("v"), "id").repartition(7)
    got = [tuple(r) for r in ky.with_position(df, ["v", "id"]).orderBy("position").collect()]
    assert [g[2] for g in got] == list(range(500)) and got == sorted(got, key=lambda g: (g[0], g[1]))


def test_moments_over_a_subset_ignore_the_other_samples(counts, samples):
    x = no.relative_abundance(counts)
    few = samples.filter(F.col("sampleID").isin("a", "b", "c"))
    inside = x.join(few.select("sampleID"), "sampleID", "left_semi")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(no.taxon_moments(x, few)) == key(no.taxon_moments(inside, few))
    for method in ("zscore", "minmax", "stddev"):
        assert str(key(no.scale(x, method, samples=few))) == str(key(no.scale(inside, method, samples=few)))
    assert max(r["prevalence"] for r in no.taxon_moments(x, few).collect()) <= 1


def test_weights_and_prevalence(samples):
    w = table(ag.class_weights(samples, ["I", "II", "III"]), "HC_subCST", value="weight")
    assert w == {("I",): 1.5, ("II",): 1.0, ("III",): 0.0}
    p = table(ag.class_prevalence(samples), "HC_subCST", value="prevalence")
    assert p == {("I",): 0.4, ("II",): 0.6}


def test_top_and_nonempty(spark, counts, samples):
    x = no.relative_abundance(counts)
    assert [r["taxon"] for r in rk.top_taxa(x, 2, "mean", samples).collect()] == ["flat", "y z"]
    # G_x and y z both occur in three samples: the normalised name decides.
    assert [r["taxon"] for r in rk.top_taxa(x, 9, "prevalence", samples).collect()] == ["flat", "G_x", "y z"]
    extra = counts.union(spark.createDataFrame([("a", "none", 0.0)], counts.schema))
    assert {r[0] for r in ag.nonempty_taxa(extra).select("taxon").collect()} == {"G_x", "y z", "flat"}
    assert ag.profile(counts, samples).first().asDict() == {"n_samples": 5, "n_features": 3, "n_classes": 2}

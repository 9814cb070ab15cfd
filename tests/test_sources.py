import pytest
from pyspark.sql import functions as F

from biomeframe.operators import frames as fr
from biomeframe.operators import sets as st
from biomeframe.session import materialise
from biomeframe.sources import readers as rd
from biomeframe.sources import writers as wr


def write(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def cells(long):
    return {(r["sampleID"], r["taxon"]): r["count"] for r in long.collect()}


def test_wide_layout_and_back(spark, tmp_path):
    path = write(tmp_path, "w.csv", 'sampleID,read_count,"G_x, sp",y,y,HC_subCST', "007,3,1,2,5,I", "b,4,,4.5,6,II")
    wide = rd.read_wide(spark, path)
    assert wide.columns == ["sampleID", "read_count", "G_x, sp", "y", "y.1", "HC_subCST"]
    assert wide.filter("sampleID = '007'").count() == 1
    long = rd.wide_to_long(wide)
    assert cells(long) == {
        ("007", "G_x, sp"): 1.0, ("007", "y"): 2.0, ("007", "y.1"): 5.0,
        ("b", "G_x, sp"): None, ("b", "y"): 4.5, ("b", "y.1"): 6.0,
    }
    assert {r["taxon"]: r["pos"] for r in long.collect()} == {"G_x, sp": 0, "y": 1, "y.1": 2}
    again = wr.to_wide(long.filter(F.col("count").isNotNull()), ["y", "G_x, sp"])
    assert {r["sampleID"]: (r["y"], r["G_x, sp"]) for r in again.collect()} == {"007": (2.0, 1.0), "b": (4.5, 0.0)}


def test_transposed_layout_with_a_label_line(spark, tmp_path):
    path = write(tmp_path, "t.csv", "name,s1,s2", "HC_subCST,I,II", "tax a,1,2", "tax b,0,3.5")
    long = rd.read_transposed(spark, path, meta_rows=["HC_subCST"])
    assert cells(long) == {("s1", "tax a"): 1.0, ("s2", "tax a"): 2.0, ("s1", "tax b"): 0.0, ("s2", "tax b"): 3.5}
    meta = rd.read_meta_rows(spark, path, ["HC_subCST"])
    assert {r["sampleID"]: r["HC_subCST"] for r in meta.collect()} == {"s1": "I", "s2": "II"}


def test_otu_supplement(spark, tmp_path):
    path = write(tmp_path, "o.csv", "Table S3. Title,,", "species,s1,s2", "tax a,1,2", "tax b,4,3")
    assert cells(rd.read_otu_supplement(spark, path)) == {
        ("s1", "tax a"): 1.0, ("s2", "tax a"): 2.0, ("s1", "tax b"): 4.0, ("s2", "tax b"): 3.0
    }


def test_ragged_tsv(spark, tmp_path):
    path = write(tmp_path, "r.tab", "Sample_1\tSample_2\ttaxID", "  tax a\t1\t2\t77", " tax b\t0\t5\t78")
    long, depth = rd.read_ragged_tsv(spark, path)
    assert cells(long) == {
        ("Sample_1", "tax a"): 1.0, ("Sample_2", "tax a"): 2.0, ("Sample_1", "tax b"): 0.0, ("Sample_2", "tax b"): 5.0
    }
    assert {r[0]: r[1] for r in depth.collect()} == {"Sample_1": 1.0, "Sample_2": 7.0}
    empty = write(tmp_path, "e.tab", "s1\ts2\ttaxID", "a\t1\t\t7")
    assert {r[0]: r[1] for r in rd.read_ragged_tsv(spark, empty)[1].collect()} == {"s1": 1.0, "s2": 0.0}


def test_taxon_lines(spark, tmp_path):
    path = write(tmp_path, "l.tsv", "Taxon_Name\tskip\ts1\ts2", "tax a\tq\t1\t2", "tax b\tq\t3\t4")
    assert cells(rd.read_taxon_lines(spark, path)) == {
        ("s1", "tax a"): 1.0, ("s2", "tax a"): 2.0, ("s1", "tax b"): 3.0, ("s2", "tax b"): 4.0
    }


def test_labelled_tsv(spark, tmp_path):
    path = write(tmp_path, "d.tsv", "\tfamily_id\trole\tdiagnosis_binary\ttax a", "s1\tF1\tchild\tASD\t2", "s2\tF2\tchild\tTD\t3")
    df = rd.read_tsv_labelled(spark, path)
    assert df.columns == ["sampleID", "HC_subCST", "tax a"]
    assert sorted(tuple(r) for r in df.collect()) == [("s1", "ASD", 2.0), ("s2", "TD", 3.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, "train"), ("b", 2.0, "test")], "sampleID string, n double, split string")
    wr.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    wr.write_splits(df, str(tmp_path / "splits"))
    back = spark.read.parquet(str(tmp_path / "splits"))
    only = back.filter("split = 'train'")
    assert [r["sampleID"] for r in only.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(split" in only._jdf.queryExecution().toString()
    wr.write_splits(df, str(tmp_path / "csvs"), fmt="csv")
    assert spark.read.csv(str(tmp_path / "csvs"), header=True).count() == 2
    cent = spark.createDataFrame([("I", "x", 0.5)], "HC_subCST string, taxon string, value double")
    assert wr.centroids_wide(cent, ["x", "y"]).first().asDict() == {"sub_CST": "I", "x": 0.5, "y": 0.0}


def test_materialise_uses_the_configured_folder(spark):
    df = materialise(spark.range(5))
    assert df.count() == 5 and df.inputFiles()[0].removeprefix("file://").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_canonicalise_roles(spark):
    wide = spark.createDataFrame([(3, 1, 2.0, None, "z"), (4, 2, 1.0, 5.0, "y")], "grp int, lab int, x double, y double, HC_CST string")
    plain = fr.canonicalise(wide.drop("grp"), sample=None, depth=None, label="lab", order_by=["x"])
    assert plain.columns[:2] == ["sampleID", "read_count"] and dict(plain.dtypes)["HC_subCST"] == "string"
    rows = {r["sampleID"]: r["read_count"] for r in plain.collect()}
    assert rows == {0: 6.0, 1: 2.0}
    with pytest.raises(ValueError):
        fr.canonicalise(wide, sample="absent")


def test_validation_and_order(spark):
    wide = spark.createDataFrame([("a", "I", 1.0)], "sampleID string, HC_subCST string, x double")
    assert fr.validate(wide, expect_labelled=False).columns == ["sampleID", "x"]
    assert fr.validate(wide, expect_labelled=True).columns == wide.columns
    with pytest.raises(ValueError):
        fr.validate(wide.drop("HC_subCST"), expect_labelled=True)
    with pytest.raises(ValueError):
        fr.order_columns(wide)
    ordered = fr.order_columns(wide.withColumn("read_count", F.lit(1.0)))
    assert ordered.columns == ["sampleID", "read_count", "HC_subCST", "x"]


def test_taxon_selection(spark, counts):
    assert {r[0] for r in fr.keep_taxa(counts, ["x", "FLAT"]).select("taxon").collect()} == {"G_x", "flat"}
    with pytest.raises(ValueError):
        fr.keep_taxa(counts, ["x", "nope"])
    assert {r[0] for r in fr.drop_taxa(counts, ["flat", "nope"]).select("taxon").collect()} == {"G_x", "y z"}
    assert {r[0] for r in fr.drop_taxa_regex(counts, ["^G", "t$"]).select("taxon").collect()} == {"y z"}
    projected = {r["taxon"]: r["idx"] for r in fr.project_taxa(counts, ["z", "x"]).collect()}
    assert projected == {"z": 0, "x": 1}
    order = fr.feature_dictionary(counts).orderBy("idx").collect()
    assert [r["taxon"] for r in order] == ["flat", "G_x", "y z"]


def test_duplicate_taxa(spark):
    df = spark.createDataFrame([("a", "Y", 1, 1.0), ("a", "y", 0, 2.0), ("a", "z", 2, 3.0)], "sampleID string, taxon string, pos int, count double")
    assert {r["taxon"] for r in fr.dedupe_taxa(df).collect()} == {"y", "z"}
    with pytest.raises(ValueError):
        fr.dedupe_taxa(df, "error")
    trimmed = fr.trim_taxa(df.withColumn("taxon", F.concat(F.col("taxon"), F.lit(" "))))
    assert {r["taxon"] for r in trimmed.collect()} == {"Y", "y", "z"}


def test_sets(spark, counts, samples):
    other = spark.createDataFrame([("q", "x", 1.0), ("q", "w", 1.0), ("q", "read_count", 1.0)], counts.schema)
    third = counts.withColumn("taxon", F.when(F.col("taxon") == "flat", "read_count").otherwise(F.col("taxon")))
    assert [r[0] for r in st.common_taxa(counts, other).collect()] == ["x"]
    assert [r[0] for r in st.common_taxa(other, counts).collect()] == ["x"]
    assert [r[0] for r in st.common_taxa(other, third, counts).collect()] == ["x"]
    stacked = st.stack(st.tag_cohort(counts, "one"), other.withColumn("extra", F.lit(2)))
    assert stacked.count() == 14 and stacked.filter("dataset IS NULL").count() == 3
    universe = {r[0]: r["in_both"] for r in st.label_universe(samples, samples.filter("HC_subCST = 'I'")).collect()}
    assert universe == {"I": True, "II": False}
    diff = {tuple(r) for r in st.schema_diff(counts, other, samples, samples).collect()}
    assert ("taxon", "w", "second") in diff and ("taxon", "flat", "first") in diff and len(diff) == 6


def test_cells_that_are_no_counts(spark, tmp_path):
    wide = write(tmp_path, "bad.csv", "sampleID,x,y,HC_subCST", "a,1,oops,I")
    with pytest.raises(Exception, match="(?i)malformed|oops"):
        rd.read_wide(spark, wide).collect()
    assert rd.read_wide(spark, wide, strict=False).first()["y"] is None
    lines = write(tmp_path, "bad.txt", "name,s1,s2", "tax,1,oops")
    with pytest.raises(Exception, match="not a count"):
        rd.read_transposed(spark, lines).collect()
    assert cells(rd.read_transposed(spark, lines, strict=False)) == {("s1", "tax"): 1.0, ("s2", "tax"): None}


def test_several_title_lines(spark, tmp_path):
    path = write(tmp_path, "two.csv", "A title", "by someone,here", "name,s1,s2", "tax,1,2")
    assert cells(rd.read_transposed(spark, path, skip_lines=2)) == {("s1", "tax"): 1.0, ("s2", "tax"): 2.0}


def test_very_many_samples_make_the_same_plan(spark, tmp_path):
    sizes = []
    for n in (3, 50_000):
        ids = [f"s{i}" for i in range(n)]
        lines = [",".join(["name", *ids]), ",".join(["tax", *["1"] * n]), ",".join(["other", *["2"] * (n - 1)])]
        long = rd.read_transposed(spark, write(tmp_path, f"broad{n}.csv", *lines))
        sizes.append(len(long._jdf.queryExecution().analyzed().toString()))
        got = long.groupBy("taxon").agg(F.count("*").alias("n"), F.sum("count").alias("s"), F.countDistinct("sampleID").alias("d"))
        assert {tuple(r) for r in got.collect()} == {("tax", n, n, n), ("other", n, 2 * (n - 1), n)}
    assert sizes[0] == pytest.approx(sizes[1], abs=200)


def test_quoted_fields_of_transposed_files(spark, tmp_path):
    path = write(tmp_path, "q.csv", '"a title, with comma"', '"name","s 1","s,2",,s3', '"tax ""a"", b","1",2,9,3', ",4,,9,6", "", 'c"d,7,"8",9,9', "short,1")
    assert cells(rd.read_otu_supplement(spark, path)) == {
        ("s 1", 'tax "a", b'): 1.0, ("s,2", 'tax "a", b'): 2.0, (None, 'tax "a", b'): 9.0, ("s3", 'tax "a", b'): 3.0,
        ("s 1", None): 4.0, ("s,2", None): None, (None, None): 9.0, ("s3", None): 6.0,
        ("s 1", 'c"d'): 7.0, ("s,2", 'c"d'): 8.0, (None, 'c"d'): 9.0, ("s3", 'c"d'): 9.0,
        ("s 1", "short"): 1.0, ("s,2", "short"): None, (None, "short"): None, ("s3", "short"): None,
    }
    long = '"' + "x" * 100_000 + '"'
    assert rd.read_transposed(spark, write(tmp_path, "l.csv", "n,s1", f"{long},1")).first()["taxon"] == "x" * 100_000


def test_repeated_counts_add_up(spark):
    long = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0)], "sampleID string, taxon string, count double")
    assert wr.to_wide(long, ["x", "y"]).first().asDict() == {"sampleID": "a", "x": 3.0, "y": 0.0}

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from biomeframe.functions import names as nm
from biomeframe.functions import scores as sc


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_norm_taxon(spark):
    names = ["G_Prevotella", "g__Rothia x", "x_y", "Lactobacillus iners", "__odd", "q", " _a", "ab_c", "k_"]
    want = ["prevotella", "rothia_x", "y", "lactobacillus_iners", "odd", "q", "a", "ab_c", ""]
    assert column(spark, names, "string", nm.norm_taxon("v")) == want


def test_norm_taxon_strict(spark):
    with pytest.raises(PySparkException):
        column(spark, ["q"], "string", nm.norm_taxon("v", strict=True))


def test_trims_and_tags(spark):
    assert column(spark, ["a  ", "a"], "string", nm.drop_trailing_blank("v")) == ["a ", "a"]
    assert column(spark, ["  a ", "a"], "string", nm.drop_leading_blanks("v")) == ["a ", "a"]
    tagged = nm.tag("v", "train")
    assert column(spark, ["III-A"], "string", tagged) == ["III-A train"]
    assert column(spark, ["III-A"], "string", nm.untag(tagged)) == ["III-A"]


def test_softmax_large_values(spark):
    (p,) = column(spark, [[1000.0, 1000.0, 0.0]], "array<double>", sc.softmax("v"))
    assert p == pytest.approx([0.5, 0.5, 0.0])


def test_argmax_first_wins(spark):
    assert column(spark, [[0.1, 0.7, 0.7], [3.0, 1.0, 2.0]], "array<double>", sc.argmax_index("v")) == [1, 0]
    labels = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert column(spark, [[0.1, 0.7, 0.7]], "array<double>", sc.argmax_label("v", labels)) == ["b"]


def test_choices_ties(spark):
    rows = [[0.2, 0.4, 0.4], [0.1, 0.2, 0.3]]
    assert column(spark, rows, "array<double>", sc.choices("v")) == [[1, 1, 0], [2, 1, 0]]
    assert column(spark, rows, "array<double>", sc.choices("v", "unique")) == [[1, 2, 0], [2, 1, 0]]


def test_entropy_policies(spark):
    rows = [[0.5, 0.5], [1.0, 0.0]]
    got = column(spark, rows, "array<double>", sc.entropy_signed("v"))
    assert got[0] == pytest.approx(-math.log(2)) and math.isnan(got[1])
    assert column(spark, rows, "array<double>", sc.entropy_signed("v", "zero"))[1] == 0.0


def test_clamp_and_ratio(spark):
    assert column(spark, [-9.0, 0.5, 9.0, None], "double", sc.clamp("v", -1, 1)) == [-1.0, 0.5, 1.0, None]
    got = column(spark, [1.0, -1.0, 0.0], "double", sc.ratio(F.col("v"), F.lit(0.0)))
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2])

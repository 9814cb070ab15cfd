import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from biomeframe.operators import metrics as me
from biomeframe.operators import ranking as rk
from biomeframe.operators import stats as ss
from biomeframe.operators.similarity import classify_centroid, score_columns

SCHEMA = "sampleID long, HC_subCST string, subCST string"


@pytest.fixture(scope="module")
def drawn(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("AAAB"), rnd.choice("ABC")) for i in range(400)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_confusion_is_zero_filled_and_complete(drawn):
    pairs, rows = drawn
    got = {(r[0], r[1]): r["n"] for r in me.confusion(pairs).collect()}
    assert len(got) == 9 and sum(got.values()) == 400 and got["C", "A"] == 0
    assert got["A", "C"] == sum(t == "A" and p == "C" for _, t, p in rows)
    wide = {r["HC_subCST"]: r["C"] for r in me.confusion_matrix(pairs, ["A", "B", "C"]).collect()}
    assert wide["A"] == got["A", "C"]


def test_weighted_metrics_by_hand(drawn):
    pairs, rows = drawn
    n = len(rows)
    want = dict.fromkeys(("precision", "recall", "f1"), 0.0)
    for c in "ABC":
        tp = sum(t == c and p == c for _, t, p in rows)
        support, guessed = sum(t == c for _, t, _ in rows), sum(p == c for _, _, p in rows)
        p, r = (tp / guessed if guessed else 0), (tp / support if support else 0)
        f = 2 * p * r / (p + r) if p + r else 0
        for key, v in zip(want, (p, r, f), strict=True):
            want[key] += v * support / n
    got = me.weighted_metrics(pairs).first()
    for key, v in want.items():
        assert got[key] == pytest.approx(v)
    assert got["accuracy"] == pytest.approx(got["recall"])
    assert me.accuracy(pairs).first()["accuracy"] == pytest.approx(100 * got["recall"])


def test_counted_pairs_score_alike(drawn):
    pairs, _ = drawn
    counted = me.cells(pairs)
    assert me.weighted_metrics(counted).first() == me.weighted_metrics(pairs).first()
    order = ["HC_subCST"]
    assert me.per_class_metrics(counted).orderBy(*order).collect() == me.per_class_metrics(pairs).orderBy(*order).collect()


def test_per_class_closed_forms(spark):
    rows = [(0, "A", "A"), (1, "A", "B"), (2, "B", "A"), (3, "B", "A")]
    got = {r["HC_subCST"]: r for r in me.per_class_metrics(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got["A"]["recall"], got["A"]["precision"], got["A"]["f1"]) == (0.5, 1.0, pytest.approx(2 / 3))
    assert (got["B"]["recall"], got["B"]["precision"], got["B"]["f1"]) == (0.0, 0.0, 0.0)


def test_roc_corners(spark):
    rows = [(0, "A", "A"), (1, "A", "A"), (2, "B", "A"), (3, "B", "B")]
    got = me.roc_points(spark.createDataFrame(rows, SCHEMA)).orderBy("HC_subCST", "point").collect()
    assert [(r[0], r["fpr"], r["tpr"]) for r in got] == [
        ("A", 0.0, 0.0), ("A", 0.5, 1.0), ("A", 1.0, 1.0), ("B", 0.0, 0.0), ("B", 0.0, 0.5), ("B", 1.0, 1.0)
    ]


def test_roc_class_never_guessed_has_two_points(spark):
    rows = [(0, "A", "A"), (1, "B", "A")]
    got = me.roc_points(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r["HC_subCST"] == "B" for r in got) == 2


def test_align_reports_and_raises(spark):
    truth = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B")], "sampleID long, HC_subCST string")
    pred = spark.createDataFrame([(2, "B"), (3, "A"), (3, "A"), (4, "A")], "sampleID long, subCST string")
    assert me.align_report(truth, pred).first().asDict() == {
        "n_matched": 2, "n_truth_only": 1, "n_pred_only": 1, "n_duplicated": 1
    }
    with pytest.raises(ValueError):
        me.align(truth, pred, strict=True)
    assert me.align(truth, pred).count() == 3


def test_difference_panel_and_misses(spark):
    a = spark.createDataFrame([(0, "A", "A"), (1, "B", "A")], SCHEMA)
    b = spark.createDataFrame([(0, "A", "B"), (1, "B", "A")], SCHEMA)
    diff = {(r[0], r[1]): r["diff"] for r in me.confusion_diff(a, b).collect()}
    assert diff == {("A", "A"): 1, ("A", "B"): -1, ("B", "A"): 0}
    panel = {(r["method"], r["share"]): r["accuracy"] for r in me.compare_methods(
        {("m", "60"): a, ("m", "80"): b}, ("method", "share")).collect()}
    assert panel == {("m", "60"): 0.5, ("m", "80"): 0.0}
    assert [r["miss"] for r in me.misclassified(a).collect()] == ["B:A"]


def test_rank_hits_with_ties(spark):
    rows = [(0, "b", [0.4, 0.4, 0.2]), (1, "c", [0.1, 0.2, 0.7]), (2, "a", [0.1, 0.6, 0.3])]
    df = spark.createDataFrame(rows, "sampleID long, HC_subCST string, scores array<double>")
    first = me.rank_hits(df, ["a", "b", "c"]).orderBy("rank").collect()
    assert [(r["rank"], r["hits"], r["cumulative"]) for r in first] == [(1, 1, 1), (2, 0, 1), (3, 1, 2)]
    unique = me.rank_hits(df, ["a", "b", "c"], rank_mode="unique").orderBy("rank").collect()
    assert [r["hits"] for r in unique] == [1, 1, 1]


def test_centroid_similarity_by_hand(spark):
    x = np.array([[0.5, 0.5, 0.0], [0.0, 0.2, 0.8]])
    c = {"I": [0.6, 0.4, 0.0], "II": [0.0, 0.0, 1.0]}
    df = spark.createDataFrame(
        [(i, f"t{j}", float(x[i, j])) for i in range(2) for j in range(3) if x[i, j]], "sampleID long, taxon string, value double"
    )
    cent = spark.createDataFrame(
        [(k, f"t{j}", v) for k, vs in c.items() for j, v in enumerate(vs) if v], "HC_subCST string, taxon string, value double"
    )
    got = {r["sampleID"]: r for r in classify_centroid(df, cent).collect()}
    for i in range(2):
        want = [float(x[i] @ np.array(v) / (x[i] @ x[i] + np.array(v) @ np.array(v) - x[i] @ np.array(v))) for v in c.values()]
        assert got[i]["scores"] == pytest.approx(want)
    assert [got[0]["subCST"], got[1]["subCST"]] == ["I", "II"]
    assert score_columns(classify_centroid(df, cent), ["I", "II"]).columns == ["sampleID", "subCST", "I_sim", "II_sim"]


def test_correlations_and_p_values(spark):
    rnd = random.Random(4)
    data = [(float(i), i * 0.5 + rnd.gauss(0, 6), rnd.gauss(0, 1) if i else None) for i in range(20)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = {(r["row"], r["column"]): r for r in ss.correlations(df, ["a", "b", "c"], digits=(6, 6)).collect()}
    m = np.array([r[:2] for r in data])
    assert got["a", "b"]["corr"] == pytest.approx(np.corrcoef(m.T)[0, 1], abs=1e-6)
    assert got["a", "c"]["n"] == 19
    # Published two-sided points of Student's t: t = 2.100922 at 18 degrees has p = 0.05.
    points = [(2.100922, 18, 0.05), (12.7062047, 1, 0.05), (2.5758293, 10**9, 0.01), (0.0, 7, 1.0), (1.0, 1, 0.5), (4.0, 2, 0.0571909584)]
    rows = [(t / (v + t * t) ** 0.5, v + 2, p) for t, v, p in points]
    table = spark.createDataFrame(rows, "r double, n long, want double")
    for r in table.withColumn("p", ss.correlation_p(F.col("r"), F.col("n"))).collect():
        assert r["p"] == pytest.approx(r["want"], abs=2e-8)
    odd = spark.createDataFrame([(1.0, 9), (-1.0, 9), (0.5, 2), (None, 9)], "r double, n long")
    assert [str(r[0]) for r in odd.select(ss.correlation_p(F.col("r"), F.col("n"))).collect()] == ["0.0", "0.0", "nan", "nan"]


def test_beta_tail_equals_exact_sums(spark):
    """For whole a and b the function is a sum of binomial terms."""
    rows = [(a, b, x) for a in (1, 2, 7, 40) for b in (1, 3, 25) for x in (0.0, 0.01, 0.3, 0.62, 0.99, 1.0)]
    table = spark.createDataFrame(rows, "a int, b int, x double")
    got = table.withColumn("v", ss.beta_tail(F.col("a").cast("double"), F.col("b").cast("double"), F.col("x"))).collect()
    for r in got:
        n = r["a"] + r["b"] - 1
        want = sum(math.comb(n, j) * r["x"] ** j * (1 - r["x"]) ** (n - j) for j in range(r["a"], n + 1))
        assert r["v"] == pytest.approx(want, abs=1e-12)


def brute_curves(rows, labels):
    out = {}
    for c, name in enumerate(labels):
        told = [(s[c], t == name) for t, s in rows if t is not None and s[c] is not None]
        p, n = sum(y for _, y in told), sum(not y for _, y in told)
        points = [(0, None, 0.0 if n else None, 0.0 if p else None)]
        for i, cut in enumerate(sorted({s for s, _ in told}, reverse=True), 1):
            fp, tp = sum(s >= cut and not y for s, y in told), sum(s >= cut and y for s, y in told)
            points.append((i, cut, fp / n if n else None, tp / p if p else None))
        won = sum((a > b) + 0.5 * (a == b) for a, x in told if x for b, y in told if not y)
        out[name] = (points, (p, n, won / (p * n) if p * n else None))
    return out


@pytest.mark.parametrize("parts", ["1", "7"])
def test_roc_from_scores_equals_brute_force(spark, parts):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), [float(rnd.randint(0, 8)) for _ in range(4)]) for _ in range(150)]
    rows += [(None, [1.0] * 4), ("a", [None, 2.0, 3.0, 4.0]), ("z", [9.0, 9.0, 9.0, 9.0])]
    labels = ["a", "b", "c", "never"]
    df = spark.createDataFrame(rows, "HC_subCST string, scores array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        curves, areas = me.roc_curves(df, labels).collect(), me.roc_auc(df, labels).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name, (points, area) in brute_curves(rows, labels).items():
        got = sorted(tuple(r)[1:] for r in curves if r["HC_subCST"] == name)
        assert got == points
        assert [tuple(r)[1:] for r in areas if r["HC_subCST"] == name] == [area]
    one = spark.createDataFrame([("a", [0.5])], "HC_subCST string, scores array<double>")
    assert me.roc_auc(one, ["a"]).first()["auc"] is None and me.roc_curves(one.limit(0), ["a"]).count() == 0


def test_entropy_columns(spark):
    df = spark.createDataFrame([(0, 0.25, 0.75)], "sampleID long, `Pct A` double, `Pct B` double")
    got = ss.assignment_entropy(df, ss.pct_columns(df)).first()
    h = 0.25 * np.log(0.25) + 0.75 * np.log(0.75)
    assert (got["h_signed"], got["h_norm"], got["shannon"]) == pytest.approx((h, h / np.log(2), -h))


def test_pick_best_takes_the_first_maximum(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.9)], "position int, accuracy double")
    assert rk.pick_best(df, "accuracy", "position").first()["position"] == 1
    ordered = rk.order_by_effect(spark.createDataFrame([("a", -3.0), ("b", 1.0), ("c", 2.0)], "taxon string, effect double"))
    assert [r["taxon"] for r in ordered.collect()] == ["a", "c", "b"]
    assert rk.preview(df.withColumn("o", -F.col("position")), 1, ["o"]).first()["position"] == 2


import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from biomeframe.operators import cluster as cl
from biomeframe.operators import explain as ex
from biomeframe.operators import learn as le
from biomeframe.operators import stored as sd
from biomeframe.operators import training as tr
from biomeframe.operators import vectors as ve
from biomeframe.operators.metrics import accuracy
from biomeframe.operators.normalize import relative_abundance
from biomeframe.operators.split import stratified_split
from biomeframe.plans import workflows as wf
from biomeframe.session import materialise
from biomeframe.streaming.score import read_rows, score_stream


@pytest.fixture(scope="module")
def halves(community):
    both = stratified_split(community[1], 60, seed=1)
    return [materialise(both.filter(F.col("split") == s).drop("split")) for s in ("train", "test")]


@pytest.fixture(scope="module")
def linear(community, halves):
    return le.fit(community[0], halves[0], "linear", maxIter=30)


def test_arrays_follow_the_dictionary(counts, samples):
    x = ve.merged_shares(counts)
    taxa = ve.taxa_list(counts)
    # "y z" becomes "y_z", whose first character counts as a prefix.
    assert taxa == ["flat", "x", "z"]
    got = {r["sampleID"]: r["features"] for r in ve.arrays(x, taxa, samples).collect()}
    assert got["d"] == [0.5, 0.5, 0.0] and got["e"] == [0.0, 0.0, 0.0] and got["c"] == [0.5, 0.0, 0.5]


def test_features_select_before_they_normalise(counts, samples):
    got = {r["sampleID"]: r["features"] for r in ve.features(counts, ["x", "z"], samples).collect()}
    assert got["b"] == [0.25, 0.75] and got["c"] == [0.0, 1.0] and got["e"] == [0.0, 0.0]
    scaled = {r["sampleID"]: r["features"] for r in ve.features(counts, ["x", "z"], samples, "zscore").collect()}
    m = np.array([[0.5, 0.5], [0.25, 0.75], [0.0, 1.0], [1.0, 0.0], [0.0, 0.0]])
    assert scaled["e"] == pytest.approx(list(((m - m.mean(0)) / m.std(0))[4]))


def test_same_normalised_names_are_merged(spark):
    df = spark.createDataFrame([("a", "g_x", 1.0), ("a", "X", 2.0), ("a", "f_y_z", 1.0)], "sampleID string, taxon string, count double")
    taxa = ve.taxa_list(df)
    ids = df.select("sampleID").distinct()
    assert taxa == ["x", "y_z"] and ve.features(df, taxa, ids).first()["features"] == [0.75, 0.25]


def test_label_index_and_one_hot(samples):
    rows = {r["sampleID"]: r for r in ve.index_labels(samples, ["I", "II", "III"], one_hot=True).collect()}
    assert rows["c"]["label_idx"] == 1.0 and list(rows["c"]["one_hot"].toArray()) == [0.0, 1.0, 0.0]


def test_hidden_size():
    assert le.hidden_size(199, 13) == 146 and le.hidden_size(3, 13, clamp=True) == 13
    assert le.hidden_size(6, 3, clamp=True) == 6


@pytest.mark.parametrize(
    "kind,weighted,options",
    [
        ("mlp", False, {"maxIter": 40}), ("mlp", True, {"maxIter": 40}), ("linear", True, {"maxIter": 20}),
        ("forest", False, {"numTrees": 10}), ("forest", True, {"numTrees": 10}),
    ],
)
def test_classifiers_separate_the_classes(community, halves, kind, options, weighted):
    train, test = halves
    model = le.fit(community[0], train, kind, class_weighted=weighted, **options)
    scored = le.classify(model, community[0], test.select("sampleID"))
    assert scored.count() == test.count()
    assert accuracy(test.join(scored, "sampleID")).first()["accuracy"] > 90
    one = scored.first()
    assert sum(one["scores"]) == pytest.approx(1.0) and one["subCST"] == model.labels[int(np.argmax(one["scores"]))]
    assert le.append_predictions(test, scored, model.labels).columns == [
        "sampleID", "HC_subCST", "subCST", "Pct C0", "Pct C1", "Pct C2"
    ]


def test_seeded_fits_agree(community, halves):
    train, test = halves
    runs = [
        sorted(map(str, le.classify(le.fit(community[0], train, "forest", numTrees=5, seed=4), community[0], test).collect()))
        for _ in range(2)
    ]
    assert runs[0] == runs[1]


def test_weighted_rows_balance_the_classes(spark):
    df = spark.range(900).select(
        F.col("id").alias("sampleID"), F.when(F.col("id") < 600, "big").otherwise("small").alias("HC_subCST")
    )
    got = {r[0]: r[1] for r in le.weighted_rows(df).groupBy("HC_subCST").count().collect()}
    assert got == {"big": 600, "small": 600}


def test_save_load_and_checks(spark, community, halves, linear, tmp_path):
    path = str(tmp_path / "m")
    le.save_model(linear, path)
    again = le.load_model(spark, path, list(reversed(linear.taxa)))
    rows = le.fit_table(community[0], halves[1], linear.taxa, linear.labels)[0]
    key = lambda m: sorted(map(str, le.predict(m, rows).select("sampleID", "subCST", "scores").collect()))
    assert key(again) == key(linear)
    info = le.model_info(spark, path).first()
    assert info["structure"] == "linear 6 -> 3" and info["n_features"] == 6 and info["labels"] == ["C0", "C1", "C2"]
    with pytest.raises(ValueError):
        le.load_model(spark, path, ["t0"])
    history = le.training_history(linear).orderBy("epoch").collect()
    assert history[0]["train_loss"] > history[-1]["train_loss"]


def test_permuted_columns_are_permutations(community):
    x = relative_abundance(community[0])
    rows = ve.arrays(x, ve.taxa_list(community[0]), community[1])
    got = ex.permuted_columns(rows, 6, seed=2).collect()
    before, after = np.array([r["features"] for r in got]), np.array([r["permuted"] for r in got])
    assert np.allclose(np.sort(before, 0), np.sort(after, 0))
    moved = [(before[:, j] != after[:, j]).mean() for j in range(6)]
    assert min(moved) > 0.5


def test_importance_finds_the_marker_taxa(community, halves, linear):
    rows = le.fit_table(community[0], halves[1], linear.taxa, linear.labels)[0]
    effects = {r["taxon"]: r["effect"] for r in ex.permutation_importance(linear, rows).collect()}
    assert min(effects[f"t{i}"] for i in range(3)) > max(effects[f"n{i}"] for i in range(3))
    by_class = ex.perturbation(linear, rows, ("recall",), by_class=True)
    assert by_class.count() == 18
    table = ex.perturbation_table(by_class, "recall", linear.labels)
    assert table.columns == ["feature", "C0", "C1", "C2"] and table.count() == 6
    whole = {r["taxon"]: r["effect"] for r in ex.perturbation(linear, rows, ("accuracy",)).collect()}
    assert {t: 100 * e for t, e in whole.items()} == pytest.approx(effects)


def test_simplified_model_without_a_taxon_at_the_threshold(spark, community, halves, linear):
    train, test = halves
    effects = spark.createDataFrame([("a", 0.2), ("b", -0.9), ("c", 0.2), ("d", None)], "taxon string, effect double")
    assert wf.important_taxa(effects) == ["a", "c"] and wf.important_taxa(effects, absolute=True) == ["b"]
    assert wf.important_taxa(effects, 0.1) == ["a", "c"] and wf.important_taxa(effects.limit(0)) == []
    small, importance = wf.fit_simplified(linear, community[0], train, (community[0], test), threshold=101.0, maxIter=5)
    assert small.taxa == wf.important_taxa(importance, importance.agg(F.max("effect")).first()[0])


def test_simplified_focus_best_and_grid(community, halves, linear):
    train, test = halves
    small, _ = wf.fit_simplified(linear, community[0], train, (community[0], test), threshold=5.0, maxIter=20)
    assert set(small.taxa) == {"t0", "t1", "t2"}
    focus = wf.fit_focus(community[0], train, ["t1", "t0"], maxIter=20)
    assert focus.taxa == ["t0", "t1"] and focus.params["hidden"] == 3
    rows, taxa, labels = le.fit_table(community[0], train)
    held = le.fit_table(community[0], test, taxa, labels)[0]
    model, results = le.fit_best(rows, held, taxa, labels, [1, 2], kind="forest", numTrees=3)
    chosen = results.filter("chosen").first()
    assert chosen["accuracy"] == results.agg(F.max("accuracy")).first()[0] and model.params["seed"] == chosen["seed"]
    grid = le.grid_search(community[0], train, community[0], test, [{"numTrees": 2}, {"numTrees": 6}], ["none", "minmax"], 2, "forest")
    assert grid.count() == 4 and grid.filter("accuracy > 60").count() == 4


def test_workflows(community, halves):
    counts, samples = community
    train, test = halves
    report = wf.evaluate(le.fit(counts, train, "linear", maxIter=20), counts, test)
    assert report["confusion"].agg(F.sum("n")).first()[0] == test.count()
    assert report["perturbation"].count() == 6 * 3 * 4
    panel, diff = wf.bakeoff(counts, train, test, {"linear": {"kind": "linear", "maxIter": 20}})
    assert {r["method"] for r in panel.collect()} == {"linear", "centroid"}
    assert panel.agg(F.min("f1")).first()[0] > 0.9 and diff.agg(F.sum("diff")).first()[0] == 0
    new = counts.filter("sampleID >= 90 AND taxon <> 'n2'")
    splits, own = wf.transfer_labels(counts.filter("sampleID < 90"), samples.filter("sampleID < 90"), new, kind="linear", maxIter=20)
    truth = samples.withColumnRenamed("HC_subCST", "t").join(splits, "sampleID")
    assert splits.count() == 60 and truth.filter("t = HC_subCST").count() > 54 and len(own.taxa) == 5
    # What the caller gets is stored: reading it classifies nothing anew.
    plan = splits._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "Join" not in plan and "Project" not in plan
    found, gates, panel = wf.discover_classes(counts, 3, kind="linear", maxIter=20)
    assert {r[0] for r in found.select("HC_subCST").distinct().collect()} == {"CST0", "CST1", "CST2"}
    assert gates.count() == 6 and panel.count() == 2


def silhouette_brute(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, c in enumerate(labels):
        own = [j for j, o in enumerate(labels) if o == c and j != i]
        if not own:
            out.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, [j for j, o in enumerate(labels) if o == k]].mean() for k in set(labels) - {c})
        out.append((b - a) / max(a, b))
    return out


def test_silhouette_over_several_blocks(spark):
    rng = np.random.default_rng(0)
    labels = ["a"] * 70 + ["b"] * 30 + ["c"]
    x = rng.normal(size=(101, 4)) + np.array([[3.0 * (c == "a"), 2.0 * (c == "b"), 0, 0] for c in labels])
    df = spark.createDataFrame([(i, labels[i], x[i].tolist()) for i in range(101)], "sampleID long, HC_subCST string, features array<double>")
    want = silhouette_brute(x, labels)
    for block_rows in (1000, 20):
        got = {r["sampleID"]: r["silhouette"] for r in cl.silhouette_samples(df, block_rows=block_rows).collect()}
        assert [got[i] for i in range(101)] == pytest.approx(want)
    assert cl.mean_silhouette(df).first()[0] == pytest.approx(np.mean(want))
    sizes = {r["HC_subCST"]: r["size"] for r in cl.sorted_silhouettes(cl.silhouette_samples(df)).collect()}
    assert sizes == {"a": 70, "b": 30, "c": 1}


def test_silhouette_blocks_hold_every_sample_once(spark):
    """What is shuffled are the samples and sums; as blocks get smaller, samples are not copied more often."""
    rng = np.random.default_rng(8)
    rows = [(i % 90 if i else None, f"c{i % 3}", rng.normal(size=2).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "sampleID long, cluster string, features array<double>")
    asked, names, sizes = cl._requests(df)
    blocks = cl._packed(asked, sizes, 10)
    found = [r for r in blocks.collect()]
    assert max(len(r["ids"]) for r in found) <= 10
    assert sorted(map(str, (i for r in found for i in r["ids"]))) == sorted(str(r[0]) for r in rows)
    sums = cl._block_sums(blocks, len(names))
    x, ids, own = np.array([r[2] for r in rows]), np.array([-1 if r[0] is None else r[0] for r in rows]), np.arange(100) % 3
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) * (ids[:, None] != ids[None])
    want = {}
    for i in range(100):
        for t in range(3):
            key = (rows[i][0], int(own[i]), t)
            want[key] = want.get(key, 0.0) + dist[i, own == t].sum()
    got = {(r["sampleID"], r["own"], r["t"]): r["s"] for r in sums.collect()}
    assert got == pytest.approx({k: want[k] for k in got}, abs=1e-6) and len(got) >= 2 * 90


def test_silhouette_bounds_skip_clusters_that_cannot_be_nearest(spark):
    rng = np.random.default_rng(6)
    # Four clusters on a line: of the others only the neighbours can be nearest.
    labels = [f"c{i % 4}" for i in range(160)]
    x = rng.normal(size=(160, 3)) * 0.3 + np.array([[10.0 * (i % 4), 0, 0] for i in range(160)])
    x[7] = x[3]
    df = spark.createDataFrame([(i, labels[i], x[i].tolist()) for i in range(160)], "sampleID long, HC_subCST string, features array<double>")
    for block_rows in (1000, 15):
        got = {r["sampleID"]: r["silhouette"] for r in cl.silhouette_samples(df, block_rows=block_rows).collect()}
        assert [got[i] for i in range(160)] == pytest.approx(silhouette_brute(x, labels))
    work = cl.silhouette_work(df).first()
    assert work["pairs"] == 160 * 160 and 0.3 < work["saved"] < 0.5
    # Labels without meaning: every cluster may be nearest, nothing is saved, the result stays exact.
    mixed = df.withColumn("HC_subCST", F.concat(F.lit("m"), F.pmod(F.xxhash64("sampleID"), F.lit(3)).cast("string")))
    names = [r["HC_subCST"] for r in mixed.orderBy("sampleID").collect()]
    got = {r["sampleID"]: r["silhouette"] for r in cl.silhouette_samples(mixed, block_rows=40).collect()}
    assert [got[i] for i in range(160)] == pytest.approx(silhouette_brute(x, names))
    assert cl.silhouette_work(mixed).first()["saved"] == 0.0
    one = df.filter("sampleID = 5")
    assert cl.silhouette_samples(one).first()["silhouette"] == 0.0 and cl.silhouette_samples(df.limit(0)).count() == 0
    same = cl.silhouette_samples(df.filter("HC_subCST = 'c1'"))
    assert same.count() == 40 and same.filter("silhouette <> 0").isEmpty()


def test_silhouettes_of_all_ks_take_each_distance_once(spark, monkeypatch):
    """One pass over the pairs of blocks serves every number of clusters, also where ids come again or are null."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(60, 3)) + 4 * np.eye(3)[c] for c in range(3)])
    ids = [None if i % 31 == 0 else i // 2 if i < 20 else i for i in range(len(x))]
    ids[170:] = [500] * 10
    rows = cl.with_vector(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "sampleID long, features array<double>")).repartition(3)
    rows = cl.materialise(rows)
    models = [cl.fit_kmeans(rows, k) for k in (2, 3, 5)]
    want = [cl.mean_silhouette(m.transform(rows).drop("vector"), "cluster").first()[0] for m in models]
    for block_rows in (1000, 7):
        assert cl.mean_silhouettes(rows, models, block_rows) == pytest.approx(want)
    met = []
    sums = cl._joint_sums
    monkeypatch.setattr(cl, "_joint_sums", lambda blocks, *a: met.append(blocks.count()) or sums(blocks, *a))
    monkeypatch.setattr(cl, "_block_sums", lambda *a: pytest.fail("distances are taken again for a number of clusters"))
    found = {r["k"]: r["silhouette"] for r in cl.silhouette(rows, range(2, 6)).collect()}
    assert len(met) == 1 and [found[k] for k in (2, 3, 5)] == pytest.approx(want)


def test_joint_sums_add_up_to_all_distances(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(50, 2))
    rows = cl.with_vector(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sampleID long, features array<double>"))
    models = [cl.fit_kmeans(rows, k) for k in (2, 4)]
    labels = [{r["sampleID"]: r["cluster"] for r in m.transform(rows).collect()} for m in models]
    blocks, size = cl._joint_blocks(rows, models, 8)
    assert size == 50 * 2 * 8
    starts, width = cl._columns(models)
    got = {}
    at = {r["at"]: r["ids"] for r in blocks.collect()}
    assert max(map(len, at.values())) <= 8 and sorted(i for b in at.values() for i in b) == list(range(50))
    for r in cl._joint_sums(blocks, size, starts, width).collect():
        for i, s in zip(at[r["at"]], np.frombuffer(r["s"]).reshape(-1, width), strict=True):
            got[i] = got.get(i, 0) + s
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(50):
        want = [sum(dist[i, j] for j in range(50) if found[j] == c) for found, k in zip(labels, (2, 4)) for c in range(k)]
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_bounds_hold_for_random_clusters():
    rng = np.random.default_rng(1)
    for _ in range(30):
        k, n = int(rng.integers(2, 7)), 60
        own = rng.integers(0, k, n)
        own[:k] = np.arange(k)
        x = rng.normal(size=(n, 4)) * rng.uniform(0.05, 2) + rng.normal(size=(k, 4))[own] * 2
        centres = np.array([x[own == c].mean(0) for c in range(k)])
        spread = np.array([((x[own == c] - centres[c]) ** 2).sum(1).mean() for c in range(k)])
        needed = cl.needed_clusters(x, own, centres, spread)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        means = np.array([[d[i, own == c].mean() if c != own[i] else np.inf for c in range(k)] for i in range(n)])
        assert needed[np.arange(n), means.argmin(1)].all() and needed[np.arange(n), own].all()


def test_clusters_elbow_and_axes(spark, community):
    rows, taxa = cl.cluster_rows(community[0])
    found = cl.cluster(rows, 3).join(community[1].withColumnRenamed("HC_subCST", "truth"), "sampleID")
    assert found.groupBy("HC_subCST", "truth").count().count() == 3
    x = np.array([r["features"] for r in rows.collect()])
    curve = [r["inertia"] for r in cl.elbow(rows, range(1, 5)).orderBy("k").collect()]
    assert curve[0] == pytest.approx(((x - x.mean(0)) ** 2).sum()) and curve[2] < curve[1] < curve[0]
    sil = {r["k"]: r["silhouette"] for r in cl.silhouette(rows, range(2, 5)).collect()}
    assert max(sil, key=sil.get) == 3
    assert cl.silhouette(rows, range(3, 4), exact=False).first()["silhouette"] > sil[3]
    centers = cl.centers(cl.fit_kmeans(rows, 3), taxa, spark)
    assert centers.count() == 18
    xy = np.array([(r["x"], r["y"]) for r in cl.coords(rows).collect()])
    top = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
    assert np.var(xy, axis=0, ddof=1) == pytest.approx(top)


def test_a_sample_scored_alone_gets_the_features_of_the_batch(community, halves):
    counts, _ = community
    train, test = halves
    for norm in ("zscore", "minmax", "stddev", "tmm"):
        model = le.fit(counts, train, "centroid", norm=norm)
        batch = {r["sampleID"]: r["scores"] for r in le.classify(model, counts, test.select("sampleID")).collect()}
        one = min(batch)
        alone = le.classify(model, counts.filter(F.col("sampleID") == one)).collect()
        assert alone[0]["scores"] == pytest.approx(batch[one], abs=1e-9)
        assert len(batch) == test.count()
    again = le.classify(model, counts, test.select("sampleID"), refit_scaling=True)
    assert again.count() == test.count()


def test_subset_features_equal_a_recomputation(community, halves):
    counts, _ = community
    train, _ = halves
    inside = counts.join(train.select("sampleID"), "sampleID", "left_semi")
    taxa = ve.taxa_list(counts)
    ids = train.select("sampleID")
    for norm in ("none", "zscore", "minmax", "stddev", "tmm"):
        got, want = (
            {r["sampleID"]: r["features"] for r in ve.features(c, taxa, ids, norm).collect()} for c in (counts, inside)
        )
        for k in want:
            np.testing.assert_allclose(got[k], want[k], atol=1e-12)
            assert np.isfinite(got[k]).all()


def test_features_that_cannot_be_scaled_raise(spark, community, halves):
    counts, samples = community
    flat = counts.union(samples.select("sampleID", F.lit("none").alias("taxon"), F.lit(0.0).alias("count")))
    with pytest.raises(ValueError, match="NaN"):
        le.fit(flat, halves[0], "centroid", norm="zscore")


def test_centroid_model_equals_numpy(community, halves, tmp_path, spark):
    counts, _ = community
    train, test = halves
    model = le.fit(counts, train, "centroid")
    rows = le.fit_table(counts, train, model.taxa, model.labels)[0].collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["HC_subCST"] for r in rows])
    means = np.array([x[y == c].mean(0) for c in model.labels])
    np.testing.assert_allclose(model.model.centroids, means)
    held = le.fit_table(counts, test, model.taxa, model.labels)[0]
    f = {r["sampleID"]: np.array(r["features"]) for r in held.collect()}
    le.save_model(model, str(tmp_path / "m"))
    for m in (model, le.load_model(spark, str(tmp_path / "m"), model.taxa)):
        for r in le.predict(m, held).collect():
            v = f[r["sampleID"]]
            theta = means @ v / (v @ v + (means * means).sum(1) - means @ v)
            np.testing.assert_allclose(r["scores"], theta)
            assert r["subCST"] == model.labels[int(np.argmax(theta))]


def test_repeated_rows_are_made_in_parts(spark, monkeypatch):
    monkeypatch.setattr(le, "COPIES", 4)
    rows = [(i, "big") for i in range(30)] + [(100, "rare"), (101, "mid"), (102, "mid")]
    train = spark.createDataFrame(rows, "sampleID long, HC_subCST string")
    n = {r["HC_subCST"]: r["count"] for r in le.weighted_rows(train).groupBy("HC_subCST").count().collect()}
    assert n == {"big": 30, "rare": 30, "mid": 30}


# ---------------------------------------------------------------- training in stages


@pytest.fixture(scope="module")
def noisy(spark):
    """Overlapping classes: a network that is trained too long gets worse on held-out samples."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        k = i % 3
        share = rng.dirichlet(np.where(np.arange(5) == k, 3.0, 1.6))
        rows += [(i, f"t{j}", float(v)) for j, v in enumerate(share)]
    counts = spark.createDataFrame(rows, "sampleID long, taxon string, count double")
    labels = spark.createDataFrame([(i, f"C{i % 3}") for i in range(240)], "sampleID long, HC_subCST string")
    both = stratified_split(labels, 60, seed=2)
    train, test = (materialise(both.filter(F.col("split") == s).drop("split")) for s in ("train", "test"))
    return tr.prepared(counts, train, counts, test), (counts, train, test)


def figures(model, held):
    scored = le.predict(model, held).collect()
    index = {c: i for i, c in enumerate(model.labels)}
    loss = np.mean([-np.log(r["scores"][index[r["HC_subCST"]]]) for r in scored])
    return loss, 100 * np.mean([r["HC_subCST"] == r["subCST"] for r in scored])


def test_the_best_stage_is_the_first_maximum(noisy):
    rows, held, taxa, labels, _ = noisy[0]
    model = tr.fit_best_stage(rows, held, taxa, labels, epochs=120, interval=10, seed=3)
    lines = le.training_history(model).orderBy("epoch").collect()
    scores = [r["accuracy"] for r in lines]
    assert [r["chosen"] for r in lines].index(True) == scores.index(max(scores)) and sum(r["chosen"] for r in lines) == 1
    assert [r["epoch"] for r in lines] == sorted({r["epoch"] for r in lines}) and lines[-1]["epoch"] <= 120
    assert all(a["train_loss"] >= b["train_loss"] for a, b in zip(lines, lines[1:], strict=False))
    # The kept weights are those of the chosen stage, not of the last one.
    chosen = next(r for r in lines if r["chosen"])
    assert figures(model, held) == pytest.approx((chosen["test_loss"], chosen["accuracy"]))


def test_stages_come_to_the_loss_of_one_long_fit(noisy):
    rows, held, taxa, labels, _ = noisy[0]
    staged = tr.fit_best_stage(rows, held, taxa, labels, epochs=200, interval=25, seed=3)
    long = le.fit_rows(rows, taxa, labels, "mlp", seed=3, maxIter=200)
    ends = [le.training_history(m).orderBy(F.desc("epoch")).first()["train_loss"] for m in (staged, long)]
    start = le.training_history(long).orderBy("epoch").first()["train_loss"]
    assert ends[0] < start and ends[0] == pytest.approx(ends[1], rel=0.1)
    # A single stage is a plain fit.
    one = tr.fit_best_stage(rows, held, taxa, labels, epochs=30, interval=30, seed=3)
    plain = le.fit_rows(rows, taxa, labels, "mlp", seed=3, maxIter=30)
    assert np.allclose(one.model.weights.toArray(), plain.model.weights.toArray())


def test_rates_fall_on_a_plateau_and_end_training(noisy):
    rows, held, taxa, labels, _ = noisy[0]
    run = tr.Run(rows, held, [len(taxa), 4, len(labels)], rate=1e-4, patience=1)
    run._stale, before = 0, run.rate
    run.history = [(1, -1.0, 0.0, 0.0)]  # no stage can have a smaller loss
    while not run.done:
        run.advance(1)
    assert run.rate <= tr.LEAST_RATE < before and len(run.history) == 3
    slow, fast = (tr.Run(rows, held, [len(taxa), 4, len(labels)], rate=r) for r in (1e-6, 0.5))
    for each in (slow, fast):
        each.advance(15)
        each.advance(15)
    assert fast.history[-1][1] < slow.history[-1][1]


def test_staged_models_are_stored_with_their_history(spark, noisy, tmp_path):
    (rows, held, taxa, labels, _), _ = noisy
    model = tr.fit_best_stage(rows, held, taxa, labels, epochs=20, interval=10, class_weighted=True)
    le.save_model(model, str(tmp_path / "m"))
    again = le.load_model(spark, str(tmp_path / "m"), taxa)
    assert le.training_history(again).collect() == le.training_history(model).collect()
    assert figures(again, held) == pytest.approx(figures(model, held))
    empty = tr.fit_best_stage(rows, held.limit(0), taxa, labels, epochs=10, interval=5)
    assert np.isnan(le.training_history(empty).first()["accuracy"])
    with pytest.raises(ValueError):
        tr.fit_best_stage(rows, held, taxa, labels, epochs=0)


def test_halving_goes_on_with_the_better_half(noisy):
    _, (counts, train, test) = noisy
    # Without a tolerance a stage takes all its steps.
    grid = [{"hidden": h, "rate": r, "tol": 0.0} for h in (3, 6) for r in (1e-3, 0.3)]
    got = tr.halving_search(counts, train, counts, test, grid, ["none", "zscore"], epochs=40, rounds=3).collect()
    assert [r["position"] for r in got] == list(range(8))
    assert sorted(r["round"] for r in got) == [1, 1, 1, 1, 2, 2, 3, 3]
    assert {r["round"]: r["epochs"] for r in got} == {1: 10, 2: 20, 3: 40}
    last, first = [[r["accuracy"] for r in got if r["round"] == k] for k in (3, 1)]
    assert max(last) >= max(first)
    # Keeping all cells is the full grid, whose figures do not depend on the rounds.
    whole = tr.halving_search(counts, train, counts, test, grid[:2], epochs=20, rounds=1, keep=1.0).collect()
    rows, held, taxa, labels, _ = noisy[0]
    for r, cell in zip(whole, grid, strict=False):
        run = tr.Run(rows, held, [len(taxa), cell["hidden"], len(labels)], rate=cell["rate"], tol=0.0)
        run.advance(20)
        assert r["accuracy"] == pytest.approx(run.history[0][3]) and r["epochs"] == 20


# ---------------------------------------------------------------- balanced samples


def test_balanced_rows_keep_the_size(spark):
    sizes = {"big": 900, "mid": 90, "rare": 1, "two": 2}
    rows = [(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)] + [("none", None)]
    df = spark.createDataFrame(rows, "sampleID string, HC_subCST string").withColumn("_times", F.lit(7))
    for seed in range(4):
        got = le.balanced_rows(df, seed=seed)
        assert got.columns == df.columns
        per = {r["HC_subCST"]: r["count"] for r in got.groupBy("HC_subCST").count().collect()}
        assert sum(per.values()) == 993 and all(abs(n - 993 / 4) <= 1 for n in per.values())
        each = [r["count"] for r in got.filter("HC_subCST = 'mid'").groupBy("sampleID").count().collect()]
        assert len(each) == 90 and set(each) <= {2, 3}
    small = {r["HC_subCST"]: r["count"] for r in le.balanced_rows(df, size=40).groupBy("HC_subCST").count().collect()}
    assert small == {"big": 10, "mid": 10, "rare": 10, "two": 10}
    assert sorted(le.balanced_rows(df).collect()) == sorted(le.balanced_rows(df.repartition(9)).collect())
    assert le.balanced_rows(df.limit(0)).count() == 0


def test_samples_of_a_class_are_drawn_alike(spark):
    """Over many seeds each sample is taken as often as its share says."""
    rows = [(i, "big") for i in range(30)] + [(100 + i, "small") for i in range(10)]
    df = spark.createDataFrame(rows, "sampleID long, HC_subCST string")
    taken = dict.fromkeys([r[0] for r in rows], 0)
    for seed in range(1, 25):
        for r in le.balanced_rows(df, seed=seed).collect():
            taken[r["sampleID"]] += 1
    means = {c: np.mean([taken[i] for i, k in rows if k == c]) / 24 for c in ("big", "small")}
    assert means == {"big": pytest.approx(20 / 30, abs=0.02), "small": pytest.approx(2.0, abs=0.02)}
    assert min(taken[i] for i in range(30)) >= 6


def test_a_rare_class_does_not_grow_the_table(community, halves):
    counts, _ = community
    one = halves[0].filter("HC_subCST = 'C0'").limit(1).union(halves[0].filter("HC_subCST <> 'C0'"))
    rows, taxa, labels = le.fit_table(counts, one)
    n = rows.count()
    assert le.network_rows(rows).count() == n < le.network_rows(rows, copies=True).count()
    model = le.fit_rows(materialise(rows), taxa, labels, "mlp", class_weighted=True, maxIter=20)
    held = le.fit_table(counts, halves[1], taxa, labels)[0]
    assert accuracy(le.predict(model, held)).first()["accuracy"] > 85


# ---------------------------------------------------------------- one folder per model


@pytest.mark.parametrize(
    "kind,norm,options",
    [("centroid", "tmm", {}), ("linear", "zscore", {"maxIter": 10}), ("forest", "minmax", {"numTrees": 5}), ("mlp", "none", {"maxIter": 10})],
)
def test_a_pipeline_model_scores_as_classify(community, halves, tmp_path, kind, norm, options):
    counts, _ = community
    train, test = halves
    model = le.fit(counts, train, kind, norm=norm, regex_remove=["n1"], **options)
    mine = counts.join(test.select("sampleID"), "sampleID", "left_semi")
    sd.save_pipeline(model, str(tmp_path / "m"))
    sd.save_pipeline(model, str(tmp_path / "m"))  # again, over the first
    again = PipelineModel.load(str(tmp_path / "m"))
    key = lambda df: {r["sampleID"]: (r["subCST"], r["scores"]) for r in df.collect()}
    got, want = key(again.transform(mine)), key(le.classify(model, mine))
    assert again.transform(mine).columns == le.classify(model, mine).columns
    assert got.keys() == want.keys() and len(got) == test.count()
    for i in want:
        assert got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=1e-12)
    one = mine.filter(F.col("sampleID") == next(iter(want)))
    assert key(again.transform(one)) == {k: (v[0], pytest.approx(v[1])) for k, v in want.items() if k == one.first()["sampleID"]}


# ---------------------------------------------------------------- streams


@pytest.mark.parametrize("kind,options", [("centroid", {}), ("forest", {"numTrees": 5})])
def test_a_stream_scores_as_a_batch_also_after_a_restart(spark, community, halves, tmp_path, kind, options):
    counts, _ = community
    train, test = halves
    model = le.fit(counts, train, kind, **options)
    rows = materialise(ve.features(counts, model.taxa, test.select("sampleID"), scaling=model.scaling))
    source, sink, place = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    seen = []
    for low in (0, 50, 100):
        rows.filter((F.col("sampleID") >= low) & (F.col("sampleID") < low + 50)).write.mode("append").parquet(source)
        stream = read_rows(spark, source, rows.schema, files_a_batch=1)
        score_stream(model, stream, sink, place).awaitTermination()
        seen.append(spark.read.parquet(sink).count())
    assert seen == sorted(seen) and seen[0] < seen[-1] == rows.count()
    key = lambda df: {r["sampleID"]: (r["subCST"], tuple(r["scores"])) for r in df.collect()}
    assert key(spark.read.parquet(sink)) == key(le.classify(model, counts, test.select("sampleID")))


# ---------------------------------------------------------------- coordinates by landmarks


def test_landmark_coordinates(spark):
    rng = np.random.default_rng(3)
    angle = rng.uniform(0, 2 * np.pi, 150)
    ring = np.where(np.arange(150) % 2 == 0, 1.0, 4.0)
    x = np.column_stack([ring * np.cos(angle), ring * np.sin(angle), rng.normal(size=150) * 0.05])
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(150)], "sampleID long, features array<double>")

    def coordinates(**how):
        return np.array([(r["x"], r["y"]) for r in sorted(cl.landmark_coords(df, **how).collect())])

    square = ((x[:, None] - x[None]) ** 2).sum(-1)
    kernel = np.exp(-square / np.median(square[np.triu_indices(150, 1)]))
    middle = np.eye(150) - 1 / 150
    values, axes = np.linalg.eigh(middle @ kernel @ middle)
    want = axes[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])
    exact = coordinates()
    assert np.abs(exact * np.sign((exact * want).sum(0)) - want).max() < 1e-8
    few = coordinates(landmarks=40)
    assert len(few) == 150 and (few == coordinates(landmarks=40)).all()

    def neighbours(c):
        return [set(np.argsort(((c - p) ** 2).sum(1))[1:11]) for p in c]

    agree = np.mean([len(a & b) / 10 for a, b in zip(neighbours(few), neighbours(exact), strict=True)])
    assert agree > 0.6
    assert cl.landmark_coords(df.limit(0)).count() == 0
    same = df.withColumn("features", F.array(*[F.lit(1.0)] * 3))
    assert {(r["x"], r["y"]) for r in cl.landmark_coords(same).collect()} == {(0.0, 0.0)}

"""Iterative operators: properties and planted structure."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayline.operators import boosting as B
from assayline.operators import trees
from assayline.operators.ensemble_outliers import RidgeLearner, _half_poisson, _uniform, outlier_samples
from assayline.operators.features import average_clusters, cluster_features, drop_correlated
from assayline.operators.impute import impute_mixture
from assayline.operators.mixture import FailedFit, fit_mixture, fit_mixtures, mixture_bic, score_mixture
from assayline.operators.pls import pls_cv, pls_cv_predict, pls_fit, r2_score
from assayline.operators.rbf import RbfPoint, rbf_cv
from assayline.operators.screening import ForestLearner, StumpLearner, affine, keep_relevant, relevant_features
from assayline.operators.search import (
    SearchResult,
    select_features_ga, select_features_rbf_ga, select_lags_ga, select_regions_ga,
)
from assayline.operators.split import train_test_split
from assayline.operators.topographic import (
    MapSpec, fit_map, fit_maps, map_grid, map_grid_search, map_positions, merge_clusters, responsibilities,
)
from assayline.plans import scans
from assayline.plans.moments import fit_moments, moment_table
from assayline.plans.ordered import shuffled_fold, with_folds


@pytest.fixture(scope="module")
def table(spark):
    """150 rows, eight features; y depends on x1, x4 and x6."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 8)) * np.arange(1, 9) + 100
    y = 2 * x[:, 1] - x[:, 4] + 0.5 * x[:, 6] + rng.normal(size=150) * 0.3
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(8)]).assign(id=range(150), y=y)
    return with_folds(spark.createDataFrame(pdf).repartition(5), ["id"], 5).cache()


FEATURES = [f"x{i}" for i in range(8)]


def test_moments_add_up(table):
    moments = fit_moments(table, FEATURES, "y", "fold", 5)
    pdf = table.toPandas()
    design = np.column_stack([np.ones(150), pdf[FEATURES] - moments.centre[:-1], pdf["y"] - moments.centre[-1]])
    assert np.allclose(moments.total, design.T @ design)
    assert moments.folds.shape == (5, 10, 10)
    long = moment_table(table, FEATURES[:2], "y").toPandas().set_index(["a", "b"])["value"]
    assert long["x0", "x1"] == pytest.approx((pdf["x0"] * pdf["x1"]).sum())
    assert long["1", "1"] == 150


def test_pls_predictions_agree_with_the_r2_table(table):
    scores = {r["components"]: r for r in pls_cv(table, FEATURES, "y", "fold", 5).collect()}
    for a in (1, 3, 8):
        predicted = pls_cv_predict(table, FEATURES, "y", "fold", 5, a)
        assert r2_score(predicted, "y", "predicted").first()["r2"] == pytest.approx(scores[a]["r2"], abs=1e-8)
    assert sum(r["is_best"] for r in scores.values()) == 1
    model = pls_fit(table, FEATURES, "y", 8)
    assert dict(zip(model.features, model.slopes))["x1"] == pytest.approx(2.0, abs=0.1)


def test_rank_limits_the_components(table):
    twice = table.withColumn("x1b", F.col("x1") * 3 - 1).withColumn("flat", F.lit(1.0))
    assert pls_cv(twice, ["x1", "x1b", "flat"], "y", "fold", 5).count() == 1


def test_searches_find_the_planted_features(table):
    found = select_features_ga(table, FEATURES, "y", "fold", population=30, generations=8)
    assert {"x1", "x4", "x6"} <= set(found.features) and found.score > 0.99
    log = found.generations.orderBy("generation").collect()
    assert len(log) == 9 and log[0]["evaluated"] <= 30 and found.best_ever >= found.score
    again = select_features_ga(table, FEATURES, "y", "fold", population=30, generations=8)
    assert again.features == found.features
    regions = select_regions_ga(table, FEATURES, "y", "fold", regions=2, max_width=6, population=20, generations=5)
    assert regions.score > 0.9
    kernel = select_features_rbf_ga(table, FEATURES, "y", "fold", population=6, generations=2, dimension=32)
    assert len(kernel.genome) == 11 and kernel.score > 0


def test_lag_search_finds_the_delay(spark):
    rng = np.random.default_rng(8)
    u, v = rng.normal(size=400), rng.normal(size=400)
    y = np.roll(u, 3) + 0.05 * rng.normal(size=400)
    pdf = pd.DataFrame({"t": range(400), "y": y, "u": u, "v": v})
    found = select_lags_ga(spark.createDataFrame(pdf), ["t"], "y", ["u", "v"], 6, regions=2, max_width=3, population=20, generations=6)
    assert "u_3" in found.features and found.score > 0.95


def test_kernel_regression_beats_a_line(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, size=(300, 2))
    pdf = pd.DataFrame({"id": range(300), "a": x[:, 0], "b": x[:, 1], "y": np.sin(2 * x[:, 0]) + x[:, 1] ** 2})
    df = with_folds(spark.createDataFrame(pdf), ["id"], 5)
    point = RbfPoint((0, 1), 256.0, 2.0**-6, 0.5)
    for passes in (0, 3):
        assert rbf_cv(df, ["a", "b"], "y", "fold", 5, [point], 100, passes)[0] > 0.97
    assert pls_cv(df, ["a", "b"], "y", "fold", 5).agg(F.max("r2")).first()[0] < 0.3


def test_outlier_samples(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.uniform(-0.1, 0.1, 200)
    y[:10] += 5
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(200), y=y))
    got = outlier_samples(df, "id", ["a", "b", "c"], "y", sub_models=25, rounds=10)
    assert {r["id"] for r in got.where("is_outlier_sample").collect()} == set(range(10))
    assert got.count() == 200


def test_bootstrap_weights_are_poisson():
    draws = _half_poisson(_uniform(np.arange(200_000), 7)) + _half_poisson(_uniform(np.arange(200_000), 8))
    assert draws.mean() == pytest.approx(1.0, abs=0.01) and draws.var() == pytest.approx(1.0, abs=0.02)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, s, size=(n, 2)) for c, s, n in ((-3, 0.5, 60), (0, 0.3, 90), (4, 0.8, 50))])
    return spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=range(200), true=np.repeat([0, 1, 2], [60, 90, 50])))


@pytest.mark.parametrize("kind", ["full", "tied", "diag", "spherical"])
def test_mixture(blobs, kind):
    likelihoods = [fit_mixture(blobs, ["a", "b"], 3, kind, starts=1, rounds=n).log_likelihood for n in (1, 2, 4, 8)]
    assert all(b >= a - 1e-6 for a, b in zip(likelihoods, likelihoods[1:]))
    model = fit_mixture(blobs, ["a", "b"], 3, kind)
    scored = score_mixture(blobs, ["id", "true"], ["a", "b"], model).toPandas()
    assert np.allclose(np.vstack(scored["probabilities"]).sum(axis=1), 1)
    assert scored.groupby("true")["cluster_number"].agg(lambda s: s.value_counts().iloc[0]).sum() >= 198
    assert scored["log_density"].sum() == pytest.approx(model.log_likelihood, abs=1e-3)


def test_bic_chooses_three(blobs):
    model, grid = mixture_bic(blobs, ["a", "b"], 5)
    assert model.components == 3 and grid.count() == 20 and grid.where("is_best").count() == 1
    models = fit_mixtures(blobs, ["a", "b"], [(1, "full")])
    x = blobs.select("a", "b").toPandas().to_numpy()
    assert np.allclose(models[(1, "full")].means[0], x.mean(axis=0))
    assert np.allclose(models[(1, "full")].covariances[0], np.cov(x.T, ddof=0), atol=1e-5)


def test_imputation(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=300)
    pdf = pd.DataFrame({"id": range(300), "a": a, "b": 2 * a + 0.01 * rng.normal(size=300), "c": rng.normal(size=300)})
    df = spark.createDataFrame(pdf)
    holes = df.select(
        "id", F.when(F.col("id") % 9 != 0, F.col("a")).alias("a"), F.when(F.col("id") % 7 != 0, F.col("b")).alias("b"), "c"
    )
    filled = impute_mixture(holes, ["a", "b"], 3, 2, ["full"])
    assert filled.columns == holes.columns and filled.count() == 300
    both = filled.join(holes.select("id", F.col("a").alias("a0"), F.col("b").alias("b0")), "id").join(
        df.select("id", F.col("b").alias("b1"), F.col("a").alias("a1")), "id").toPandas()
    known = both["a0"].notna()
    assert (both.loc[known, "a"] == both.loc[known, "a0"]).all()
    one = both["a0"].notna() & both["b0"].isna()
    assert (both.loc[one, "b"] - both.loc[one, "b1"]).abs().max() < 0.1
    assert both[["a", "b"]].notna().all().all()


def test_maps(blobs):
    rows = blobs.select("id", ((F.col("a")) / 3).alias("a"), (F.col("b") / 3).alias("b"), ((F.col("a") - F.col("b")) / 2).alias("c"))
    names, spec = ["a", "b", "c"], MapSpec(6, 3, 1.0, 0.01)
    rising = [fit_map(rows, names, spec, rounds=n).log_likelihood for n in (2, 5, 10, 20)]
    assert all(b > a for a, b in zip(rising, rising[1:]))
    model = fit_map(rows, names, spec, rounds=20)
    shares = responsibilities(rows, ["id"], names, model)
    assert shares.select(F.expr("abs(aggregate(responsibilities, 0D, (s, v) -> s + v) - 1) < 1e-9")).distinct().collect() == [(True,)]
    placed = map_positions(rows, ["id"], names, model).toPandas()
    steps = (placed["t1_mode"] + 1) * 5 / 2
    assert np.allclose(steps, steps.round()) and placed[["t1_mean", "t2_mean"]].abs().max().max() <= 1
    assert placed["log_density"].sum() == pytest.approx(fit_map(rows, names, spec, rounds=21).log_likelihood, rel=1e-6)
    best, grid = map_grid_search(rows, "id", names, [spec, MapSpec(4, 2, 0.5, 0.1)], 5, rounds=5)
    assert grid.where("is_best").count() == 1 and best.spec.nodes == grid.where("is_best").first()["nodes"]
    assert len(map_grid()) == 250 and len(map_grid(regularisers=[2.0**e for e in range(-4, 0)], sparse=True)) == 200


def test_shared_scans_equal_single_fits(blobs):
    specs = [MapSpec(4, 2, 1.0, 0.1), MapSpec(5, 3, 2.0, 0.1, sparse=True)]
    together = fit_maps(blobs, ["a", "b"], specs, rounds=6)
    for spec, model in zip(specs, together):
        assert np.allclose(fit_map(blobs, ["a", "b"], spec, rounds=6).means, model.means)


def test_merged_clusters(blobs):
    model = fit_map(blobs, ["a", "b"], MapSpec(6, 3, 1.0, 0.01, sparse=True), rounds=60)
    steps, labels = merge_clusters(blobs, ["id", "true"], ["a", "b"], model)
    table = steps.toPandas()
    assert table["clusters"].iloc[-1] == 1 and table["is_best"].sum() == 1
    assert (table["labels_used"] <= table["clusters"]).all()
    assert labels.select("cluster_number").distinct().count() == table.loc[table["is_best"], "labels_used"].iloc[0]


def test_correlated_features(table):
    wide = table.withColumn("copy", F.col("x2") + 0.001 * F.col("x3")).select("id", *FEATURES, "copy")
    kept = drop_correlated(wide, [*FEATURES, "copy"]).columns
    assert len(kept) == 9 and ("x2" in kept) != ("copy" in kept)
    clusters = cluster_features(wide, [*FEATURES, "copy"])
    assert clusters.where("not is_selected").select("feature").collect() == [("copy",)]
    assert average_clusters(wide, ["id"], clusters).columns == ["id", "x0", "x1", "mean_in_cluster_2", *FEATURES[3:]]


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 5))
    radius = (x**2).sum(axis=1)
    y = np.digitize(radius, np.quantile(radius, [1 / 3, 2 / 3]))
    pdf = pd.DataFrame(x, columns=list("abcde")).assign(id=range(400), y=y)
    vectors = B.as_vectors(spark.createDataFrame(pdf), "id", list("abcde"), "y")
    return tuple(part.cache() for part in train_test_split(vectors, "id"))


def test_split_is_whole(classes):
    train, test = classes
    assert train.count() + test.count() == 400 and train.join(test, "id").count() == 0
    assert 0.6 < train.count() / 400 < 0.8


def test_boosting_improves_on_one_tree(classes):
    train, test = classes
    single = B.tree_error(train, test).first()["error"]
    assert single < B.majority_error(train, test, "label").first()["error"]
    learners, votes = B.adaboost(train, train, "id", rounds=7)
    stages = [r["error"] for r in B.staged_scores(votes, "id").orderBy("round").collect()]
    assert stages[-1] < stages[0] and learners.count() == 7
    for r in learners.collect():
        assert r["weight"] == pytest.approx(np.log((1 - r["error"]) / r["error"]) + np.log(2))
    boosted = [r["error"] for r in B.gradient_boost(train, train, "id", rounds=6, rate=0.5).orderBy("round").collect()]
    assert boosted[-1] < boosted[0]


def test_screening_accepts_the_planted_features(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 6))
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(6)]).assign(id=range(400), y=(x[:, 0] + x[:, 2] > 0).astype(int))
    df = spark.createDataFrame(pdf).repartition(3)
    names = [f"f{i}" for i in range(6)]
    decisions = relevant_features(df, "id", names, "y", rounds=14, learner=ForestLearner(15))
    by_name = {r["feature"]: r for r in decisions.collect()}
    assert by_name["f0"]["decision"] == by_name["f2"]["decision"] == "accepted"
    assert all(by_name[f"f{i}"]["decision"] != "accepted" for i in (1, 3, 4, 5))
    assert {"f0", "f2"} <= set(keep_relevant(df, names, decisions).columns)


def test_shadows_are_shuffled_rows():
    for n in (1, 2, 3, 10, 97):
        orders = [affine(n, 1, r) for r in range(5)]
        assert all(sorted(o) == list(range(n)) for o in orders)
        assert n < 3 or len({tuple(o) for o in orders}) > 1


def test_screening_by_stumps(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 4))
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(id=range(300), y=(x[:, 1] > 0.3).astype(int))
    found = {r["feature"]: r["decision"] for r in relevant_features(spark.createDataFrame(pdf), "id", list("abcd"), "y", 20, StumpLearner()).collect()}
    assert found["b"] == "accepted" and "accepted" not in {found[c] for c in "acd"}


def test_shuffled_folds_are_balanced(spark):
    counts = [r["count"] for r in spark.range(5000).groupBy(shuffled_fold(["id"], 5, 9)).count().collect()]
    assert len(counts) == 5 and max(counts) < 1.15 * min(counts)


def test_selected_features_as_a_table(spark):
    df = spark.createDataFrame([(1, 0.5, [1.0, 2.0, 3.0]), (2, 0.7, [4.0, 5.0, 6.0])], "id long, y double, x array<double>")
    found = SearchResult(("x_2", "y"), 1.0, (), 1.0, df)
    assert found.selected(df, ["id"]).collect() == [(1, 3.0, 0.5), (2, 6.0, 0.7)]
    assert found.selected(df, ["id"]).columns == ["id", "x_2", "y"]


def test_failed_mixtures_are_reported(spark):
    df = spark.createDataFrame([(float(i), 1e200 * i) for i in range(20)], "a double, b double")
    with pytest.raises(FailedFit):
        fit_mixture(df, ["a", "b"], 2)


def _sizes_on_driver(monkeypatch):
    """Numbers that scans of packed rows bring to the driver, per model."""
    sizes, collected = [], scans.collect_sums

    def spy(sums):
        found = collected(sums)
        sizes.extend(len(v) for v in found.values())
        return found

    monkeypatch.setattr(scans, "collect_sums", spy)
    return sizes


def test_histograms_of_trees_stay_in_the_tasks(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(600, 5)).round(2)
    y = (x[:, 1] > 0).astype(int) + (x[:, 4] + x[:, 0] > 0.5)
    df = spark.createDataFrame(pd.DataFrame({"x": list(map(list, x)), "y": y})).repartition(4)
    splits = lambda model: sorted(map(tuple, model.splits(spark).collect()))
    sizes = _sizes_on_driver(monkeypatch)
    whole = [splits(fit(df, "x", "y", rounds=2, depth=2)) for fit in (trees.fit_adaboost, trees.fit_gradient_boost)]
    assert whole[0] and max(sizes) <= 2 * (3 + 2 * 3)  # per node: share, feature, cut and the sums of both sides
    monkeypatch.setattr(trees, "CHUNK", 2 * 64 * 9)  # two features and fewer at a time
    assert whole == [splits(fit(df, "x", "y", rounds=2, depth=2)) for fit in (trees.fit_adaboost, trees.fit_gradient_boost)]


def test_moments_of_sub_models_stay_in_the_tasks(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(300, 4))
    y = x @ [1.0, -2.0, 0.0, 3.0] + np.where(np.arange(300) % 50 == 0, 20.0, 0.0)
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "x": list(map(list, x)), "y": y})).repartition(4)
    sizes = _sizes_on_driver(monkeypatch)
    found = outlier_samples(df, "id", "x", "y", sub_models=8, rounds=3, width=1e6, learner=RidgeLearner()).where("is_outlier_sample")
    found.count()
    assert len(sizes) > 8 and max(sizes) == 5  # coefficients, sums of flags, or five numbers of a median

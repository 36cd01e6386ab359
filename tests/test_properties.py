"""Properties that hold for any input."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayline.functions import scalar as S
from assayline.functions.smoothing import savgol, window_weights
from assayline.operators.features import complete_linkage, dominated_features, dominant_rates, pairs_to_drop
from assayline.operators.pls import cross_validated_r2, pls_coefficients
from assayline.operators.reshape import block_of, explode_regions
from assayline.operators.scale import autoscale, fit_scaler
from assayline.operators.screening import binomial_tail
from assayline.operators.search import region_positions
from assayline.operators.topographic import merge_steps
from assayline.plans.scans import collect_sums, pack_rows, sum_over_rows

FEW = settings(max_examples=60, deadline=None)


@FEW
@given(st.integers(1, 4), st.integers(0, 2), st.lists(st.floats(-3, 3), min_size=5, max_size=5), st.integers(3, 8))
def test_window_weights_reproduce_polynomials(poly, deriv, c, half):
    window = 2 * half + 1
    polynomial = np.polynomial.Polynomial(c[: poly + 1])
    at = np.arange(window) - half
    want = polynomial.deriv(deriv)(at) if deriv else polynomial(at)
    assert np.allclose(window_weights(window, poly, deriv) @ polynomial(at), want, atol=1e-6 * half**4)


def correlations(seed, p):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, max(2, p // 2)))
    x = base[:, rng.integers(base.shape[1], size=p)] + rng.normal(size=(40, p)) * rng.uniform(0.01, 1, p)
    return np.corrcoef(x, rowvar=False)


@FEW
@given(st.integers(0, 10_000), st.integers(2, 10), st.sampled_from(["current", "all"]), st.floats(0.5, 0.99))
def test_no_pair_is_left(seed, p, scope, threshold):
    r = correlations(seed, p)
    gone = {int(n) for n in pairs_to_drop([str(i) for i in range(p)], r, threshold, scope)}
    kept = [i for i in range(p) if i not in gone]
    rest = np.abs(r[np.ix_(kept, kept)]) - np.eye(len(kept))
    assert len(kept) >= 1 and rest.max() < threshold


@FEW
@given(st.integers(0, 10_000), st.integers(2, 10), st.floats(0.5, 0.99))
def test_clusters_are_tight(seed, p, threshold):
    r = np.abs(correlations(seed, p))
    numbers = complete_linkage(r, threshold)
    firsts = [numbers.index(n) for n in sorted(set(numbers))]
    assert firsts == sorted(firsts) and set(numbers) == set(range(max(numbers) + 1))
    for i in range(p):
        for j in range(i):
            assert numbers[i] != numbers[j] or r[i, j] > threshold


@FEW
@given(st.lists(st.floats(0.001, 1), min_size=1, max_size=12))
def test_merging_keeps_the_sum(weights):
    mixing = np.array(weights) / sum(weights)
    steps = merge_steps(mixing)
    assert [int((s > 0).sum()) for s in steps] == list(range(len(weights), 0, -1))
    assert all(abs(s.sum() - 1) < 1e-9 for s in steps)


@FEW
@given(st.lists(st.tuples(st.floats(0, 30), st.floats(0, 12)), min_size=1, max_size=5))
def test_regions_stay_in_their_block(pairs):
    edges, width = [10, 20, 30], 30
    found = region_positions(np.array(pairs).ravel(), width, edges)
    want = set()
    for start, length in pairs:
        s = int(start)
        if s < width:
            want |= set(range(s, min(s + int(length), next(e for e in edges if s < e))))
    assert set(found) == want and len(found) == len(set(found))


@FEW
@given(st.integers(0, 40), st.integers(1, 40))
def test_binomial_tail(hits, rounds):
    hits = min(hits, rounds)
    assert binomial_tail(hits, rounds) + binomial_tail(rounds - hits + 1, rounds) == pytest.approx(1.0)


def moments_of(x, y):
    design = np.column_stack([np.ones(len(y)), x, y])
    return design.T @ design


def pls_by_rows(x, y, components):
    """Textbook deflation of the rows, for comparison."""
    mx, sx, my, sy = x.mean(0), x.std(0, ddof=1), y.mean(), y.std(ddof=1)
    e, f, weights, loadings, shares = (x - mx) / sx, (y - my) / sy, [], [], []
    for _ in range(components):
        w = e.T @ f
        w /= np.linalg.norm(w)
        t = e @ w
        p, q = e.T @ t / (t @ t), f @ t / (t @ t)
        e, f = e - np.outer(t, p), f - q * t
        weights.append(w), loadings.append(p), shares.append(q)
    w, p, q = np.array(weights).T, np.array(loadings).T, np.array(shares)
    b = w @ np.linalg.solve(p.T @ w, q) * sy / sx
    return my - mx @ b, b


@FEW
@given(st.integers(0, 10_000), st.integers(2, 6))
def test_moments_give_the_row_wise_fit(seed, p):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(30, p)) * rng.uniform(0.1, 5, p) + rng.normal(size=p)
    y = x @ rng.normal(size=p) + rng.normal(size=30)
    fitted = pls_coefficients(moments_of(x, y), p)
    folds = np.array_split(np.arange(30), 5)
    r2 = cross_validated_r2(np.array([moments_of(x[f], y[f]) for f in folds]), p)
    for a in range(1, p + 1):
        intercept, slopes = pls_by_rows(x, y, a)
        assert np.allclose(fitted[a - 1], np.append(intercept, slopes), atol=1e-6)
        error = 0.0
        for f in folds:
            rest = np.setdiff1d(np.arange(30), f)
            i, b = pls_by_rows(x[rest], y[rest], a)
            error += ((y[f] - i - x[f] @ b) ** 2).sum()
        assert r2[a - 1] == pytest.approx(1 - error / ((y - y.mean()) ** 2).sum(), abs=1e-6)
    assert np.allclose(fitted[-1][1:], np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0], atol=1e-6)


def test_scaling_round_trip(spark):
    pdf = pd.DataFrame({"id": range(5), "a": [1.0, 2.0, None, 4.0, 9.0], "b": [3.0] * 5})
    df = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    scaler = fit_scaler(df, ["a", "b"])
    back = scaler.unscale(scaler.autoscale(df)).orderBy("id").collect()
    assert [r["a"] for r in back] == pytest.approx([1.0, 2.0, None, 4.0, 9.0])
    assert all(r["b"] is None for r in autoscale(df, ["a", "b"]).collect())


def test_logit_outside_and_round_trip(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.001, 0.5, 0.999, 1.0, -1.0)], "v double")
    got = df.select("v", S.logit("v").alias("z")).select("v", "z", S.inverse_logit("z").alias("back")).collect()
    for r in got:
        assert (r["z"] is None) == (not 0 < r["v"] < 1)
        assert r["z"] is None or r["back"] == pytest.approx(r["v"])
    assert spark.range(1).select(S.inverse_logit(F.lit(-900.0))).first()[0] == 0.0


def test_savgol_arrays(spark):
    line = [2.0 * i + 1 for i in range(25)]
    df = spark.createDataFrame([(line,), (line[:5],)], "x array<double>")
    full, short = df.select(savgol(F.col("x"), 21, 2, 1).alias("d")).collect()
    assert full["d"] == pytest.approx([2.0] * 25) and short["d"] is None


def test_savgol_with_missing_values(spark):
    line = [float(i) for i in range(30)]
    hole = [*line[:15], None, *line[16:]]
    df = spark.createDataFrame([(0, line), (1, None), (2, hole), (3, line[:4]), (4, line[:11])], "id int, x array<double>")
    got = {r["id"]: r["d"] for r in df.select("id", savgol(F.col("x"), 5, 2).alias("d")).collect()}
    assert got[0] == pytest.approx(line) and got[4] == pytest.approx(line[:11]) and got[1] is None and got[3] is None
    assert [i for i, v in enumerate(got[2]) if v is None] == [13, 14, 15, 16, 17]


def test_packed_rows_give_the_same_sums(spark):
    df = spark.range(1000).select(
        F.array(F.col("id").cast("double"), F.lit(2.0)).alias("x"), F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("f")
    ).repartition(3)

    def statistic(batch):
        return {str(f): np.append(batch["x"][batch["f"] == f].sum(axis=0), batch["k"][batch["f"] == f].sum()) for f in (0, 1, 2)}

    packed = pack_rows(df)
    direct, blocks = collect_sums(sum_over_rows(df, statistic)), collect_sums(packed.sum(statistic))
    assert direct.keys() == blocks.keys() == {"0", "1", "2"}
    assert all(np.allclose(direct[m], blocks[m]) for m in direct)
    assert sum(v[2] for v in blocks.values()) == 499_500
    packed.unpersist()


def test_ranges(spark):
    df = spark.createDataFrame([(0, 2), (4, 0), (8, 5)], "s int, w int")
    assert sorted(r["index"] for r in explode_regions(df, F.col("s"), F.col("w"), 10).collect()) == [0, 1, 8, 9]
    blocks = spark.range(-1, 12).select("id", block_of("id", [3, 10]).alias("b")).collect()
    assert [r["b"] for r in blocks] == [None, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, None, None]
    sizes = df.select(F.size(S.index_range(F.col("s").cast("long"), (F.col("s") + F.col("w")).cast("long"))).alias("n")).collect()
    assert [r["n"] for r in sizes] == [2, 0, 5]
    grid = spark.range(1).select(S.linear_space(0.0, 1.0, 5).alias("l"), S.powers_of_two(-1, 3, 2).alias("p")).first()
    assert grid["l"] == pytest.approx([0, 0.25, 0.5, 0.75, 1]) and grid["p"] == [0.5, 2.0, 8.0]


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.95])
def test_dominated(spark, threshold):
    pdf = pd.DataFrame({"id": range(100)})
    df = spark.createDataFrame(pdf).select(
        *[F.when(F.col("id") < n, 7.0).otherwise(F.col("id").cast("double")).alias(f"c{n}") for n in (40, 50, 69, 70, 80, 94, 95, 100)],
        *[F.when(F.col("id") >= n, F.col("id").cast("double")).alias(f"n{n}") for n in (60, 85)],
    )
    rates = {r["feature"]: r["rate"] for r in dominant_rates(df, df.columns).collect()}
    assert dominated_features(df, df.columns, threshold) == [c for c in df.columns if rates[c] >= threshold]


def test_sums_of_many_tasks_reach_the_driver_once(spark):
    df = spark.range(3000).select((F.col("id") / 2).alias("v"), (F.col("id") % 2).cast("int").alias("f")).repartition(150)

    def statistic(batch):
        return {str(f): np.append(batch["v"][batch["f"] == f], 0.25).sum(keepdims=True).repeat(200_000) for f in (0, 1)}

    packed = pack_rows(df.select("v", "f"))
    for sums in (sum_over_rows(df, statistic), packed.sum(statistic)):
        assert sorted((r["model"], r["part"]) for r in sums.select("model", "part").collect()) == [("0", 0), ("0", 1), ("1", 0), ("1", 1)]
    found = packed.reduce(statistic, lambda model, sums: np.array([len(sums), sums[0], sums[-1], float(model)]))
    batches = packed.blocks.count()
    for f, total in (("0", 1_124_250.0), ("1", 1_125_000.0)):
        assert list(found[f]) == [200_000, total + batches / 4, total + batches / 4, float(f)]
    counts = collect_sums(packed.sum(lambda b: {"n": np.bincount(b["f"]), "big": np.array([70_000.0]), "signed": -b["v"].sum(keepdims=True)}))
    assert list(counts["n"]) == [1500, 1500] and counts["big"][0] == 70_000 * batches and counts["signed"][0] == -2_249_250
    assert packed.median(lambda b: b["v"]) == 749.75
    packed.unpersist()

"""Operators on a table with a hot key, a null key and many equal values, against direct definitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from assayline.operators import neighbours
from assayline.operators.neighbours import k3n_error, nearest_neighbours
from assayline.operators.outliers import hampel, savgol_hampel
from assayline.operators.signal import lag_table, smooth_series
from assayline.plans.joins import join_stats, split_join
from assayline.plans.ordered import row_positions, with_folds
from assayline.plans.quantiles import exact_median
from assayline.sources.tables import read_table


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one key, a null key, and many equal values."""
    rng = np.random.default_rng(1)
    key = [("hot" if i % 3 == 0 else None if i % 31 == 0 else f"k{i % 7}") for i in range(1500)]
    value = np.where(rng.random(1500) < 0.4, 2.5, rng.normal(size=1500).round(3))
    pdf = pd.DataFrame({"id": range(1500), "key": key, "value": value})
    return spark.createDataFrame(pdf).repartition(7).cache()


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_median(skewed, keys):
    direct = skewed.groupBy(*keys).agg(F.median("value").alias("median"))
    assert rows(exact_median(skewed, "value", keys)) == rows(direct)
    odd = skewed.where("id < 701").union(skewed.where("id < 3").withColumn("value", F.lit(None).cast("double")))
    assert rows(exact_median(odd, "value", keys)) == rows(odd.groupBy(*keys).agg(F.median("value").alias("median")))
    assert exact_median(skewed.where("id < 0"), "value", keys).count() == (0 if keys else 1)


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_positions(skewed, keys):
    by_key = Window.partitionBy(*[F.col(k) for k in keys])
    direct = skewed.withColumn("pos", F.row_number().over(by_key.orderBy("value", "id")).cast("long") - F.lit(1).cast("long"))
    direct = direct.withColumn("n", F.count("*").over(by_key))
    assert rows(row_positions(skewed, ["value", "id"], keys, total="n")) == rows(direct)


def test_folds(skewed):
    expected = skewed.withColumn("fold", (F.ntile(7).over(Window.orderBy("id")) - 1).cast("int"))
    assert rows(with_folds(skewed, ["id"], 7)) == rows(expected)
    sizes = [r["count"] for r in with_folds(skewed.where("id < 12"), ["id"], 5).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [3, 3, 2, 2, 2]


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_lags(skewed, keys):
    direct = lag_table(skewed, ["id"], "value", ["value"], 6, 2, keys)
    assert rows(lag_table(skewed, ["id"], "value", ["value"], 6, 2, keys, chunk_rows=8)) == rows(direct)
    for drop in ("any", "target", "none"):
        assert lag_table(skewed, ["id"], "value", ["value"], 6, 2, keys, drop=drop).count() == direct.count()


@pytest.mark.parametrize("deriv", [0, 1, 2])
def test_smoothing(skewed, deriv):
    direct = {r["id"]: r["smoothed"] for r in smooth_series(skewed, ["id"], "value", 15, 3, deriv, ["key"], chunk_rows=10_000).collect()}
    cut = {r["id"]: r["smoothed"] for r in smooth_series(skewed, ["id"], "value", 15, 3, deriv, ["key"], chunk_rows=20).collect()}
    assert direct.keys() == cut.keys()
    assert max(abs(direct[i] - cut[i]) for i in direct) < 1e-9


def test_flags(skewed):
    found = {r["id"]: (r["key"], r["value"], r["is_outlier"]) for r in hampel(skewed, "value", ["key"]).collect()}
    for key in {k for k, _, _ in found.values()}:
        values = np.array([v for k, v, _ in found.values() if k == key])
        reach = 3 * 1.4826 * np.median(np.abs(values - np.median(values)))
        assert all(flag == (abs(v - np.median(values)) > reach) for k, v, flag in found.values() if k == key)
    a = savgol_hampel(skewed, ["id"], "value", ["key"], 11).select("id", "is_outlier")
    b = savgol_hampel(skewed, ["id"], "value", ["key"], 11, chunk_rows=30).select("id", "is_outlier")
    assert rows(a) == rows(b)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins(skewed, how):
    stats = skewed.where("key is null or key <> 'k1'").groupBy("key").agg(F.avg("value").alias("m"))
    direct = join_stats(skewed, stats, ["key"], how)
    assert rows(join_stats(skewed, stats, ["key"], how, broadcast_rows=1)) == rows(direct)
    assert rows(split_join(skewed, stats, ["key"], how, heavy_rows=300, max_heavy_keys=100)) == rows(direct)


def brute_force(points, k):
    out = {}
    for i, p in points.items():
        near = sorted((float(np.sqrt(((np.array(p) - np.array(q)) ** 2).sum())), j) for j, q in points.items() if j != i)[:k]
        out[i] = [(j, round(d, 9)) for d, j in near]
    return out


@pytest.mark.parametrize("block_rows", [25, 2048])
def test_neighbours_with_copies(spark, block_rows):
    rng = np.random.default_rng(3)
    points = {i: [0.5, 0.5] if i % 3 == 0 else rng.normal(size=2).round(2).tolist() for i in range(180)}
    df = spark.createDataFrame(list(points.items()), "id long, x array<double>")
    found = nearest_neighbours(df, "id", "x", 4, block_rows=block_rows).orderBy("id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r["id"], []).append((r["neighbour"], round(r["distance"], 9)))
    assert got == brute_force(points, 4)


def test_neighbour_error_of_the_same_space(spark, folder):
    df = read_table(spark, folder, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("a"))
    assert k3n_error(df.withColumn("b", F.transform("a", lambda v: v * 2)), "vec_id", "a", "b", 5) == pytest.approx(0, abs=1e-9)


def test_a_visit_without_any_pair_within_its_bound():
    a, b = np.zeros((3, 2)), np.full((5, 2), 9.0)
    assert [len(part) for part in neighbours._within(a, b, 2, np.ones(3))] == [0, 0, 0]


def test_rows_that_visit_nearly_all_blocks_visit_several_at_once(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(1500, 12))
    df = spark.createDataFrame(pd.DataFrame({"id": range(1500), "x": list(map(list, x))}))
    chosen, choose = [], neighbours._together
    monkeypatch.setattr(neighbours, "_together", lambda *given: chosen.append(choose(*given)) or chosen[-1])
    for name, value in (("BLOCK_ROWS", 256), ("HOST_BYTES", 1), ("QUERY_ROWS", 128)):
        monkeypatch.setattr(neighbours, name, value)
    found = nearest_neighbours(df, "id", "x", 4, block_rows=32).orderBy("id", "rank").collect()
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    assert chosen[0] > 1
    assert [r["neighbour"] for r in found] == apart.argsort(1, kind="stable")[:, :4].ravel().tolist()


def test_narrow_rows_have_a_leaf_for_every_block(spark, monkeypatch):
    assert neighbours._most_pivots(54_000_000, 3, 256) ** 2 >= 54_000_000 // 256
    assert neighbours._most_pivots(54_000_000, 4096, 256) == neighbours.MAX_PIVOTS
    monkeypatch.setattr(neighbours, "MAX_PIVOTS", 2)
    made, make = [], neighbours._cells_of
    monkeypatch.setattr(neighbours, "_cells_of", lambda *given: made.append(make(*given)) or made[-1])
    x = np.random.default_rng(8).normal(size=(800, 3))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>")
    found = nearest_neighbours(df, "id", "x", 4, block_rows=20).orderBy("id", "rank").collect()
    assert len(made[0].counts) > 2 * 2
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    assert [r["neighbour"] for r in found] == np.argsort(apart, axis=1, kind="stable")[:, :4].ravel().tolist()

"""Queries for least squares, mixtures, imputation, maps, neighbours, searches and ensembles.

Maps, mixtures, imputation, sweeps and searches run here with few rounds and small grids; the defaults
of these operators are larger.  Boosting, screening and outlier samples run at full size.
"""

from __future__ import annotations

from functools import lru_cache
from math import log, pi

from pyspark.ml.functions import vector_to_array
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from assayline.catalog.registry import query, rounded, sql_rounded
from assayline.operators import boosting as B
from assayline.operators import trees as T
from assayline.operators.ensemble_outliers import RidgeLearner, outlier_samples
from assayline.operators.features import spread_array
from assayline.operators.impute import impute_mixture
from assayline.operators.mixture import (
    density_grid, fit_mixture, mixture_bic, mixture_probabilities, score_mixture,
)
from assayline.operators.neighbours import embedding_sweep, k3n_error, k3n_terms, nearest_neighbours, principal_embedding
from assayline.operators.pls import pls_cv, pls_cv_predict, pls_fit
from assayline.operators.rbf import RbfPoint, rbf_cv
from assayline.operators.scale import autoscale
from assayline.operators.screening import StumpLearner, relevant_features
from assayline.operators.search import (
    select_features_ga, select_features_rbf_ga, select_lags_ga, select_lags_rbf_ga, select_regions_ga,
    select_regions_rbf_ga,
)
from assayline.operators.split import train_test_split
from assayline.operators.topographic import (
    MapSpec, fit_map, map_grid_search, map_positions, merge_clusters, responsibilities,
)
from assayline.plans.ordered import with_folds
from assayline.sources.tables import hyperparameter_table, read_table

r = sql_rounded
DIMENSIONS = [f"embedding_{i}" for i in range(64)]


def _planted(spark, folder, width: int = 64):
    """Embedding dimensions with a target made of five of them, and contiguous folds."""
    e = "embedding"
    y = F.expr(f"2 * {e}[3]::double - {e}[10]::double + 0.5 * {e}[20]::double + {e}[33]::double - {e}[50]::double")
    rows = read_table(spark, folder, "embeddings").withColumn("y", y)
    wide = spread_array(rows, "embedding", ["vec_id", "label", "y"])
    return with_folds(wide.select("vec_id", "label", "y", *DIMENSIONS[:width]), ["vec_id"], 5).persist()


# ---- partial least squares ------------------------------------------------------------------

_PLANTED = (
    "2 * embedding[4]::DOUBLE - embedding[11]::DOUBLE + 0.5 * embedding[21]::DOUBLE + embedding[34]::DOUBLE - embedding[51]::DOUBLE"
)


def _one_component_sql(dims: tuple[int, ...], tag: str = "") -> str:
    """CTEs ending in ``p{tag}`` (vec_id, y, z): held-out predictions of one-component partial least squares."""
    scaled = {j: f"((x{j} - m{j}) / s{j})" for j in dims}
    score = " + ".join(f"w{j} * {scaled[j]}" for j in dims)
    d, f, st, c, w, q = (n + tag for n in ("d", "f", "st", "c", "w", "q"))
    return (
        f"{d} AS (SELECT vec_id, ntile(5) OVER (ORDER BY vec_id) - 1 AS fold, "
        + ", ".join(f"embedding[{j}]::DOUBLE AS x{j}" for j in dims) + f", {_PLANTED} AS y FROM embeddings), "
        f"{f} AS (SELECT unnest(range(5)) AS k), "
        f"{st} AS (SELECT k, avg(y) AS my, stddev_samp(y) AS sy, " + ", ".join(f"avg(x{j}) AS m{j}, stddev_samp(x{j}) AS s{j}" for j in dims)
        + f" FROM {d} JOIN {f} ON fold <> k GROUP BY k), "
        f"{c} AS (SELECT k, " + ", ".join(f"sum({scaled[j]} * (y - my) / sy) AS c{j}" for j in dims) + f" FROM {d} JOIN {st} ON fold <> k GROUP BY k), "
        f"{w} AS (SELECT k, " + ", ".join(f"c{j} / sqrt({' + '.join(f'c{i} * c{i}' for i in dims)}) AS w{j}" for j in dims) + f" FROM {c}), "
        f"{q} AS (SELECT k, sum(t * u) / sum(t * t) AS q FROM (SELECT {st}.k AS k, {score} AS t, (y - my) / sy AS u FROM {d} JOIN {st} ON fold <> {st}.k "
        f"JOIN {w} ON {w}.k = {st}.k) GROUP BY k), "
        f"p{tag} AS (SELECT vec_id, y, my + sy * q * ({score}) AS z FROM {d} JOIN {st} ON fold = {st}.k JOIN {w} ON {w}.k = {st}.k JOIN {q} ON {q}.k = {st}.k)"
    )


def _least_squares_sql(a: int, b: int, tag: str = "") -> str:
    """CTEs ending in ``p{tag}`` (vec_id, y, z): held-out predictions of least squares on two dimensions."""
    d, s = "d" + tag, "s" + tag
    return (
        f"{d} AS (SELECT vec_id, ntile(5) OVER (ORDER BY vec_id) - 1 AS fold, embedding[{a}]::DOUBLE AS a, embedding[{b}]::DOUBLE AS b, {_PLANTED} AS y FROM embeddings), "
        f"{s} AS (SELECT k, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, "
        f"covar_pop(b, y) AS by_ FROM {d} JOIN (SELECT unnest(range(5)) AS k) ON fold <> k GROUP BY k), "
        f"p{tag} AS (SELECT vec_id, y, my + (ay * bb - by_ * ab) / (aa * bb - ab * ab) * (a - ma) + (by_ * aa - ay * ab) / (aa * bb - ab * ab) * (b - mb) AS z "
        f"FROM {d} JOIN {s} ON fold = k)"
    )


_PLS = _one_component_sql((1, 2, 3, 4))
_R2 = "1 - sum((y - z) * (y - z)) / (var_pop(y) * count(*))"


@query("pls_two_components", f"WITH {_least_squares_sql(4, 11)} SELECT vec_id, {r('z')} AS predicted FROM p")
def pls_two_components(spark, folder):
    rows = _planted(spark, folder)
    predicted = pls_cv_predict(rows, ["embedding_3", "embedding_10"], "y", "fold", 5, 2)
    return predicted.select("vec_id", rounded("predicted").alias("predicted"))


# with two features every possible set is met, so the best score ever seen is the best of all four fits
@query(
    "ga_best_score",
    "WITH " + ", ".join([
        _one_component_sql((4,), "1"), _one_component_sql((11,), "2"), _one_component_sql((4, 11), "3"), _least_squares_sql(4, 11, "4"),
    ]) + f" SELECT {r('max(r2)', 8)} AS best_ever FROM (" + " UNION ALL ".join(f"SELECT {_R2} AS r2 FROM p{i}" for i in range(1, 5)) + ")",
)
def ga_best_score(spark, folder):
    found = select_features_ga(_planted(spark, folder), ["embedding_3", "embedding_10"], "y", "fold", **_SMALL)
    return spark.createDataFrame([(found.best_ever,)], "best_ever double").select(rounded("best_ever", 8).alias("best_ever"))


@query("pls_one_component", f"WITH {_PLS} SELECT vec_id, {r('z')} AS predicted FROM p")
def pls_one_component(spark, folder):
    rows = _planted(spark, folder, 4)
    predicted = pls_cv_predict(rows, DIMENSIONS[:4], "y", "fold", 5, 1)
    return predicted.select("vec_id", rounded("predicted").alias("predicted"))


@query(
    "pls_one_component_r2",
    f"WITH {_PLS} SELECT 1 AS components, {r(_R2, 8)} AS r2 FROM p",
)
def pls_one_component_r2(spark, folder):
    table = pls_cv(_planted(spark, folder, 4), DIMENSIONS[:4], "y", "fold", 5, 1)
    return table.select("components", rounded("r2", 8).alias("r2"))


@query(
    "pls_full_rank",
    "SELECT term, " + r("coefficient") + " AS coefficient FROM (SELECT unnest(['intercept', 'l_quantity']) AS term, "
    "unnest([regr_intercept(l_extendedprice, l_quantity), regr_slope(l_extendedprice, l_quantity)]) AS coefficient FROM lineitem)",
)
def pls_full_rank(spark, folder):
    model = pls_fit(read_table(spark, folder, "lineitem"), ["l_quantity"], "l_extendedprice", 1)
    return model.table(spark).select("term", rounded("coefficient").alias("coefficient"))


@query("pls_cv_components")
def pls_cv_components(spark, folder):
    return pls_cv(_planted(spark, folder), DIMENSIONS, "y", "fold", 5, 10)


def _with_outliers(spark, folder):
    return _planted(spark, folder).withColumn("y", F.col("y") + F.when(F.col("vec_id") % 37 == 0, 8.0).otherwise(0.0))


@query("outlier_samples_embeddings")
def outlier_samples_embeddings(spark, folder):
    return outlier_samples(_with_outliers(spark, folder), "vec_id", DIMENSIONS, "y")


@query("outlier_samples_ridge")
def outlier_samples_ridge(spark, folder):
    return outlier_samples(_with_outliers(spark, folder), "vec_id", DIMENSIONS, "y", learner=RidgeLearner())


# The rows that were moved are known, so the flags have an exact answer.
_SQL_MOVED = "SELECT vec_id FROM embeddings WHERE vec_id % 37 = 0"


@query("moved_samples_found", _SQL_MOVED)
def moved_samples_found(spark, folder):
    return outlier_samples(_with_outliers(spark, folder), "vec_id", DIMENSIONS, "y", width=12.0).where("is_outlier_sample").select("vec_id")


@query("moved_samples_found_ridge", _SQL_MOVED)
def moved_samples_found_ridge(spark, folder):
    found = outlier_samples(_with_outliers(spark, folder), "vec_id", DIMENSIONS, "y", learner=RidgeLearner(), width=12.0)
    return found.where("is_outlier_sample").select("vec_id")


# ---- mixtures -------------------------------------------------------------------------------

_RIDGE = "0.000001::DOUBLE"
_MOMENTS = (
    "t AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), "
    f"s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS p, var_pop(y) AS q, covar_pop(x, y) AS b FROM t), "
    f"c AS (SELECT *, p + {_RIDGE} AS a, q + {_RIDGE} AS d, (p + {_RIDGE}) * (q + {_RIDGE}) - b * b AS det FROM s)"
)
_LOG2PI = repr(log(2 * pi)) + "::DOUBLE"
_DENSITY = f"-0.5 * (2 * {_LOG2PI} + ln(det) + (d * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / det)"


def _pair(spark, folder):
    return read_table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding")[0].cast("double").alias("x1"), F.col("embedding")[1].cast("double").alias("x2")
    )


@query("one_gaussian_density", f"WITH {_MOMENTS} SELECT vec_id, {r(_DENSITY)} AS log_density FROM t, c")
def one_gaussian_density(spark, folder):
    rows = _pair(spark, folder)
    model = fit_mixture(rows, ["x1", "x2"], 1)
    return score_mixture(rows, ["vec_id"], ["x1", "x2"], model).select("vec_id", rounded("log_density").alias("log_density"))


_FULL = f"-n / 2.0 * (2 * {_LOG2PI} + ln(det) + (d * p - 2 * b * b + a * q) / det)"
_DIAG = f"-n / 2.0 * (2 * {_LOG2PI} + ln(a) + ln(d) + p / a + q / d)"
_BALL = f"-n / 2.0 * (2 * {_LOG2PI} + 2 * ln((p + q) / 2 + {_RIDGE}) + (p + q) / ((p + q) / 2 + {_RIDGE}))"


@query(
    "one_gaussian_bic",
    f"WITH {_MOMENTS}, g AS (" + " UNION ALL ".join(
        f"SELECT '{kind}' AS covariance_type, -2 * ({likelihood}) + {count} * ln(n) AS bic FROM c"
        for kind, likelihood, count in (("full", _FULL, 5), ("tied", _FULL, 5), ("diag", _DIAG, 4), ("spherical", _BALL, 3))
    ) + f") SELECT 1 AS components, covariance_type, {r('bic', 4)} AS bic FROM g",
)
def one_gaussian_bic(spark, folder):
    _, grid = mixture_bic(_pair(spark, folder), ["x1", "x2"], 1)
    return grid.select("components", "covariance_type", rounded("bic", 4).alias("bic"))


@query(
    "density_grid",
    f"WITH {_MOMENTS.replace('avg(x) AS mx', 'avg(x) AS mx0').replace('avg(y) AS my', 'avg(y) AS my0')}, "
    "g AS (SELECT ix, iy, -4.0::DOUBLE + ix * (7.0::DOUBLE / 49) AS x1, -3.0::DOUBLE + iy * (6.0::DOUBLE / 49) AS x2 FROM (SELECT unnest(range(50))::INTEGER AS ix) a, "
    "(SELECT unnest(range(50))::INTEGER AS iy) bb), "
    # after standardising: mean 0, population variance (n - 1) / n
    f"z AS (SELECT (n - 1.0) / n + {_RIDGE} AS v, b / sqrt(p * q) * (n - 1.0) / n AS w FROM c) "
    f"SELECT ix, iy, {r('x1')} AS x1, {r('x2')} AS x2, {r(f'0.5 * (2 * {_LOG2PI} + ln(v * v - w * w) + (v * x1 * x1 - 2 * w * x1 * x2 + v * x2 * x2) / (v * v - w * w))')} "
    "AS negative_log_density FROM g, z",
)
def density_grid_embeddings(spark, folder):
    model = fit_mixture(autoscale(_pair(spark, folder), ["x1", "x2"]), ["x1", "x2"], 1)
    grid = density_grid(spark, model)
    return grid.select("ix", "iy", *[rounded(c).alias(c) for c in ("x1", "x2", "negative_log_density")])


@query("mixture_probabilities")
def mixture_probabilities_customer(spark, folder):
    rows = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    scaled = autoscale(rows, ["c_nationkey", "c_acctbal"])
    model = fit_mixture(scaled, ["c_nationkey", "c_acctbal"], 3, "full", rounds=15)
    return mixture_probabilities(scaled, ["c_custkey"], ["c_nationkey", "c_acctbal"], model)


@query("mixture_shares_total", "SELECT c_custkey, 1.0::DOUBLE AS total FROM customer")
def mixture_shares_total(spark, folder):
    shares = mixture_probabilities_customer(spark, folder)
    return shares.select("c_custkey", rounded(F.col("0") + F.col("1") + F.col("2")).alias("total"))


@query("mixture_labels")
def mixture_labels(spark, folder):
    rows = _pair(spark, folder)
    model = fit_mixture(rows, ["x1", "x2"], 2, "spherical", rounds=15)
    return score_mixture(rows, ["vec_id"], ["x1", "x2"], model).select("vec_id", "cluster_number")


@query("mixture_bic_grid")
def mixture_bic_grid(spark, folder):
    return mixture_bic(_pair(spark, folder), ["x1", "x2"], 4, rounds=15)[1]


_BLANK_PART = (
    "SELECT p_partkey, CASE WHEN (p_partkey * 7 + 1) % 11 <> 0 THEN p_size::DOUBLE END AS x, "
    "CASE WHEN (p_partkey * 7 + 2) % 11 <> 0 THEN p_retailprice + 20.0 * p_size END AS y FROM part"
)


def _blank_part(spark, folder):
    key, size = F.col("p_partkey"), F.col("p_size")
    return read_table(spark, folder, "part").select(
        "p_partkey", F.when((key * 7 + 1) % 11 != 0, size.cast("double")).alias("x"),
        F.when((key * 7 + 2) % 11 != 0, F.col("p_retailprice") + 20.0 * size).alias("y"),
    )


@query(
    "impute_one_gaussian",
    f"WITH t AS ({_BLANK_PART}), k AS (SELECT * FROM t WHERE x IS NOT NULL AND y IS NOT NULL), "
    # complete rows give the model and the scale of the answer, all known cells the scale of the question
    "s AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(y) AS my, stddev_samp(y) AS sy, "
    f"(count(*) - 1.0) / count(*) + {_RIDGE} AS v, corr(x, y) * (count(*) - 1.0) / count(*) AS w FROM k), "
    "o AS (SELECT avg(x) AS ox, stddev_samp(x) AS px, avg(y) AS oy, stddev_samp(y) AS py FROM t) "
    f"SELECT p_partkey, {r('coalesce(x, CASE WHEN y IS NULL THEN mx ELSE mx + sx * w / v * (y - oy) / py END)')} AS x, "
    f"{r('coalesce(y, CASE WHEN x IS NULL THEN my ELSE my + sy * w / v * (x - ox) / px END)')} AS y FROM t, s, o",
)
def impute_one_gaussian(spark, folder):
    filled = impute_mixture(_blank_part(spark, folder), ["x", "y"], 1, 1, ["full"])
    return filled.select("p_partkey", rounded("x").alias("x"), rounded("y").alias("y"))


def _rounds_sql(rounds: int) -> str:
    """The imputation of one Gaussian unrolled: every later round learns from the completed table."""
    parts = [f"t0 AS ({_BLANK_PART})", "k0 AS (SELECT * FROM t0 WHERE x IS NOT NULL AND y IS NOT NULL)"]
    for i in range(rounds):
        source = "k0" if i == 0 else f"t{i}"
        parts.append(
            f"s{i} AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(y) AS my, stddev_samp(y) AS sy, "
            f"(count(*) - 1.0) / count(*) + {_RIDGE} AS v, corr(x, y) * (count(*) - 1.0) / count(*) AS w FROM {source})"
        )
        parts.append(f"o{i} AS (SELECT avg(x) AS ox, stddev_samp(x) AS px, avg(y) AS oy, stddev_samp(y) AS py FROM {'t0' if i == 0 else f't{i}'})")
        parts.append(
            f"t{i + 1} AS (SELECT p_partkey, coalesce(x, CASE WHEN y IS NULL THEN mx ELSE mx + sx * w / v * (y - oy) / py END) AS x, "
            f"coalesce(y, CASE WHEN x IS NULL THEN my ELSE my + sy * w / v * (x - ox) / px END) AS y FROM t0, s{i}, o{i})"
        )
    return "WITH " + ", ".join(parts) + f" SELECT p_partkey, {r('x')} AS x, {r('y')} AS y FROM t{rounds}"


@query("impute_three_rounds", _rounds_sql(3))
def impute_three_rounds(spark, folder):
    filled = impute_mixture(_blank_part(spark, folder), ["x", "y"], 3, 1, ["full"])
    return filled.select("p_partkey", rounded("x").alias("x"), rounded("y").alias("y"))


@query("impute_part")
def impute_part(spark, folder):
    return impute_mixture(_blank_part(spark, folder), ["x", "y"], 2, 2, ["full", "diag"])


# ---- neighbours -----------------------------------------------------------------------------


def _nearest_sql(table: str, space: str, k: int) -> str:
    return (
        f"SELECT id, neighbour, distance, rank FROM (SELECT a.id, b.id AS neighbour, list_distance(a.{space}, b.{space}) AS distance, "
        f"row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.{space}, b.{space}), b.id) AS rank FROM {table} a JOIN {table} b ON a.id <> b.id) WHERE rank <= {k}"
    )


@query(
    "nearest_embeddings",
    f"WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings) SELECT id AS vec_id, neighbour, {r('distance')} AS distance, rank::INTEGER AS rank "
    f"FROM ({_nearest_sql('e', 'x', 10)})",
)
def nearest_embeddings(spark, folder):
    found = nearest_neighbours(read_table(spark, folder, "embeddings"), "vec_id", "embedding", 10)
    return found.select("vec_id", "neighbour", rounded("distance").alias("distance"), "rank")


@query(
    "nearest_far_from_zero",
    f"WITH e AS (SELECT p_partkey AS id, [p_size + 1e8, p_retailprice + 1e8]::DOUBLE[] AS x FROM part) SELECT id AS p_partkey, neighbour, {r('distance')} AS distance, rank::INTEGER AS rank "
    f"FROM ({_nearest_sql('e', 'x', 5)})",
)
def nearest_far_from_zero(spark, folder):
    part = read_table(spark, folder, "part").select("p_partkey", (F.col("p_size") + 1e8).alias("a"), (F.col("p_retailprice") + 1e8).alias("b"))
    found = nearest_neighbours(part, "p_partkey", ["a", "b"], 5, block_rows=512)
    return found.select("p_partkey", "neighbour", rounded("distance").alias("distance"), "rank")


@query(
    "nearest_orders",
    "WITH e AS (SELECT o_orderkey AS id, [o_totalprice::DOUBLE / 1000, (o_custkey % 100)::DOUBLE, (o_orderkey % 31)::DOUBLE] AS x FROM orders), "
    "b AS (SELECT id, x, ntile(40) OVER (ORDER BY x[1]) AS t FROM e) "
    "SELECT id, neighbour, rank FROM (SELECT a.id, c.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY "
    "sqrt((a.x[1] - c.x[1]) * (a.x[1] - c.x[1]) + (a.x[2] - c.x[2]) * (a.x[2] - c.x[2]) + (a.x[3] - c.x[3]) * (a.x[3] - c.x[3])), c.id)::INTEGER AS rank "
    "FROM e a JOIN e c ON a.id <> c.id AND abs(a.x[1] - c.x[1]) <= 60 AND abs(a.x[2] - c.x[2]) <= 60) WHERE rank <= 3",
)
def nearest_orders(spark, folder):
    x = F.array(F.col("o_totalprice").cast("double") / 1000, (F.col("o_custkey") % 100).cast("double"), (F.col("o_orderkey") % 31).cast("double"))
    rows = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), x.alias("x"))
    return nearest_neighbours(rows, "id", "x", 3, block_rows=256).select("id", "neighbour", F.col("rank").cast("int").alias("rank"))


@query(
    "k3n_excess",
    "WITH e AS (SELECT vec_id AS id, embedding[1:8]::DOUBLE[] AS x, embedding[1:2]::DOUBLE[] AS t FROM embeddings), "
    f"na AS ({_nearest_sql('e', 'x', 10)}), nb AS ({_nearest_sql('e', 't', 10)}), "
    "reached AS (SELECT na.id, list_distance(p.t, q.t) AS d, row_number() OVER (PARTITION BY na.id ORDER BY list_distance(p.t, q.t)) AS rank "
    "FROM na JOIN e p ON p.id = na.id JOIN e q ON q.id = na.neighbour) "
    f"SELECT nb.id AS vec_id, {r('avg((reached.d - nb.distance) / nb.distance)')} AS excess FROM reached JOIN nb ON nb.id = reached.id AND nb.rank = reached.rank GROUP BY 1",
)
def k3n_excess(spark, folder):
    rows = read_table(spark, folder, "embeddings").select(
        "vec_id", F.slice("embedding", 1, 8).alias("a"), F.slice("embedding", 1, 2).alias("b")
    )
    return k3n_terms(rows, "vec_id", "a", "b", 10).select("vec_id", rounded("excess").alias("excess"))


def _excess_sql(found: str, best: str, space: str) -> str:
    return (
        f"(SELECT avg((g.d - best.distance) / best.distance) FROM (SELECT f.id, list_distance(p.{space}, q.{space}) AS d, "
        f"row_number() OVER (PARTITION BY f.id ORDER BY list_distance(p.{space}, q.{space})) AS rank FROM {found} f JOIN e p ON p.id = f.id "
        f"JOIN e q ON q.id = f.neighbour) g JOIN {best} best ON best.id = g.id AND best.rank = g.rank)"
    )


@query(
    "k3n_error_value",
    "WITH e AS (SELECT vec_id AS id, embedding[1:8]::DOUBLE[] AS x, embedding[1:2]::DOUBLE[] AS t FROM embeddings), "
    f"na AS ({_nearest_sql('e', 'x', 10)}), nb AS ({_nearest_sql('e', 't', 10)}) "
    f"SELECT {r(_excess_sql('na', 'nb', 't') + ' + ' + _excess_sql('nb', 'na', 'x'))} AS k3n_error",
)
def k3n_error_value(spark, folder):
    rows = read_table(spark, folder, "embeddings").select(
        "vec_id", F.slice("embedding", 1, 8).alias("a"), F.slice("embedding", 1, 2).alias("b")
    )
    error = k3n_error(rows, "vec_id", "a", "b", 10)
    return spark.createDataFrame([(error,)], "k3n_error double").select(rounded("k3n_error").alias("k3n_error"))


@query("embedding_sweep")
def embedding_sweep_embeddings(spark, folder):
    rows = read_table(spark, folder, "embeddings")
    candidates = {f"axes_{a}_{b}": principal_embedding(rows, "vec_id", "embedding", (a, b)) for a, b in ((0, 1), (2, 3))}
    return embedding_sweep(rows, "vec_id", "embedding", candidates, 10)


# ---- topographic maps -----------------------------------------------------------------------


def _six(spark, folder):
    rows = spread_array(read_table(spark, folder, "embeddings"), "embedding", ["vec_id"])
    return autoscale(rows.select("vec_id", *DIMENSIONS[:6]), DIMENSIONS[:6]).persist()


@query("map_positions")
def map_positions_embeddings(spark, folder):
    rows = _six(spark, folder)
    return map_positions(rows, ["vec_id"], DIMENSIONS[:6], fit_map(rows, DIMENSIONS[:6], MapSpec(10, 3, 1.0, 0.1), rounds=15))


@query("map_responsibilities")
def map_responsibilities(spark, folder):
    rows = _six(spark, folder)
    shares = responsibilities(rows, ["vec_id"], DIMENSIONS[:6], fit_map(rows, DIMENSIONS[:6], MapSpec(5, 2, 1.0, 0.1), rounds=10))
    return shares.select("vec_id", F.posexplode("responsibilities").alias("node", "share"))


@query("map_shares_total", "SELECT vec_id, 1.0::DOUBLE AS total FROM embeddings")
def map_shares_total(spark, folder):
    return map_responsibilities(spark, folder).groupBy("vec_id").agg(rounded(F.sum("share")).alias("total"))


@query("map_grid_search")
def map_grid_search_embeddings(spark, folder):
    specs = [MapSpec(6, q, v, 0.1) for q in (2, 3) for v in (0.5, 2.0)]
    return map_grid_search(_six(spark, folder), "vec_id", DIMENSIONS[:6], specs, 10, rounds=10)[1]


@query("sparse_map_grid_search")
def sparse_map_grid_search(spark, folder):
    specs = [MapSpec(6, q, 1.0, 0.1, sparse=True) for q in (2, 3)]
    return map_grid_search(_six(spark, folder), "vec_id", DIMENSIONS[:6], specs, 10, rounds=10)[1]


@query("merge_steps")
def merge_steps_embeddings(spark, folder):
    rows = _six(spark, folder)
    model = fit_map(rows, DIMENSIONS[:6], MapSpec(6, 3, 1.0, 0.1, sparse=True), rounds=20)
    return merge_clusters(rows, ["vec_id"], DIMENSIONS[:6], model)[0]


@query("sparse_map_clusters")
def sparse_map_clusters(spark, folder):
    rows = _six(spark, folder)
    model = fit_map(rows, DIMENSIONS[:6], MapSpec(6, 3, 1.0, 0.1, sparse=True), rounds=20)
    return merge_clusters(rows, ["vec_id"], DIMENSIONS[:6], model)[1]


# ---- searches -------------------------------------------------------------------------------

_SMALL = {"population": 20, "generations": 5}


@query("ga_features")
def ga_features(spark, folder):
    return select_features_ga(_planted(spark, folder), DIMENSIONS, "y", "fold", **_SMALL).table(spark)


@query("ga_log")
def ga_log(spark, folder):
    return select_features_ga(_planted(spark, folder), DIMENSIONS, "y", "fold", **_SMALL).generations


@query("ga_regions")
def ga_regions(spark, folder):
    return select_regions_ga(_planted(spark, folder), DIMENSIONS, "y", "fold", **_SMALL).table(spark)


@query("ga_lags")
def ga_lags(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "ts", "value", "user_id")
    found = select_lags_ga(events, ["ts", "event_id"], "value", ["user_id"], 20, max_width=8, **_SMALL)
    return found.table(spark)


@query("rbf_cv")
def rbf_cv_embeddings(spark, folder):
    points = [RbfPoint((3, 10, 20, 33, 50), 2.0**5, 2.0**-5, 2.0**-4), RbfPoint((0, 1, 2), 1.0, 0.1, 0.5)]
    scores = rbf_cv(_planted(spark, folder), DIMENSIONS, "y", "fold", 5, points)
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "point int, r2 double")


@query("rbf_ga_features")
def rbf_ga_features(spark, folder):
    found = select_features_rbf_ga(_planted(spark, folder), DIMENSIONS, "y", "fold", population=8, generations=2)
    return found.table(spark)


@query("rbf_ga_hyperparameters")
def rbf_ga_hyperparameters(spark, folder):
    found = select_features_rbf_ga(_planted(spark, folder), DIMENSIONS, "y", "fold", population=8, generations=2)
    return hyperparameter_table(spark, dict(zip(("C", "epsilon", "gamma"), found.genome[-3:])))


@query("rbf_ga_regions")
def rbf_ga_regions(spark, folder):
    found = select_regions_rbf_ga(_planted(spark, folder), DIMENSIONS, "y", "fold", population=8, generations=2)
    return found.table(spark)


@query("rbf_ga_lags")
def rbf_ga_lags(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "ts", "value", "user_id")
    found = select_lags_rbf_ga(
        events, ["ts", "event_id"], "value", ["user_id"], 10, max_width=5, dimension=16, population=6, generations=1
    )
    return found.table(spark)


# ---- ensembles ------------------------------------------------------------------------------


def _three_classes(spark, folder):
    rows = read_table(spark, folder, "embeddings").withColumn("c", F.pmod("label", F.lit(3)))
    return train_test_split(B.as_vectors(rows, "vec_id", "embedding", "c"), "vec_id")


_SPLIT = (
    "t AS (SELECT vec_id, label % 3 AS c, (vec_id % 1000003) * 7919 + 42 * 104729 AS m FROM embeddings), "
    "u AS (SELECT vec_id, c, (((m % 10007) * (m % 10007) + m) % 10007) / 10007.0 < 0.7 AS is_train FROM t)"
)


@query(
    "majority_error",
    f"WITH {_SPLIT}, w AS (SELECT c FROM u WHERE is_train GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) "
    f"SELECT {r('avg(CASE WHEN u.c <> w.c THEN 1.0 ELSE 0.0 END)')} AS error FROM u, w WHERE NOT is_train",
)
def majority_error(spark, folder):
    train, test = _three_classes(spark, folder)
    return B.majority_error(train, test, "label").select(rounded("error").alias("error"))


@query("tree_error")
def tree_error(spark, folder):
    return B.tree_error(*_three_classes(spark, folder))


@query(
    "staged_scores",
    "WITH v AS (SELECT vec_id, label % 3 AS y, k, CASE WHEN embedding[k]::DOUBLE > 0 THEN label % 3 ELSE (vec_id + k) % 3 END AS p, 1.0::DOUBLE / k AS w "
    "FROM embeddings, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k)), "
    "c AS (SELECT unnest([0, 1, 2]) AS c), s AS (SELECT vec_id, y, k, c, sum(CASE WHEN p = c THEN w ELSE 0 END) OVER (PARTITION BY vec_id, c ORDER BY k) AS votes "
    "FROM v, c), best AS (SELECT *, row_number() OVER (PARTITION BY vec_id, k ORDER BY votes DESC, c) AS place FROM s) "
    f"SELECT k AS round, {r('avg(CASE WHEN c <> y THEN 1.0 ELSE 0.0 END)')} AS error FROM best WHERE place = 1 GROUP BY 1",
)
def staged_scores(spark, folder):
    rows = read_table(spark, folder, "embeddings").withColumn("y", F.pmod("label", F.lit(3)).cast("double"))
    rounds = rows.withColumn("round", F.explode(F.array(*[F.lit(k) for k in range(1, 7)])))
    value = F.get("embedding", F.col("round") - 1).cast("double")
    votes = rounds.select(
        "vec_id", F.col("y").alias("label"), "round",
        F.when(value > 0, F.col("y")).otherwise(F.pmod(F.col("vec_id") + F.col("round"), F.lit(3)).cast("double")).alias("prediction"),
        (F.lit(1.0) / F.col("round")).alias("weight"),
    )
    return B.staged_scores(votes, "vec_id").withColumn("error", rounded("error"))


@lru_cache(maxsize=4)
def _boosted(application: str, folder: str, kind: str):
    """The whole models, which several queries read from."""
    train, _ = _three_classes(SparkSession.active(), folder)
    fit = {"votes": T.fit_adaboost, "sums": T.fit_gradient_boost}[kind]
    return fit(train.withColumn("x", vector_to_array("x")), "x", "label")


def _model(spark, folder, kind):
    return _boosted(spark.sparkContext.applicationId, folder, kind)


def _held_out(spark, folder):
    return _three_classes(spark, folder)[1].withColumn("x", vector_to_array("x"))


@query("adaboost_stages")
def adaboost_stages(spark, folder):
    return _model(spark, folder, "votes").staged_errors(_held_out(spark, folder), "x", "label")


@query("adaboost_learners")
def adaboost_learners(spark, folder):
    return _model(spark, folder, "votes").learner_table(spark)


@query("gradient_boost_stages")
def gradient_boost_stages(spark, folder):
    return _model(spark, folder, "sums").staged_errors(_held_out(spark, folder), "x", "label")


@query("boosted_predictions")
def boosted_predictions(spark, folder):
    return _model(spark, folder, "sums").predict(_held_out(spark, folder), "x", ["vec_id"]).select("vec_id", "prediction")


_STUMP_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
_STUMP_ROWS = (
    "rows AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS id, "
    "CASE WHEN l_extendedprice < 20000 THEN 0 WHEN l_extendedprice < 40000 THEN 1 ELSE 2 END AS y, "
    "[" + ", ".join(f"{c}::DOUBLE" for c in _STUMP_FEATURES) + "] AS x FROM lineitem)"
)


def _priced(spark, folder):
    price = F.col("l_extendedprice")
    y = F.when(price < 20000, 0).when(price < 40000, 1).otherwise(2).alias("y")
    return read_table(spark, folder, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in _STUMP_FEATURES], y)


def _sql_class_stump(n: int, weight: str) -> str:
    """CTEs s{n} (f, cut, left, right: the best split and its classes) and p{n} (id, y, w, miss) from weights w{n} (id, y, x, w)."""
    return f"""
w{n} AS ({weight}),
h{n} AS (SELECT f, x[f] AS v, y, sum(w) AS w FROM w{n}, range(1, 5) t(f) GROUP BY ALL),
l{n} AS (SELECT c.f, c.v AS cut, h.y, sum(CASE WHEN h.v <= c.v THEN h.w ELSE 0 END) AS l, sum(h.w) AS t
  FROM (SELECT DISTINCT f, v FROM h{n}) c JOIN h{n} h USING (f) GROUP BY ALL),
g{n} AS (SELECT f, cut, (sum(l * l) / sum(l) + sum((t - l) * (t - l)) / sum(t - l) - sum(t * t) / sum(t)) / sum(t) AS gain,
  arg_max(y, (l, -y)) AS lefty, arg_max(y, (t - l, -y)) AS righty FROM l{n} GROUP BY f, cut HAVING sum(t - l) > 0),
s{n} AS (SELECT * FROM g{n} ORDER BY round(gain, 9) DESC, f, cut LIMIT 1),
p{n} AS (SELECT id, y, x, w, (y <> CASE WHEN x[s.f] <= s.cut THEN s.lefty ELSE s.righty END) AS miss FROM w{n}, s{n} s),
e{n} AS (SELECT sum(CASE WHEN miss THEN w ELSE 0 END) / sum(w) AS e FROM p{n}),
a{n} AS (SELECT e, ln((1 - e) / e) + ln(2.0) AS a FROM e{n})"""


_SQL_ADABOOST_STUMPS = (
    f"WITH {_STUMP_ROWS}, {_sql_class_stump(1, 'SELECT id, y, x, 1.0::DOUBLE AS w FROM rows')}, "
    f"{_sql_class_stump(2, 'SELECT id, y, x, w * CASE WHEN miss THEN exp(a) ELSE 1 END AS w FROM p1, a1')} "
    + " UNION ALL ".join(
        f"SELECT {n}::INTEGER AS round, (s.f - 1)::INTEGER AS feature, {r('s.cut')} AS threshold, {r('a.e')} AS error, {r('a.a')} AS weight FROM s{n} s, a{n} a"
        for n in (1, 2)
    )
)


@query("adaboost_stumps", _SQL_ADABOOST_STUMPS)
def adaboost_stumps(spark, folder):
    model = T.fit_adaboost(_priced(spark, folder), _STUMP_FEATURES, "y", rounds=2, depth=1)
    found = model.splits(spark).join(model.learner_table(spark), "round")
    return found.select("round", "feature", *[rounded(c).alias(c) for c in ("threshold", "error", "weight")])


@query(
    "tree_stump_error",
    f"WITH {_STUMP_ROWS}, {_sql_class_stump(1, 'SELECT id, y, x, 1.0::DOUBLE AS w FROM rows')} SELECT {r('e')} AS error FROM e1",
)
def tree_stump_error(spark, folder):
    rows = _priced(spark, folder)
    model = T.fit_tree(rows, _STUMP_FEATURES, "y", depth=1)
    return model.staged_errors(rows, _STUMP_FEATURES, "y").select(rounded("error").alias("error"))


def _sql_residual_stumps(n: int, scores: str) -> str:
    """CTEs for the three regression stumps of a round, from scores f{n} (id, y, x, c, f): s{n} (c, f, cut, left, right) and the next scores."""
    return f"""
f{n} AS ({scores}),
q{n} AS (SELECT id, y, x, c, f, exp(f) / sum(exp(f)) OVER (PARTITION BY id) AS p FROM f{n}),
r{n} AS (SELECT *, (CASE WHEN y = c THEN 1 ELSE 0 END) - p AS r FROM q{n}),
h{n} AS (SELECT c, k, x[k] AS v, count(*) AS n, sum(r) AS r, sum(abs(r) * (1 - abs(r))) AS d FROM r{n}, range(1, 5) t(k) GROUP BY ALL),
l{n} AS (SELECT a.c, a.k, a.v AS cut, sum(CASE WHEN h.v <= a.v THEN h.n ELSE 0 END) AS ln, sum(CASE WHEN h.v <= a.v THEN h.r ELSE 0 END) AS lr,
  sum(CASE WHEN h.v <= a.v THEN h.d ELSE 0 END) AS ld, sum(h.n) AS tn, sum(h.r) AS tr, sum(h.d) AS td FROM h{n} a JOIN h{n} h USING (c, k) GROUP BY ALL),
s{n} AS (SELECT *, 0.1 * 2 / 3 * lr / ld AS lefty, 0.1 * 2 / 3 * (tr - lr) / (td - ld) AS righty FROM l{n} WHERE tn > ln
  QUALIFY row_number() OVER (PARTITION BY c ORDER BY round((lr * lr / ln + (tr - lr) * (tr - lr) / (tn - ln) - tr * tr / tn) / tn, 9) DESC, k, cut) = 1)"""


_SQL_GRADIENT_STUMPS = (
    f"WITH {_STUMP_ROWS}, {_sql_class_stump(0, 'SELECT id, y, x, 1.0::DOUBLE AS w FROM rows')}, "
    "shares AS (SELECT w.x[s.f] <= s.cut AS low, c, avg(CASE WHEN y = c THEN 1.0::DOUBLE ELSE 0 END) AS share FROM w0 w, s0 s, range(0, 3) t(c) GROUP BY ALL), "
    + _sql_residual_stumps(
        1,
        f"SELECT w.id, w.y, w.x, h.c, ln(least(greatest(h.share, {float.fromhex('0x1p-23')!r}), {1 - float.fromhex('0x1p-23')!r})) AS f "
        "FROM w0 w, s0 s, shares h WHERE h.low = (w.x[s.f] <= s.cut)",
    )
    + ", "
    + _sql_residual_stumps(2, "SELECT r.id, r.y, r.x, r.c, r.f + CASE WHEN r.x[s.k] <= s.cut THEN s.lefty ELSE s.righty END AS f FROM r1 r JOIN s1 s USING (c)")
    + " "
    + " UNION ALL ".join(
        f"SELECT {n}::INTEGER AS round, c::INTEGER AS tree, (k - 1)::INTEGER AS feature, {r('cut')} AS threshold, {r('lefty')} AS below, {r('righty')} AS above FROM s{n}"
        for n in (1, 2)
    )
)


@query("gradient_boost_stumps", _SQL_GRADIENT_STUMPS)
def gradient_boost_stumps(spark, folder):
    model = T.fit_gradient_boost(_priced(spark, folder), _STUMP_FEATURES, "y", rounds=2, depth=1)
    leaves = [(n, c, float(t.values[0, 0]), float(t.values[1, 0])) for n, trees in enumerate(model.trees, 1) for c, t in enumerate(trees)]
    leaves = spark.createDataFrame(leaves, "round int, tree int, below double, above double")
    found = model.splits(spark).join(leaves, ["round", "tree"])
    return found.select("round", "tree", "feature", *[rounded(c).alias(c) for c in ("threshold", "below", "above")])


def _screened(spark, folder):
    rows = read_table(spark, folder, "embeddings")
    label = (F.col("embedding")[0] + F.col("embedding")[3] + F.col("embedding")[5] > 0).cast("int")
    return rows.select("vec_id", F.col("embedding").alias("x"), label.alias("c"))


@query("relevant_features")
def relevant_features_embeddings(spark, folder):
    return relevant_features(_screened(spark, folder), "vec_id", "x", "c")


@query("relevant_features_stumps")
def relevant_features_stumps(spark, folder):
    return relevant_features(_screened(spark, folder), "vec_id", "x", "c", learner=StumpLearner())

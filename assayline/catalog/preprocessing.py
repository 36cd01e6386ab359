"""Queries for statistics, scaling, smoothing, lags, outlier limits and feature pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayline.catalog.registry import query, rounded, sql_rounded
from assayline.functions.scalar import row_mean
from assayline.operators import features as X
from assayline.operators.boosting import majority_label, misclassification
from assayline.operators.outliers import flag_outside, hampel_limits, savgol_hampel, three_sigma, three_sigma_limits
from assayline.operators.pls import r2_score
from assayline.operators.scale import autoscale, describe_features, fit_scaler
from assayline.operators.search import generation_log
from assayline.operators.signal import lag_table, smooth_series, smooth_spectra
from assayline.operators.split import with_split
from assayline.plans.moments import moment_table
from assayline.plans.ordered import shuffled_fold
from assayline.plans.quantiles import exact_median
from assayline.sources.tables import read_table

r = sql_rounded
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_KEY_SQL = ", ".join(LINE_KEY)


# ---- statistics -----------------------------------------------------------------------------

_STATS = {
    "n": "count({c})::DOUBLE", "total": r("sum({c})", 3), "minimum": r("min({c})"), "maximum": r("max({c})"),
    "mean": r("avg({c})"), "std_samp": r("stddev_samp({c})"), "std_pop": r("stddev_pop({c})"), "var_pop": r("var_pop({c})", 3),
    "sum_of_squares": r("sum({c} * {c})", 0),
}


@query(
    "feature_statistics",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, " + ", ".join(f"{e.format(c=c)} AS {n}" for n, e in _STATS.items()) + " FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax")
    ),
)
def feature_statistics(spark, folder):
    table = describe_features(read_table(spark, folder, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    digits = {"total": 3, "var_pop": 3, "sum_of_squares": 0}
    return table.select("feature", "n", *[
        rounded(c, digits.get(c, 6)).alias(c) for c in table.columns if c not in ("feature", "n")
    ])


@query(
    "median_and_mad",
    "WITH m AS (SELECT event_type, median(value) AS c FROM events GROUP BY 1) SELECT event_type, " + r("any_value(c)")
    + " AS centre, " + r("median(abs(value - c))") + " AS mad FROM events JOIN m USING (event_type) GROUP BY 1",
)
def median_and_mad(spark, folder):
    limits = hampel_limits(read_table(spark, folder, "events"), "value", ["event_type"])
    return limits.select("event_type", rounded("centre").alias("centre"), rounded("mad").alias("mad"))


@query("median_price", "SELECT " + r("median(l_extendedprice)") + " AS median FROM lineitem")
def median_price(spark, folder):
    return exact_median(read_table(spark, folder, "lineitem"), "l_extendedprice").select(rounded("median").alias("median"))


@query(
    "generation_log_lineitem",
    "SELECT l_linenumber AS generation, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS evaluated, "
    + r("min(l_discount)") + " AS minimum, " + r("max(l_discount)") + " AS maximum, " + r("avg(l_discount)") + " AS mean, "
    + r("sqrt(abs(avg(l_discount * l_discount) - avg(l_discount) * avg(l_discount)))") + " AS std FROM lineitem GROUP BY 1",
)
def generation_log_lineitem(spark, folder):
    rows = read_table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("generation"), F.col("l_discount").alias("fitness"),
        (F.col("l_returnflag") == "R").alias("is_new"),
    )
    log = generation_log(rows)
    return log.select("generation", "evaluated", *[rounded(c).alias(c) for c in ("minimum", "maximum", "mean", "std")])


@query(
    "distinct_levels_orders",
    "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders",
)
def distinct_levels_orders(spark, folder):
    return read_table(spark, folder, "orders").agg(
        F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderpriority").alias("priorities")
    )


@query(
    "r2_by_flag",
    "SELECT l_returnflag, " + r("1 - sum((l_extendedprice - 1500 * l_quantity) * (l_extendedprice - 1500 * l_quantity)) "
                                "/ nullif(var_pop(l_extendedprice) * count(*), 0)") + " AS r2 FROM lineitem GROUP BY 1",
)
def r2_by_flag(spark, folder):
    rows = read_table(spark, folder, "lineitem").withColumn("p", 1500 * F.col("l_quantity"))
    return r2_score(rows, "l_extendedprice", "p", ["l_returnflag"]).withColumn("r2", rounded("r2"))


@query(
    "misclassified_orders",
    "SELECT o_orderpriority, " + r("avg(CASE WHEN o_orderstatus <> (CASE WHEN o_totalprice > 250000 THEN 'F' ELSE 'O' END) "
                                   "THEN 1.0 ELSE 0.0 END)") + " AS error FROM orders GROUP BY 1",
)
def misclassified_orders(spark, folder):
    guess = F.when(F.col("o_totalprice") > 250000, "F").otherwise("O")
    rows = read_table(spark, folder, "orders").withColumn("guess", guess)
    return misclassification(rows, "o_orderstatus", "guess", ["o_orderpriority"]).withColumn("error", rounded("error"))


@query("majority_label_embeddings", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n DESC, label LIMIT 1")
def majority_label_embeddings(spark, folder):
    return majority_label(read_table(spark, folder, "embeddings"), "label")


_FOLD = "(l_orderkey % 5)::INTEGER"
_TERMS = [("1", "1.0"), ("l_quantity", "l_quantity"), ("l_discount", "l_discount"), ("l_tax", "l_tax"), ("l_extendedprice", "l_extendedprice")]


@query(
    "fold_moments",
    " UNION ALL ".join(
        f"SELECT {_FOLD} AS fold, '{a}' AS a, '{b}' AS b, {r(f'sum({x} * {y})', 0 if 'l_extendedprice' in (a, b) else 4)} AS value FROM lineitem GROUP BY 1"
        for i, (a, x) in enumerate(_TERMS) for b, y in _TERMS[i:] if (a, b) != ("l_extendedprice", "l_extendedprice")
    ),
)
def fold_moments(spark, folder):
    rows = read_table(spark, folder, "lineitem").withColumn("fold", F.pmod("l_orderkey", F.lit(5)).cast("int"))
    table = moment_table(rows, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "fold")
    # squared prices have more digits than a sum of doubles keeps in any order
    table = table.where("not (a = 'l_extendedprice' and b = 'l_extendedprice')")
    price = (F.col("a") == "l_extendedprice") | (F.col("b") == "l_extendedprice")
    return table.select("fold", "a", "b", F.when(price, rounded("value", 0)).otherwise(rounded("value", 4)).alias("value"))


@query("shuffled_folds_orders")
def shuffled_folds_orders(spark, folder):
    orders = read_table(spark, folder, "orders")
    return orders.select("o_orderkey", shuffled_fold(["o_orderkey"], 5, 9).alias("fold"))


@query(
    "split_lineitem",
    f"WITH t AS (SELECT o_orderkey, (o_orderkey % 1000003) * 7919 + 42 * 104729 AS m FROM orders) SELECT o_orderkey, "
    "(((m % 10007) * (m % 10007) + m) % 10007) / 10007.0 < 0.7 AS is_train FROM t",
)
def split_lineitem(spark, folder):
    return with_split(read_table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


# ---- scaling --------------------------------------------------------------------------------


def _scale_sql(expression: str) -> str:
    stats = ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(MEASURES))
    cells = ", ".join(f"{r(expression.format(c=c, i=i))} AS {c}" for i, c in enumerate(MEASURES))
    return f"WITH s AS (SELECT {stats} FROM lineitem) SELECT {LINE_KEY_SQL}, {cells} FROM lineitem, s"


@query("autoscale_lineitem", _scale_sql("({c} - m{i}) / s{i}"))
def autoscale_lineitem(spark, folder):
    scaled = autoscale(read_table(spark, folder, "lineitem").select(*LINE_KEY, *MEASURES), MEASURES)
    return scaled.select(*LINE_KEY, *[rounded(c).alias(c) for c in MEASURES])


@query("unscale_lineitem", _scale_sql("({c} - m{i}) / s{i} * s{i} + m{i}").replace(", 6)", ", 4)"))
def unscale_lineitem(spark, folder):
    rows = read_table(spark, folder, "lineitem").select(*LINE_KEY, *MEASURES)
    scaler = fit_scaler(rows, MEASURES)
    return scaler.unscale(scaler.autoscale(rows)).select(*LINE_KEY, *[rounded(c, 4).alias(c) for c in MEASURES])


# ---- outlier limits -------------------------------------------------------------------------

_HAMPEL = (
    "m AS (SELECT event_type, median(value) AS c FROM events GROUP BY 1), "
    "l AS (SELECT event_type, any_value(c) - 3 * 1.4826 * median(abs(value - c)) AS lower, "
    "any_value(c) + 3 * 1.4826 * median(abs(value - c)) AS upper FROM events JOIN m USING (event_type) GROUP BY 1)"
)


@query(
    "hampel_events",
    f"WITH {_HAMPEL} SELECT event_id, event_type, {r('value')} AS value, {r('lower')} AS lower, {r('upper')} AS upper "
    "FROM events JOIN l USING (event_type) WHERE value < lower OR value > upper",
)
def hampel_events(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "event_type", "value")
    flagged = flag_outside(events, "value", hampel_limits(events, "value", ["event_type"]), ["event_type"])
    return flagged.where("is_outlier").select("event_id", "event_type", *[rounded(c).alias(c) for c in ("value", "lower", "upper")])


@query(
    "three_sigma_events",
    "WITH l AS (SELECT event_type, avg(value) - 3 * stddev_pop(value) AS lower, avg(value) + 3 * stddev_pop(value) AS upper "
    f"FROM events GROUP BY 1) SELECT event_type, count(*) AS n, {r('any_value(lower)')} AS lower, {r('any_value(upper)')} AS upper, "
    "sum(CASE WHEN value < lower OR value > upper THEN 1 ELSE 0 END)::BIGINT AS flagged FROM events JOIN l USING (event_type) GROUP BY 1",
)
def three_sigma_events(spark, folder):
    flagged = three_sigma(read_table(spark, folder, "events").select("event_type", "value"), "value", ["event_type"])
    return flagged.groupBy("event_type").agg(
        F.count("*").alias("n"), rounded(F.first("lower")).alias("lower"), rounded(F.first("upper")).alias("upper"),
        F.count_if("is_outlier").alias("flagged"),
    )


@query(
    "three_sigma_prices",
    "SELECT " + r("avg(l_extendedprice) - 3 * stddev_pop(l_extendedprice)") + " AS lower, "
    + r("avg(l_extendedprice) + 3 * stddev_pop(l_extendedprice)") + " AS upper FROM lineitem",
)
def three_sigma_prices(spark, folder):
    limits = three_sigma_limits(read_table(spark, folder, "lineitem"), "l_extendedprice")
    return limits.select(rounded("lower").alias("lower"), rounded("upper").alias("upper"))


# ---- smoothing and lags ---------------------------------------------------------------------


def _savgol_sql(points: str, key: str, window: int, deriv: int) -> str:
    """Quadratic least-squares smoothing of ``points`` (key, p, n, v) with orthogonal polynomials."""
    half = window // 2
    squares = sum(j * j for j in range(-half, half + 1))
    middle = squares / window
    quartic = sum((j * j - middle) ** 2 for j in range(-half, half + 1))
    j, t = "(b.p - a.s - {h})".format(h=half), "(a.p - a.s - {h})".format(h=half)
    weight = {
        0: f"1.0 / {window} + {t} * {j} / {squares}::DOUBLE + ({t} * {t} - {middle}::DOUBLE) * ({j} * {j} - {middle}::DOUBLE) / {quartic}::DOUBLE",
        1: f"{j} / {squares}::DOUBLE + 2 * {t} * ({j} * {j} - {middle}::DOUBLE) / {quartic}::DOUBLE",
        2: f"2 * ({j} * {j} - {middle}::DOUBLE) / {quartic}::DOUBLE",
    }[deriv]
    return (
        f"q AS ({points}), a AS (SELECT *, least(greatest(p - {half}, 0), n - {window}) AS s FROM q WHERE n >= {window}), "
        f"sm AS (SELECT a.{key}, a.p, sum(b.v * ({weight})) AS z FROM a JOIN q b ON a.{key} = b.{key} AND b.p BETWEEN a.s AND a.s + {window - 1} "
        f"GROUP BY 1, 2)"
    )


_SPECTRA = "SELECT vec_id, i AS p, 64 AS n, v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def _register_spectra(deriv: int) -> None:
    sql = f"WITH {_savgol_sql(_SPECTRA, 'vec_id', 21, deriv)} SELECT vec_id, p AS position, {r('z', 8)} AS smoothed FROM sm"

    @query(f"savgol_embeddings_d{deriv}", sql)
    def savgol_embeddings(spark, folder):
        rows = smooth_spectra(read_table(spark, folder, "embeddings").select("vec_id", "embedding"), "embedding", 21, 2, deriv)
        long = rows.select("vec_id", F.posexplode("embedding").alias("position", "smoothed"))
        return long.select("vec_id", F.col("position").cast("long").alias("position"), rounded("smoothed", 8).alias("smoothed"))


for _d in (0, 1, 2):
    _register_spectra(_d)


_SERIES = (
    "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS p, "
    "count(*) OVER (PARTITION BY event_type) AS n, value AS v FROM events"
)


@query(
    "smoothed_events",
    f"WITH {_savgol_sql(_SERIES, 'event_type', 61, 0)} SELECT event_id, {r('z')} AS smoothed FROM q JOIN sm USING (event_type, p)",
)
def smoothed_events(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "event_type", "ts", "value")
    rows = smooth_series(events, ["ts", "event_id"], "value", 61, 2, 0, ["event_type"])
    return rows.select("event_id", rounded("smoothed").alias("smoothed"))


@query(
    "savgol_hampel_events",
    f"WITH {_savgol_sql(_SERIES, 'event_type', 61, 0)}, e AS (SELECT event_type, event_id, v, z, v - z AS d FROM q JOIN sm USING (event_type, p)), "
    "m AS (SELECT event_type, median(d) AS c FROM e GROUP BY 1), w AS (SELECT event_type, any_value(c) AS c, median(abs(d - c)) AS mad "
    "FROM e JOIN m USING (event_type) GROUP BY 1), f AS (SELECT event_type, event_id, v, z + c - 3 * 1.4826 * mad AS lower, "
    f"z + c + 3 * 1.4826 * mad AS upper FROM e JOIN w USING (event_type)) SELECT event_id, event_type, {r('v')} AS value, {r('lower')} AS lower, "
    f"{r('upper')} AS upper FROM f WHERE v < lower OR v > upper",
)
def savgol_hampel_events(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "event_type", "ts", "value")
    flagged = savgol_hampel(events, ["ts", "event_id"], "value", ["event_type"]).where("is_outlier")
    return flagged.select("event_id", "event_type", *[rounded(c).alias(c) for c in ("value", "lower", "upper")])


_LAGS = ", ".join(
    [r("value") + " AS value"]
    + [f"{r(f'lag({c}::DOUBLE, {2 * i}) OVER s' if i else c + '::DOUBLE')} AS {c}_{i}" for c in ("value", "user_id") for i in range(4)]
)


@query(
    "lag_events",
    f"SELECT * FROM (SELECT event_type, row_number() OVER s - 1 AS \"row\", {_LAGS} FROM events "
    "WINDOW s AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE \"row\" >= 7",
)
def lag_events(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "event_type", "ts", "value", "user_id")
    table = lag_table(events, ["ts", "event_id"], "value", ["value", "user_id"], 7, 2, ["event_type"])
    return table.select("event_type", "row", *[
        rounded(F.col(c).cast("double")).alias(c) for c in table.columns if c not in ("event_type", "row")
    ])


@query(
    "lag_all_events",
    "SELECT count(*) AS n, " + ", ".join(f"{r(f'sum(value_{i})', 2)} AS value_{i}" for i in range(1, 51)) + " FROM (SELECT row_number() OVER s - 1 AS p, "
    + ", ".join(f"lag(value, {i}) OVER s AS value_{i}" for i in range(1, 51)) + " FROM events WINDOW s AS (ORDER BY ts, event_id)) WHERE p >= 50",
)
def lag_all_events(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "ts", "value")
    table = lag_table(events, ["ts", "event_id"], "value", ["value"], 50)
    return table.agg(F.count("*").alias("n"), *[rounded(F.sum(f"value_{i}"), 2).alias(f"value_{i}") for i in range(1, 51)])


# ---- feature pruning ------------------------------------------------------------------------

_PART_FEATURES = ["p_size", "p_retailprice", "mostly_zero", "mostly_missing"]
_PART_SQL = (
    "SELECT p_size::DOUBLE AS p_size, p_retailprice, CASE WHEN p_partkey % 10 = 0 THEN p_partkey::DOUBLE ELSE 0.0 END AS mostly_zero, "
    "CASE WHEN p_partkey % 7 = 0 THEN p_partkey::DOUBLE END AS mostly_missing FROM part"
)


def _part(spark, folder):
    key = F.col("p_partkey")
    return read_table(spark, folder, "part").select(
        "p_partkey", "p_size", "p_retailprice", F.when(key % 10 == 0, key.cast("double")).otherwise(0.0).alias("mostly_zero"),
        F.when(key % 7 == 0, key.cast("double")).alias("mostly_missing"),
    )


_LONG_PART = f"SELECT unnest({_PART_FEATURES}) AS feature, unnest([p_size, p_retailprice, mostly_zero, mostly_missing]) AS value FROM ({_PART_SQL})"
_RATES = f"SELECT feature, max(c) / (SELECT count(*) FROM part)::DOUBLE AS rate FROM (SELECT feature, value, count(*) AS c FROM ({_LONG_PART}) GROUP BY 1, 2) GROUP BY 1"


@query(
    "value_counts_part",
    f"SELECT feature, {r('value')} AS value, count(*) AS n, {r('count(*) / (SELECT count(*) FROM part)::DOUBLE', 8)} AS rate FROM ({_LONG_PART}) AS u "
    "WHERE feature = 'p_size' GROUP BY feature, u.value",
)
def value_counts_part(spark, folder):
    table = X.value_counts(_part(spark, folder), ["p_size"])
    return table.select("feature", rounded("value").alias("value"), "n", rounded("rate", 8).alias("rate"))


@query("dominant_rates_part", f"SELECT feature, {r('rate', 8)} AS rate FROM ({_RATES})")
def dominant_rates_part(spark, folder):
    rates = X.dominant_rates(_part(spark, folder), _PART_FEATURES)
    return rates.select("feature", rounded("rate", 8).alias("rate"))


@query(
    "drop_dominant_part",
    "SELECT p_partkey, p_size, " + r("p_retailprice") + " AS p_retailprice FROM part",
)
def drop_dominant_part(spark, folder):
    return X.drop_dominant(_part(spark, folder), _PART_FEATURES, 0.8).withColumn("p_retailprice", rounded("p_retailprice"))


_MIXED = ["l_quantity", "l_discount", "l_tax", "mixed"]
_MIXED_SQL = f"SELECT {LINE_KEY_SQL}, l_quantity, l_discount, l_tax, l_quantity + 60 * l_discount AS mixed FROM lineitem"


def _mixed(spark, folder):
    rows = read_table(spark, folder, "lineitem")
    return rows.select(*LINE_KEY, "l_quantity", "l_discount", "l_tax", (F.col("l_quantity") + 60 * F.col("l_discount")).alias("mixed"))


_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, " + ("1.0::DOUBLE" if a == b else f"abs(corr({a}, {b}))") + " AS abs_r"
    + (f" FROM ({_MIXED_SQL})" if a != b else "")
    for a in _MIXED for b in _MIXED
)


@query("correlation_pairs", f"SELECT feature_a, feature_b, {r('abs_r', 8)} AS abs_r FROM ({_PAIRS})")
def correlation_pairs(spark, folder):
    table = X.correlation_pairs(_mixed(spark, folder), _MIXED)
    return table.select("feature_a", "feature_b", rounded("abs_r", 8).alias("abs_r"))


# the most correlated pair is unique here, and only that pair passes the threshold
_DROPPED = (
    f"p AS ({_PAIRS}), o AS (SELECT feature_a, sum(abs_r) AS total FROM p WHERE feature_a <> feature_b GROUP BY 1), "
    "top AS (SELECT feature_a FROM p WHERE feature_a <> feature_b AND abs_r >= 0.9), "
    "gone AS (SELECT feature_a AS feature FROM o WHERE feature_a IN (SELECT feature_a FROM top) ORDER BY total DESC LIMIT 1)"
)


@query(
    "drop_correlated",
    f"WITH {_DROPPED} SELECT f AS feature, f NOT IN (SELECT feature FROM gone) AS is_kept FROM (SELECT unnest({_MIXED}) AS f)",
)
def drop_correlated(spark, folder):
    table = _mixed(spark, folder)
    kept = X.drop_correlated(table, _MIXED, 0.9).columns
    return spark.createDataFrame([(f, f in kept) for f in _MIXED], "feature string, is_kept boolean")


@query(
    "similarity_matrix",
    f"WITH p AS ({_PAIRS}) SELECT feature_a AS feature, " + ", ".join(
        f"{r(f'max(CASE WHEN feature_b = {chr(39)}{c}{chr(39)} THEN abs_r END)', 8)} AS {c}" for c in ("mixed", "l_tax")
    ) + " FROM p WHERE feature_a IN ('l_quantity', 'l_discount') GROUP BY 1",
)
def similarity_matrix(spark, folder):
    table = X.similarity_matrix(_mixed(spark, folder), ["l_quantity", "l_discount"], ["mixed", "l_tax"])
    return table.select("feature", rounded("mixed", 8).alias("mixed"), rounded("l_tax", 8).alias("l_tax"))


@query(
    "cluster_features",
    f"WITH p AS ({_PAIRS}), f AS (SELECT unnest(range(4))::INTEGER AS position, unnest({_MIXED}) AS feature), "
    "j AS (SELECT a.position, a.feature, min(b.position) AS first FROM f a JOIN p ON p.feature_a = a.feature AND (p.abs_r > 0.9 OR p.feature_a = p.feature_b) "
    "JOIN f b ON b.feature = p.feature_b GROUP BY 1, 2) "
    "SELECT position, feature, (dense_rank() OVER (ORDER BY first) - 1)::INTEGER AS cluster_number, first = position AS is_selected FROM j",
)
def cluster_features(spark, folder):
    return X.cluster_features(_mixed(spark, folder), _MIXED, 0.9)


@query(
    "average_clusters",
    f"WITH t AS ({_MIXED_SQL}), s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(mixed) AS mm, stddev_samp(mixed) AS sm FROM t) "
    f"SELECT {LINE_KEY_SQL}, {r('((l_quantity - mq) / sq + (mixed - mm) / sm) / 2')} AS mean_in_cluster_0, {r('l_discount')} AS l_discount, {r('l_tax')} AS l_tax FROM t, s",
)
def average_clusters(spark, folder):
    table = _mixed(spark, folder)
    averaged = X.average_clusters(table, LINE_KEY, X.cluster_features(table, _MIXED, 0.9))
    return averaged.select(*LINE_KEY, *[rounded(c).alias(c) for c in averaged.columns if c not in LINE_KEY])


@query(
    "group_means_embeddings",
    "SELECT label, i AS position, " + r("avg(v)", 8) + " AS mean FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v "
    "FROM embeddings) GROUP BY 1, 2",
)
def group_means_embeddings(spark, folder):
    long = read_table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("position", "v"))
    means = long.groupBy("label", F.col("position").cast("long").alias("position")).agg(F.avg(F.col("v").cast("double")).alias("mean"))
    return means.withColumn("mean", rounded("mean", 8))


@query(
    "row_means_embeddings",
    "SELECT vec_id, " + r("(embedding[1]::DOUBLE + embedding[2]::DOUBLE + embedding[3]::DOUBLE) / 3", 8) + " AS mean FROM embeddings",
)
def row_means_embeddings(spark, folder):
    rows = X.spread_array(read_table(spark, folder, "embeddings"), "embedding", ["vec_id"])
    return rows.select("vec_id", rounded(row_mean([f"embedding_{i}" for i in range(3)]), 8).alias("mean"))


@query(
    "value_counts_orders",
    "SELECT feature, value, count(*) AS n, " + r("count(*) / (SELECT count(*) FROM orders)::DOUBLE", 8) + " AS rate FROM "
    "(SELECT unnest(['o_orderstatus', 'o_orderpriority']) AS feature, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders) GROUP BY 1, 2",
)
def value_counts_orders(spark, folder):
    table = X.value_counts(read_table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])
    return table.select("feature", "value", "n", rounded("rate", 8).alias("rate"))


@query("drop_dominant_text_part", "SELECT p_partkey, p_brand FROM part")
def drop_dominant_text_part(spark, folder):
    part = read_table(spark, folder, "part").select(
        "p_partkey", "p_brand", F.when(F.col("p_partkey") % 10 == 0, F.col("p_name")).otherwise("same").alias("mostly_same")
    )
    return X.drop_dominant(part, ["p_brand", "mostly_same"], 0.8)


_SOME_NAN = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, " + ("1.0::DOUBLE" if a == b else f"abs(corr({a}, {b}))") + " AS abs_r"
    + (f" FROM ({_MIXED_SQL} WHERE l_linenumber <> 3)" if a != b else "")
    for a in _MIXED for b in _MIXED
)


@query("correlation_pairs_nan", f"SELECT feature_a, feature_b, {r('abs_r', 8)} AS abs_r FROM ({_SOME_NAN})")
def correlation_pairs_nan(spark, folder):
    nan = F.when(F.col("l_linenumber") == 3, F.lit(float("nan")))
    rows = _mixed(spark, folder).withColumn("mixed", F.coalesce(nan, F.col("mixed")))
    return X.correlation_pairs(rows, _MIXED).select("feature_a", "feature_b", rounded("abs_r", 8).alias("abs_r"))

"""Queries for sources, row and column selection, joins, reshaping and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayline.catalog.registry import query, rounded, sql_rounded
from assayline.functions import scalar as S
from assayline.operators import reshape as R
from assayline.operators.encode import category_codes, dummies_long, dummy_variables
from assayline.operators.features import spread_array, unpivot_features
from assayline.operators.scale import numeric_columns
from assayline.operators.signal import wavelength_table
from assayline.plans.ordered import with_folds
from assayline.session import scratch_folder
from assayline.sources import tables as A
from assayline.streaming.frozen import flag_stream

r = sql_rounded


# ---- sources and sinks ----------------------------------------------------------------------


@query(
    "csv_customer",
    f"SELECT c_custkey, c_name, c_nationkey, {r('c_acctbal')} AS c_acctbal, c_mktsegment, "
    "c_acctbal < 0 AS in_debt FROM customer",
)
def csv_customer(spark, folder):
    table = A.read_table(spark, folder, "customer").withColumn("in_debt", F.col("c_acctbal") < 0)
    path = scratch_folder(spark, "csv_customer")
    A.write_result(table, path)
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string, in_debt boolean"
    return A.read_samples(spark, path, "c_custkey", schema).withColumn("c_acctbal", rounded("c_acctbal"))


@query(
    "delimited_part",
    "SELECT p_partkey AS f0, p_size AS f1, " + r("p_retailprice") + " AS f2 FROM part",
)
def delimited_part(spark, folder):
    table = A.read_table(spark, folder, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    path = scratch_folder(spark, "delimited_part")
    table.write.mode("overwrite").csv(path, sep=" ", header=False)
    back = A.read_delimited(spark, path, " ", [0, 2, 3], "f")
    return back.select(F.col("f0").cast("long").alias("f0"), F.col("f1").cast("int").alias("f1"), rounded("f2").alias("f2"))


@query("results_by_status", "SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY 1")
def results_by_status(spark, folder):
    path = scratch_folder(spark, "results_by_status")
    orders = A.read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    A.write_result(orders, path, ["o_orderstatus"])
    back = A.read_samples(spark, path, "o_orderkey")
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_custkey").cast("long")).alias("keys"))


@query("label_file", "SELECT doc_id, quality AS label FROM labels")
def label_file(spark, folder):
    path = scratch_folder(spark, "label_file")
    A.read_table(spark, folder, "labels").select("doc_id", "quality").write.mode("overwrite").csv(path, header=False)
    labels = A.read_labels(spark, path, id_col="doc_id")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))


@query(
    "labelled_documents",
    "SELECT l.quality, count(*) AS n, sum(d.n_chars)::BIGINT AS chars FROM documents d JOIN labels l USING (doc_id) GROUP BY 1",
)
def labelled_documents(spark, folder):
    both = A.attach_labels(A.read_table(spark, folder, "documents"), A.read_table(spark, folder, "labels"), "doc_id")
    return both.groupBy("quality").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "sample_ids_orders",
    "SELECT o_orderkey, 'sample_' || row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS sample FROM orders",
)
def sample_ids_orders(spark, folder):
    orders = A.read_table(spark, folder, "orders").select("o_orderdate", "o_orderkey")
    return A.sample_ids(orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "sample")


@query(
    "row_index_part",
    'SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 + 50 AS "row" FROM part',
)
def row_index_part(spark, folder):
    part = A.read_table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return A.row_index(part, ["p_retailprice", "p_partkey"], 50).select("p_partkey", "row")


# ---- selection ------------------------------------------------------------------------------


@query(
    "typed_columns_supplier",
    "SELECT s_suppkey AS num_s_suppkey, s_nationkey AS num_s_nationkey, " + r("s_acctbal") + " AS num_s_acctbal FROM supplier",
)
def typed_columns_supplier(spark, folder):
    table = A.read_table(spark, folder, "supplier")
    numeric = table.select(*numeric_columns(table)).withColumn("s_acctbal", rounded("s_acctbal"))
    return numeric.withColumnsRenamed({c: f"num_{c}" for c in numeric.columns})


@query("columns_by_position", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def columns_by_position(spark, folder):
    table = A.read_table(spark, folder, "orders")
    return table.select(*[table.columns[i] for i in (0, 2, 5)])


@query(
    "members_part",
    "SELECT p_brand, count(*) AS n FROM part WHERE p_brand IN ('Brand#1', 'Brand#12', 'Brand#25') "
    "AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) GROUP BY 1",
)
def members_part(spark, folder):
    part = A.read_table(spark, folder, "part").select("p_partkey", "p_brand")
    bulky = A.read_table(spark, folder, "lineitem").where("l_quantity >= 50").select("l_partkey")
    kept = R.drop_members(R.keep_members(part, "p_brand", ["Brand#1", "Brand#12", "Brand#25"]), "p_partkey", bulky)
    return kept.groupBy("p_brand").agg(F.count("*").alias("n"))


@query(
    "rows_at_minimum_part",
    "SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT min(p_size) FROM part)",
)
def rows_at_minimum_part(spark, folder):
    return R.rows_at_minimum(A.read_table(spark, folder, "part").select("p_partkey", "p_size"), "p_size")


BLANK_SIZE = "CASE WHEN (p_partkey * 7 + 1) % 11 = 0 THEN 999 ELSE p_size END"


@query(
    "sentinel_part",
    f"WITH t AS (SELECT p_brand, {BLANK_SIZE} AS s FROM part) SELECT p_brand, count(nullif(s, 999)) AS known, "
    "sum(nullif(s, 999))::BIGINT AS total, sum(CASE WHEN s = 999 THEN 1 ELSE 0 END)::BIGINT AS restored FROM t GROUP BY 1",
)
def sentinel_part(spark, folder):
    part = A.read_table(spark, folder, "part").select("p_brand", F.expr(BLANK_SIZE).alias("s"))
    clean = S.sentinel_to_null(part, ["s"], 999).withColumn("back", F.col("s"))
    clean = S.null_to_sentinel(clean, ["back"], 999)
    return clean.groupBy("p_brand").agg(
        F.count("s").alias("known"), F.sum("s").alias("total"), F.count_if(F.col("back") == 999).alias("restored")
    )


BLANKED = (
    "CASE WHEN (l_orderkey * 7 + 1) % 11 <> 0 THEN l_quantity END AS a, "
    "CASE WHEN (l_orderkey * 7 + l_linenumber) % 11 <> 0 THEN l_discount END AS b, "
    "CASE WHEN (l_orderkey * 7 + 3) % 11 <> 0 THEN l_tax END AS c"
)


@query(
    "missing_patterns_lineitem",
    f"WITH t AS (SELECT {BLANKED} FROM lineitem), m AS (SELECT *, (CASE WHEN a IS NULL THEN '1' ELSE '0' END) || "
    "(CASE WHEN b IS NULL THEN '1' ELSE '0' END) || (CASE WHEN c IS NULL THEN '1' ELSE '0' END) AS pattern FROM t) "
    f"SELECT pattern, count(*) AS n, {r('sum(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0))', 3)} AS total, "
    "sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS complete FROM m GROUP BY 1",
)
def missing_patterns_lineitem(spark, folder):
    rows = A.read_table(spark, folder, "lineitem").selectExpr(*BLANKED.split(", "))
    marked = rows.withColumn("pattern", S.missing_pattern(["a", "b", "c"])).withColumn(
        "whole", F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("c").isNotNull()
    )
    total = F.sum(F.col("a") + F.col("b") + F.col("c"))
    return marked.fillna(0.0, ["a", "b", "c"]).groupBy("pattern").agg(
        F.count("*").alias("n"), rounded(total, 3).alias("total"), F.count_if("whole").alias("complete")
    )


@query(
    "conditional_events",
    "SELECT event_type, CASE WHEN value < 10 THEN 'low' WHEN value < 100 THEN 'middle' ELSE 'high' END AS band, "
    "count(*) AS n FROM events GROUP BY 1, 2",
)
def conditional_events(spark, folder):
    v = F.col("value")
    band = F.when(v < 10, "low").when(v < 100, "middle").otherwise("high")
    return A.read_table(spark, folder, "events").groupBy("event_type", band.alias("band")).agg(F.count("*").alias("n"))


# ---- joins ----------------------------------------------------------------------------------


@query(
    "glued_columns_orders",
    "SELECT o_orderkey, o_orderstatus, " + r("o_totalprice / 1000") + " AS price_k, length(o_orderpriority) AS n_text FROM orders",
)
def glued_columns_orders(spark, folder):
    orders = A.read_table(spark, folder, "orders")
    left = orders.select("o_orderkey", "o_orderstatus", rounded(F.col("o_totalprice") / 1000).alias("price_k"))
    right = orders.select("o_orderkey", F.length("o_orderpriority").cast("long").alias("n_text"))
    return left.join(right, "o_orderkey")


@query(
    "parameter_grid_part",
    "SELECT p_partkey, c, g, " + r("p_retailprice * power(2.0, c) / power(2.0, g)") + " AS v FROM part, "
    "(SELECT unnest([-1, 0, 1]) AS c) a, (SELECT unnest([2, 4]) AS g) b",
)
def parameter_grid_part(spark, folder):
    part = A.read_table(spark, folder, "part").select("p_partkey", "p_retailprice")
    grid = part.withColumn("c", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn(
        "g", F.explode(F.array(*map(F.lit, (2, 4))))
    )
    two = F.lit(2.0)
    return grid.select(
        "p_partkey", "c", "g", rounded(F.col("p_retailprice") * F.pow(two, "c") / F.pow(two, "g")).alias("v")
    )


@query(
    "blocks_part",
    "SELECT p_partkey, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 1 WHEN p_size < 45 THEN 2 END AS block FROM part",
)
def blocks_part(spark, folder):
    part = A.read_table(spark, folder, "part")
    return part.select("p_partkey", R.block_of("p_size", [10, 20, 45]).alias("block"))


# ---- first, best, order ---------------------------------------------------------------------


@query(
    "best_order_per_customer",
    f"SELECT o_custkey, o_orderkey, {r('o_totalprice')} AS o_totalprice FROM (SELECT *, row_number() OVER "
    "(PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1",
)
def best_order_per_customer(spark, folder):
    orders = A.read_table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    best = R.best_rows(orders, "o_totalprice", ["o_custkey"], ["o_orderkey"], largest=True)
    return best.withColumn("o_totalprice", rounded("o_totalprice"))


@query(
    "top_part",
    "SELECT p_partkey, p_size, " + r("p_retailprice") + " AS p_retailprice FROM part ORDER BY part.p_retailprice DESC, p_partkey LIMIT 1",
)
def top_part(spark, folder):
    part = A.read_table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    top = part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(1)
    return top.withColumn("p_retailprice", rounded("p_retailprice"))


@query(
    "first_event_per_user",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) "
    "AS k FROM events) WHERE k = 1",
)
def first_event_per_user(spark, folder):
    events = A.read_table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    return R.first_per_group(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "listed_order_orders",
    "SELECT o_orderpriority, list_position(['5-LOW', '1-URGENT', '3-MEDIUM', '2-HIGH'], o_orderpriority) - 1 AS place, "
    "count(*) AS n FROM orders GROUP BY 1",
)
def listed_order_orders(spark, folder):
    counts = A.read_table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    place = R.in_list_order("o_orderpriority", ["5-LOW", "1-URGENT", "3-MEDIUM", "2-HIGH"])
    return counts.withColumn("place", place.cast("int")).orderBy("place")


# ---- reshaping ------------------------------------------------------------------------------


@query(
    "unpivot_lineitem",
    "SELECT feature, count(*) AS n, " + r("sum(v)", 2) + " AS total FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) "
    "AS feature, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem) GROUP BY 1",
)
def unpivot_lineitem(spark, folder):
    long = unpivot_features(A.read_table(spark, folder, "lineitem"), [], ["l_quantity", "l_discount", "l_tax"])
    return long.groupBy("feature").agg(F.count("*").alias("n"), rounded(F.sum("value"), 2).alias("total"))


@query(
    "appended_parties",
    "SELECT kind, count(*) AS n, " + r("sum(balance)", 2) + " AS total FROM (SELECT 'customer' AS kind, c_acctbal AS balance FROM customer "
    "UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY 1",
)
def appended_parties(spark, folder):
    customers = A.read_table(spark, folder, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"))
    suppliers = A.read_table(spark, folder, "supplier").select(F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"))
    both = customers.unionByName(suppliers)
    return both.groupBy("kind").agg(F.count("*").alias("n"), rounded(F.sum("balance"), 2).alias("total"))


@query(
    "unsold_brands",
    "SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 40 EXCEPT SELECT DISTINCT p_brand, p_type FROM part WHERE p_size < 3",
)
def unsold_brands(spark, folder):
    part = A.read_table(spark, folder, "part")
    return part.where("p_size > 40").select("p_brand", "p_type").subtract(part.where("p_size < 3").select("p_brand", "p_type"))


@query(
    "transposed_means",
    "WITH s AS (SELECT l_returnflag AS f, avg(l_quantity) AS l_quantity, avg(l_discount) AS l_discount FROM lineitem GROUP BY 1) "
    "SELECT 'l_quantity' AS feature, " + ", ".join(f"{r(f'max(CASE WHEN f = {chr(39)}{c}{chr(39)} THEN l_quantity END)')} AS {c}" for c in "ANR") + " FROM s "
    "UNION ALL SELECT 'l_discount', " + ", ".join(f"{r(f'max(CASE WHEN f = {chr(39)}{c}{chr(39)} THEN l_discount END)')}" for c in "ANR") + " FROM s",
)
def transposed_means(spark, folder):
    means = A.read_table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        F.avg("l_quantity").alias("l_quantity"), F.avg("l_discount").alias("l_discount")
    )
    turned = R.transpose_by(means, "l_returnflag", ["l_quantity", "l_discount"], ["A", "N", "R"])
    return turned.select("feature", *[rounded(c).alias(c) for c in "ANR"])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "dummy_orders",
    "SELECT o_orderkey, o_custkey, " + r("o_totalprice") + " AS o_totalprice, "
    + ", ".join(f"o_orderstatus = '{v}' AS \"o_orderstatus_{v}\"" for v in "FOP") + ", "
    + ", ".join(f"o_orderpriority = '{v}' AS \"o_orderpriority_{v}\"" for v in PRIORITIES) + " FROM orders",
)
def dummy_orders(spark, folder):
    orders = A.read_table(spark, folder, "orders").drop("o_orderdate")
    return dummy_variables(orders, "o_orderkey").withColumn("o_totalprice", rounded("o_totalprice"))


@query(
    "category_codes_orders",
    "WITH f AS (SELECT o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1), "
    "c AS (SELECT o_orderpriority, (row_number() OVER (ORDER BY k) - 1)::INTEGER AS code FROM f) "
    "SELECT o_orderkey, code FROM orders JOIN c USING (o_orderpriority)",
)
def category_codes_orders(spark, folder):
    orders = A.read_table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return category_codes(orders, "o_orderpriority", ["o_orderkey"]).select("o_orderkey", "code")


@query(
    "array_round_trip",
    "SELECT l_returnflag, " + r("sum(l_quantity)", 3) + " AS q, " + r("sum(l_discount)", 3) + " AS d FROM lineitem GROUP BY 1",
)
def array_round_trip(spark, folder):
    rows = A.read_table(spark, folder, "lineitem").select("l_returnflag", F.array("l_quantity", "l_discount").alias("v"))
    wide = rows.select("l_returnflag", *S.spread(F.col("v"), ["q", "d"]))
    return wide.groupBy("l_returnflag").agg(rounded(F.sum("q"), 3).alias("q"), rounded(F.sum("d"), 3).alias("d"))


@query(
    "explode_ranges_part",
    "SELECT p_type, i AS index, count(*) AS n FROM (SELECT p_type, unnest(range(p_size, least(p_size + p_partkey % 7, 50))) AS i "
    "FROM part) GROUP BY 1, 2",
)
def explode_ranges_part(spark, folder):
    part = A.read_table(spark, folder, "part").select("p_type", "p_size", F.pmod("p_partkey", F.lit(7)).alias("w"))
    return R.explode_regions(part, F.col("p_size"), F.col("w"), 50).groupBy("p_type", "index").agg(F.count("*").alias("n"))


@query(
    "region_pairs_embeddings",
    "SELECT vec_id, k, floor(abs(embedding[2*k+1]::DOUBLE) * 64)::BIGINT AS start, "
    "floor(abs(embedding[2*k+2]::DOUBLE) * 64)::BIGINT AS width FROM embeddings, (SELECT unnest(range(5)) AS k)",
)
def region_pairs_embeddings(spark, folder):
    genes = F.transform("embedding", lambda v: F.abs(v.cast("double")) * 64)
    rows = A.read_table(spark, folder, "embeddings").select("vec_id", F.posexplode(S.pairs_of(genes, 5)).alias("k", "p"))
    return rows.select("vec_id", F.col("k").cast("long").alias("k"), "p.start", "p.width")


@query(
    "array_slices_embeddings",
    "SELECT vec_id, " + r("list_sum(embedding[1:3]::DOUBLE[])") + " AS head, " + r("list_sum(embedding[62:64]::DOUBLE[])") + " AS tail FROM embeddings",
)
def array_slices_embeddings(spark, folder):
    def add(a):
        return F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, v: s + v)

    rows = A.read_table(spark, folder, "embeddings")
    return rows.select(
        "vec_id", rounded(add(F.slice("embedding", 1, 3))).alias("head"), rounded(add(F.slice("embedding", -3, 3))).alias("tail")
    )


@query(
    "unique_first_part",
    "SELECT p_brand, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2",
)
def unique_first_part(spark, folder):
    part = A.read_table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    return R.first_per_group(part, ["p_brand", "p_type"], ["p_partkey"])


# ---- scalar functions -----------------------------------------------------------------------


@query(
    "logit_discount",
    "WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount > 0 AND l_discount < 1 "
    "THEN ln(l_discount / (1 - l_discount)) END AS z FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    f"{r('z')} AS z, {r('exp(z) / (1 + exp(z))')} AS back FROM t",
)
def logit_discount(spark, folder):
    rows = A.read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.logit("l_discount").alias("z")
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded("z").alias("z"), rounded(S.inverse_logit("z")).alias("back")
    )


@query(
    "scalar_functions_customer",
    f"SELECT c_custkey, {r('abs(c_acctbal)')} AS a, floor(c_acctbal)::BIGINT AS f, round_even(c_acctbal, 0) + 0.0 AS n, "
    f"{r('sqrt(abs(c_acctbal))')} AS s, {r('ln(1 + abs(c_acctbal))')} AS l, {r('1.0 / nullif(c_acctbal, 0)')} AS i, "
    f"{r('power(c_acctbal / 1000, 2)')} AS p FROM customer",
)
def scalar_functions_customer(spark, folder):
    v = F.col("c_acctbal")
    return A.read_table(spark, folder, "customer").select(
        "c_custkey", rounded(F.abs(v)).alias("a"), F.floor(v).alias("f"), (S.round_half_even(v) + F.lit(0.0)).alias("n"),
        rounded(F.sqrt(F.abs(v))).alias("s"), rounded(F.ln(1 + F.abs(v))).alias("l"), rounded(S.reciprocal(v)).alias("i"),
        rounded(F.pow(v / 1000, F.lit(2))).alias("p"),
    )


@query(
    "powers_and_lines_part",
    "SELECT p_size, e, " + r("p_size * power(2.0, e)") + " AS scaled, " + r("-4.0 + (e + 5) / 2 * 7.0 / 4") + " AS line, count(*) AS n "
    "FROM part, (SELECT unnest([-5, -3, -1, 1, 3]) AS e) GROUP BY 1, 2",
)
def powers_and_lines_part(spark, folder):
    pairs = F.arrays_zip(S.powers_of_two(-5, 4, 2).alias("p"), S.linear_space(-4.0, 3.0, 5).alias("x"))
    rows = A.read_table(spark, folder, "part").select("p_size", F.posexplode(pairs).alias("k", "v"))
    return rows.groupBy("p_size", (F.col("k") * 2 - 5).alias("e")).agg(
        rounded(F.first(F.col("p_size") * F.col("v.p"))).alias("scaled"), rounded(F.first("v.x")).alias("line"),
        F.count("*").alias("n"),
    )


@query(
    "wavelengths_embeddings",
    "SELECT i::INTEGER AS position, (400 + 10 * i)::VARCHAR AS name, (400 + 10 * i)::DOUBLE AS wavelength, "
    + r("avg(v)", 8) + " AS mean FROM (SELECT unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1, 2, 3",
)
def wavelengths_embeddings(spark, folder):
    spectra = spread_array(A.read_table(spark, folder, "embeddings"), "embedding", [])
    named = spectra.toDF(*[str(400 + 10 * i) for i in range(len(spectra.columns))])
    means = unpivot_features(named, [], named.columns).groupBy("feature").agg(rounded(F.avg("value"), 8).alias("mean"))
    table = wavelength_table(named, named.columns)  # one row per column
    return means.join(F.broadcast(table), means["feature"] == table["name"]).select("position", "name", "wavelength", "mean")


@query(
    "first_true_embeddings",
    "SELECT vec_id, nullif(coalesce(list_position(list_transform(embedding, lambda x: x > 0.1::FLOAT), true), 0) - 1, -1)::BIGINT AS first_high "
    "FROM embeddings",
)
def first_true_embeddings(spark, folder):
    flags = F.transform("embedding", lambda v: v > F.lit(0.1).cast("float"))
    return A.read_table(spark, folder, "embeddings").select("vec_id", S.first_true(flags).cast("long").alias("first_high"))


@query(
    "overwrite_embeddings",
    "SELECT vec_id, " + r("list_sum(embedding::DOUBLE[]) - embedding[1]::DOUBLE - embedding[4]::DOUBLE + 1.0 + label") + " AS total FROM embeddings",
)
def overwrite_embeddings(spark, folder):
    rows = A.read_table(spark, folder, "embeddings")
    changed = S.overwrite(F.col("embedding").cast("array<double>"), {0: 1.0, 3: F.col("label").cast("double")})
    return rows.select("vec_id", rounded(F.aggregate(changed, F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query(
    "row_extremes_lineitem",
    "SELECT l_returnflag, " + r("sum((l_quantity + l_discount + l_tax) / 3)", 3) + " AS mean, "
    + r("sum(greatest(l_discount, l_tax))", 3) + " AS high, " + r("sum(least(l_discount, l_tax))", 3) + " AS low FROM lineitem GROUP BY 1",
)
def row_extremes_lineitem(spark, folder):
    rows = A.read_table(spark, folder, "lineitem").withColumn("m", S.row_mean(["l_quantity", "l_discount", "l_tax"]))
    return rows.groupBy("l_returnflag").agg(
        rounded(F.sum("m"), 3).alias("mean"), rounded(F.sum(F.greatest("l_discount", "l_tax")), 3).alias("high"),
        rounded(F.sum(F.least("l_discount", "l_tax")), 3).alias("low"),
    )


@query(
    "contiguous_folds_orders",
    "SELECT o_orderkey, (ntile(5) OVER (ORDER BY o_orderkey) - 1)::INTEGER AS fold FROM orders",
)
def contiguous_folds_orders(spark, folder):
    return with_folds(A.read_table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 5)


@query(
    "category_codes_customer",
    "SELECT c_custkey, (dense_rank() OVER (ORDER BY k) - 1)::INTEGER AS code FROM "
    "(SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_name) AS k FROM customer)",
)
def category_codes_customer(spark, folder):
    customer = A.read_table(spark, folder, "customer").select("c_custkey", "c_name")
    return category_codes(customer, "c_name", ["c_custkey"]).select("c_custkey", "code")


@query(
    "dummies_long_part",
    "SELECT p_partkey, unnest(['p_brand', 'p_type', 'p_name']) AS \"column\", unnest([p_brand, p_type, p_name]) AS level FROM part",
)
def dummies_long_part(spark, folder):
    return dummies_long(A.read_table(spark, folder, "part"), "p_partkey", ["p_brand", "p_type", "p_name"])


@query(
    "flags_of_known_types",
    "SELECT event_id, CASE WHEN event_type < 'm' THEN value > 50 OR value < 5 END AS is_outlier FROM events",
)
def flags_of_known_types(spark, folder):
    events = A.read_table(spark, folder, "events")
    known = events.where(F.col("event_type") < "m").select("event_type").distinct()
    limits = known.select("event_type", F.lit(5.0).alias("lower"), F.lit(50.0).alias("upper"))
    return flag_stream(events, "value", limits, ["event_type"]).select("event_id", "is_outlier")

"""The engine's queries over the sample tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna import catalog
from lacuna.datasets import dataset, surrogate
from lacuna.functions import scalars as S
from lacuna.functions.scalars import uniform, uniform_sql
from lacuna.operators import aqp, completion, etl, models, relational as R, removal, tuple_factors as TF
from lacuna.plans import evaluation, planner, setups
from lacuna.sources.scratch import stored
from lacuna.streaming import events as streaming

GRAPH = catalog.tpch_like()
REL = {f"{r.child}_{r.parent}": r for r in GRAPH.relationships}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


U3 = uniform_sql("'3'", "'keep'", "o_orderkey")


@query(
    """WITH c AS (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS tf FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
    SELECT o_orderstatus, CAST(sum(tf) AS BIGINT) AS expected, count(*) AS orders FROM c GROUP BY 1"""
)
def completed_lineitems(spark, d):
    """Flagship: lineitems are removed by hash, completed from orders with known tuple factors, and counted by status."""
    orders, items = read(spark, d, "orders"), surrogate(read(spark, d, "lineitem"))
    r = REL["lineitem_orders"]
    orders = stored(TF.add_tf(orders.select("o_orderkey", "o_orderstatus"), items.select("l_orderkey"), r), "orders")
    kept = items.select("l_id", "l_orderkey", "l_returnflag").filter(uniform(3, "keep", F.col("l_id")) < 0.5)
    done = completion.join_1n(orders, kept, r, orders, "l_id", ["l_returnflag"], ["o_orderstatus"], seed=3)
    n = done.groupBy("o_orderstatus").agg(F.sum(R.WEIGHT).cast("long").alias("expected"))
    return n.join(orders.groupBy("o_orderstatus").agg(F.count("*").alias("orders")), "o_orderstatus")


@query("SELECT o_orderkey, count(l_orderkey) AS tf_lineitem_l_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def tf_orders_lineitem(spark, d):
    return TF.add_tf(read(spark, d, "orders").select("o_orderkey"), read(spark, d, "lineitem").select("l_orderkey"), REL["lineitem_orders"])


@query("SELECT c_custkey, count(user_id) AS tf_events_user_id FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY 1")
def tf_customer_events(spark, d):
    return TF.add_tf(read(spark, d, "customer").select("c_custkey"), read(spark, d, "events").select("user_id"), REL["events_customer"])


@query(
    f"""WITH k AS (SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (ORDER BY {U3}, o_orderkey) <= CAST(floor(0.6 * (SELECT count(*) FROM orders)) AS BIGINT))
    SELECT c_custkey, count(o_orderkey) AS current_tf FROM customer LEFT JOIN k ON c_custkey = o_custkey GROUP BY 1"""
)
def current_tf_after_removal(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    kept = R.in_keys(orders, "o_orderkey", removal.uniform_keys(orders, "o_orderkey", 0.6, 3))
    return TF.add_tf(read(spark, d, "customer").select("c_custkey"), kept, REL["orders_customer"], "current_tf")


@query(f"SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY {U3}, o_orderkey) <= CAST(floor(0.4 * (SELECT count(*) FROM orders)) AS BIGINT)")
def removal_uniform(spark, d):
    return removal.uniform_keys(read(spark, d, "orders"), "o_orderkey", 0.4, 3)


BIAS = f"""WITH y0 AS (SELECT c_custkey, c_acctbal AS a FROM customer WHERE c_acctbal IS NOT NULL),
 m AS (SELECT min(a) AS lo, max(a) AS hi FROM y0),
 y AS (SELECT c_custkey, (a - lo) / (hi - lo) AS y, {uniform_sql("'5'", "'x'", "c_custkey")} AS x FROM y0, m),
 f AS (SELECT regr_slope(x, y) AS b, regr_intercept(x, y) AS a, stddev_pop(y) AS sy FROM y),
 e AS (SELECT c_custkey, y, sy, x - (a + b * y) AS e FROM y, f), s AS (SELECT stddev_pop(e) AS se FROM e),
 v AS (SELECT c_custkey, 0.6 * se * y + sy * sqrt(1 - 0.36) * e AS v FROM e, s),
 l AS (SELECT least(min(v), 0.0) AS m, sum(v) AS s, count(*) AS n FROM v),
 w AS (SELECT c_custkey, (v - m) / (s - m * n) AS v FROM v, l)"""


@query(
    BIAS
    + f" SELECT c_custkey FROM w QUALIFY row_number() OVER (ORDER BY CASE WHEN v > 0 THEN ln({uniform_sql(chr(39) + '5' + chr(39), chr(39) + 'keep' + chr(39), 'c_custkey')}) / v ELSE '-infinity'::DOUBLE END DESC, c_custkey) <= CAST(floor(0.5 * (SELECT count(*) FROM customer)) AS BIGINT)"
)
def removal_bias(spark, d):
    return removal.bias_keys(read(spark, d, "customer"), "c_custkey", "c_acctbal", 0.5, 0.6, 5)


@query(BIAS + " SELECT c_custkey, round(v, 10) AS v FROM w")
def removal_bias_weights(spark, d):
    w = removal.bias_weights(read(spark, d, "customer"), "c_custkey", "c_acctbal", 0.6, 5)
    return w.select("c_custkey", F.round("v", 10).alias("v"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus IN ('F', 'P')) / CAST(count(o_orderstatus) AS DOUBLE) AS share FROM orders GROUP BY 1")
def removal_categorical_share(spark, d):
    return removal.categorical_weights(read(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "P"])


@query(
    """WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM c)),
    l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
    SELECT (SELECT count(*) FROM o) AS n_orders, (SELECT count(*) FROM l) AS n_items"""
)
def cascade_removal(spark, d):
    frames = {n: read(spark, d, n) for n in ("customer", "orders", "lineitem", "events")}
    frames["lineitem"] = surrogate(frames["lineitem"])
    kept = frames["customer"].filter(~(F.col("c_acctbal") < 0)).select("c_custkey")
    out = removal.remove(GRAPH, frames, "customer", kept)
    return out["orders"].agg(F.count("*").alias("n_orders")).crossJoin(out["lineitem"].agg(F.count("*").alias("n_items")))


@query("SELECT o_orderkey, CASE WHEN c_acctbal >= 0 THEN o_custkey END AS o_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def null_fk_removal(spark, d):
    frames = {n: read(spark, d, n) for n in ("customer", "orders", "events")}
    kept = frames["customer"].filter(F.col("c_acctbal") >= 0).select("c_custkey")
    return removal.remove(GRAPH, frames, "customer", kept, cascade=False)["orders"].select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def no_partner_customers(spark, d):
    return R.without_partner(read(spark, d, "events"), read(spark, d, "customer"), REL["events_customer"]).select("c_custkey", "c_name")


@query(
    f"""WITH t AS (SELECT o_orderkey, count(l_orderkey) AS tf FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
    k AS (SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY {uniform_sql("'3'", "'tf'", "o_orderkey")}, o_orderkey) <= CAST(floor(0.5 * (SELECT count(*) FROM orders)) AS BIGINT))
    SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM k) THEN tf END AS tf FROM t"""
)
def tf_unknown(spark, d):
    r, orders = REL["lineitem_orders"], read(spark, d, "orders")
    t = TF.add_tf(orders.select("o_orderkey"), read(spark, d, "lineitem").select("l_orderkey"), r)
    return R.unknown_tf(t, r, removal.known_tf_keys(orders, "o_orderkey", None, 0.5, 3)).withColumnRenamed(r.tf, "tf")


@query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_inner_3way(spark, d):
    frames = {n: read(spark, d, n) for n in ("nation", "customer", "orders")}
    j = R.join_tables(GRAPH, frames, GRAPH.between(set(frames)), "nation")
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_mktsegment, count(*) AS n, count(event_id) AS events FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY 1")
def join_left_chain(spark, d):
    frames = {n: read(spark, d, n) for n in ("customer", "events")}
    j = R.extend(GRAPH, frames["customer"], {"customer"}, frames, [REL["events_customer"]])
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count("event_id").alias("events"))


@query("SELECT c_custkey AS k, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def union_by_name(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))
    return R.concat(c, s).drop(R.WEIGHT)


def _two_branches(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    c = TF.add_tf(TF.add_tf(c, read(spark, d, "events"), REL["events_customer"]), read(spark, d, "orders"), REL["orders_customer"])
    one = R.join(c, read(spark, d, "events").select("user_id"), REL["events_customer"]).withColumn(R.WEIGHT, 1 / F.col("tf_events_user_id"))
    two = R.join(c, read(spark, d, "orders").select("o_custkey"), REL["orders_customer"]).withColumn(R.WEIGHT, 1 / F.col("tf_orders_o_custkey"))
    return [(one, "tf_events_user_id"), (two, "tf_orders_o_custkey")]


@query("SELECT c_mktsegment, CAST(count(*) AS DOUBLE) AS n FROM customer WHERE c_custkey IN (SELECT user_id FROM events UNION SELECT o_custkey FROM orders) GROUP BY 1")
def top_path_union_combine(spark, d):
    u = R.union_combine(_two_branches(spark, d))
    return u.groupBy("c_mktsegment").agg(F.round(F.sum(R.WEIGHT), 6).alias("n"))


@query(
    """WITH e AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT user_id FROM events)),
    a AS (SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT user_id FROM events UNION SELECT o_custkey FROM orders))
    SELECT c_mktsegment, round(count(*) * (SELECT n FROM a) / CAST((SELECT count(*) FROM e) AS DOUBLE), 6) AS n FROM e GROUP BY 1"""
)
def top_path_union_scale_up(spark, d):
    u = R.union_scale_up(_two_branches(spark, d))
    return u.groupBy("c_mktsegment").agg(F.round(F.sum(R.WEIGHT), 6).alias("n"))


@query("SELECT c_mktsegment, CAST(count(DISTINCT c_custkey) AS DOUBLE) AS customers FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def fanout_weights(spark, d):
    r = REL["orders_customer"]
    c = TF.add_tf(read(spark, d, "customer"), read(spark, d, "orders"), r)
    path = catalog.Path("orders", ((r, "customer"),), frozenset({"customer"}))
    p = completion.project_requested(R.join(c, read(spark, d, "orders"), r), path, ["c_custkey", "c_mktsegment"])
    return p.groupBy("c_mktsegment").agg(F.round(F.sum(R.WEIGHT), 6).alias("customers"))


def _weighted_orders(spark, d):
    w = 1 + F.pmod(F.col("o_orderkey"), F.lit(3))
    return read(spark, d, "orders").withColumn(R.WEIGHT, w.cast("double"))


WO = "(SELECT *, CAST(1 + o_orderkey % 3 AS DOUBLE) AS w FROM orders)"


@query(f"SELECT sum(w) * 1.5 AS n FROM {WO} WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def aqp_count(spark, d):
    q = aqp.AggregateQuery(("orders",), None, (("o_orderstatus", "=", "F"), ("o_totalprice", ">=", 100000)))
    return q.compute(_weighted_orders(spark, d), 1.5).select("n")


@query(f"SELECT round(sum(w * o_totalprice) / sum(w), 4) AS avg, round(sum(w * o_totalprice), 1) AS sum FROM {WO} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def aqp_avg_sum(spark, d):
    q = aqp.AggregateQuery(("orders",), "o_totalprice", (("o_orderpriority", "in", ("1-URGENT", "2-HIGH")),))
    return q.compute(_weighted_orders(spark, d)).select(F.round("avg", 4).alias("avg"), F.round("sum", 1).alias("sum"))


@query(f"SELECT o_orderstatus, sum(w) AS n, round(sum(w * o_totalprice) / sum(w), 4) AS avg FROM {WO} WHERE o_totalprice <= 300000 GROUP BY 1")
def aqp_grouped(spark, d):
    q = aqp.AggregateQuery(("orders",), "o_totalprice", (("o_totalprice", "<=", 300000),), ("o_orderstatus",))
    return q.compute(_weighted_orders(spark, d)).select("o_orderstatus", "n", F.round("avg", 4).alias("avg"))


@query(f"SELECT o_orderpriority, sum(w) AS n FROM {WO} WHERE o_orderstatus = 'O' AND o_orderpriority IS NOT NULL GROUP BY o_orderpriority")
def aqp_sql_text(spark, d):
    q = aqp.AggregateQuery(("orders",), None, (("o_orderstatus", "=", "O"),), ("o_orderpriority",))
    return spark.sql(q.sql("{completed}"), completed=_weighted_orders(spark, d))


@query(
    """WITH t AS (SELECT avg(c_acctbal) AS v FROM customer), b AS (SELECT avg(c_acctbal) AS v FROM customer WHERE c_custkey % 3 = 0), p AS (SELECT avg(c_acctbal) AS v FROM customer WHERE c_custkey % 2 = 0)
    SELECT round(1 - abs((p.v - t.v) / (b.v - t.v)), 6) AS reduction, round(greatest(0, 1 - abs((p.v - t.v) / (b.v - t.v))), 6) AS corrected FROM t, b, p"""
)
def bias_reduction(spark, d):
    c = read(spark, d, "customer")
    v = lambda df, n: aqp.mean_or_share(df, "c_acctbal").withColumnRenamed("value", n)
    x = v(c, "t").crossJoin(v(c.filter("c_custkey % 3 = 0"), "b")).crossJoin(v(c.filter("c_custkey % 2 = 0"), "p"))
    cols = F.col("p"), F.col("b"), F.col("t")
    return x.select(F.round(aqp.bias_reduction(*cols), 6).alias("reduction"), F.round(aqp.cardinality_correction(*cols), 6).alias("corrected"))


@query(
    """WITH p AS (SELECT o_custkey, avg(o_totalprice) AS p FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), t AS (SELECT o_custkey, avg(o_totalprice) AS t FROM orders GROUP BY 1)
    SELECT round(avg(abs(p - t)), 4) AS mae FROM p JOIN t USING (o_custkey)"""
)
def mae_by_key(spark, d):
    o = read(spark, d, "orders")
    return aqp.mean_absolute_error(o.filter("o_orderkey % 2 = 0"), o, "o_custkey", "o_totalprice").select(F.round("mae", 4).alias("mae"))


@query(
    """WITH t AS (SELECT o_orderstatus AS g, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderstatus AS g, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1), p AS (SELECT o_orderstatus AS g, count(*) * 2 AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
    e AS (SELECT (SELECT avg(abs((t.n - b.n) / CAST(t.n AS DOUBLE))) FROM t JOIN b USING (g)) AS be, (SELECT avg(abs((t.n - p.n) / CAST(t.n AS DOUBLE))) FROM t JOIN p USING (g)) AS pe)
    SELECT round(be, 8) AS base_error, round(pe, 8) AS pred_error, round(be - pe, 8) AS improvement FROM e"""
)
def aqp_improvement(spark, d):
    o = read(spark, d, "orders")
    q = aqp.AggregateQuery(("orders",), None, (), ("o_orderstatus",))
    x = aqp.improvement(q.compute(o), q.compute(o.filter("o_orderkey % 5 = 0")), q.compute(o.filter("o_orderkey % 2 = 0"), 2), ["o_orderstatus"], "n")
    return x.select(*[F.round(c, 8).alias(c) for c in x.columns])


@query("SELECT row_number() OVER (ORDER BY p_brand) AS code, p_brand AS value, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 10) AS prior FROM part GROUP BY p_brand")
def column_domain(spark, d):
    return models.domain(read(spark, d, "part"), "p_brand").withColumn("prior", F.round("prior", 10))


@query("WITH k AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) AS c FROM part) SELECT p_type, c AS code, count(*) AS n FROM k GROUP BY 1, 2")
def encode_decode(spark, d):
    p = read(spark, d, "part").select("p_type")
    dom = models.domain(p, "p_type")
    coded = models.encode(p, "p_type", dom).withColumn("code", F.col("p_type__code")).drop("p_type")
    return models.decode(coded, "p_type", dom).groupBy("p_type", "code").agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT count(l_orderkey) AS tf FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
    SELECT quantile_cont(tf, 0.1) AS p10, quantile_cont(tf, 0.5) AS p50, quantile_cont(tf, 0.9) AS p90, quantile_cont(tf, 0.99) AS p99, quantile_cont(tf, 1) AS p100, round(avg(tf), 8) AS mean FROM t"""
)
def tf_percentiles(spark, d):
    r = REL["lineitem_orders"]
    p = TF.percentiles(TF.add_tf(read(spark, d, "orders"), read(spark, d, "lineitem"), r), r.tf)
    return p.select("p10", "p50", "p90", "p99", "p100", F.round("mean", 8).alias("mean"))


@query(
    """WITH t AS (SELECT c_custkey, count(o_orderkey) AS tf, count(o_orderkey) FILTER (o_orderstatus <> 'P') AS cur FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
    a AS (SELECT o_custkey, count(*) AS app FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1)
    SELECT c_custkey, round(CASE WHEN tf = 0 THEN 0 ELSE tf * CASE WHEN cur = 0 THEN 1 ELSE coalesce(app, 0) / CAST(cur AS DOUBLE) END END, 8) AS expected FROM t LEFT JOIN a ON o_custkey = c_custkey"""
)
def expected_appearance(spark, d):
    r, o = REL["orders_customer"], read(spark, d, "orders")
    some = o.filter("o_orderstatus <> 'P'")
    c = TF.add_current_tf(TF.add_tf(read(spark, d, "customer").select("c_custkey"), o, r), some, r)
    j = R.join(some, read(spark, d, "lineitem"), REL["lineitem_orders"])
    c = TF.add_tf(c, j, r, "app")
    return c.select("c_custkey", F.round(TF.expected_appearance(F.col(r.tf), F.col("app"), F.col(TF.CURRENT)), 8).alias("expected"))


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand, p_type) - 1 AS kind FROM part")
def normalize_dims(spark, d):
    _, rest = etl.normalize_by_values(read(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], "kind")
    return rest


@query(
    """WITH f AS (SELECT user_id, event_type, value FROM events WHERE event_type IN ('purchase', 'signup') QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1)
    SELECT c_custkey, max(value) FILTER (event_type = 'purchase') AS bought, max(value) FILTER (event_type = 'signup') AS joined FROM customer LEFT JOIN f ON user_id = c_custkey GROUP BY 1"""
)
def attribute_enrichment(spark, d):
    return etl.enrich(read(spark, d, "customer").select("c_custkey"), "c_custkey", read(spark, d, "events"), "user_id", "event_type", "value", {"purchase": "bought", "signup": "joined"}, "event_id")


@query(
    """SELECT s_suppkey, split_part(s_name, '#', -1) AS last, TRY_CAST(regexp_extract(s_name, '([0-9]+)[^0-9]*$', 1) AS INTEGER) AS number, trim(split_part(split_part(s_name || ' [x] (y)', '[', 1), '(', 1), ' )([].') AS bare, (SELECT 1994) AS year FROM supplier"""
)
def text_functions(spark, d):
    name = F.col("s_name")
    return read(spark, d, "supplier").select("s_suppkey", S.last_part(name, "#").alias("last"), S.last_number(name).alias("number"), S.cut_brackets(F.concat(name, F.lit(" [x] (y)"))).alias("bare"), S.year_of(F.lit("1994-05")).cast("int").alias("year"))


@query(
    """SELECT o_orderstatus, l_returnflag AS value, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS DOUBLE), 10) AS p
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"""
)
def count_model(spark, d):
    j = R.join(read(spark, d, "orders"), read(spark, d, "lineitem"), REL["lineitem_orders"])
    m = models.CountModel.fit(j, "l_returnflag", ["o_orderstatus"])
    return m.probabilities().withColumn("p", F.round("p", 10))


@query(
    f"""WITH n AS (SELECT c_mktsegment AS g, o_orderstatus AS v, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
    t AS (SELECT g, v, sum(n) OVER (PARTITION BY g ORDER BY v) / CAST(sum(n) OVER (PARTITION BY g) AS DOUBLE) AS hi, (sum(n) OVER (PARTITION BY g ORDER BY v) - n) / CAST(sum(n) OVER (PARTITION BY g) AS DOUBLE) AS lo FROM n),
    u AS (SELECT c_custkey, c_mktsegment, {uniform_sql("'7'", "'s'", "c_custkey")} AS u FROM customer)
    SELECT c_custkey, v AS drawn FROM u JOIN t ON g = c_mktsegment AND u >= lo AND (u < hi OR hi >= 1)"""
)
def count_model_sample(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    j = R.join(c, read(spark, d, "orders"), REL["orders_customer"])
    m = models.CountModel.fit(j, "o_orderstatus", ["c_mktsegment"])
    return m.sample(c, uniform(7, "s", F.col("c_custkey")), "drawn").select("c_custkey", "drawn")


@query(
    """WITH n AS (SELECT o_orderstatus AS g, l_returnflag AS v, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT round(-sum(n * ln(p)) / sum(n), 8) AS nll FROM (SELECT n, n / CAST(sum(n) OVER (PARTITION BY g) AS DOUBLE) AS p FROM n)"""
)
def model_nll(spark, d):
    j = R.join(read(spark, d, "orders"), read(spark, d, "lineitem"), REL["lineitem_orders"]).select("o_orderstatus", "l_returnflag")
    m = models.CountModel.fit(j, "l_returnflag", ["o_orderstatus"])
    return models.negative_log_likelihood(j, m).select(F.round("nll", 8).alias("nll"))


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey FROM orders), c AS (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
    SELECT count(*) AS n, count(*) FILTER (c_custkey IS NULL) AS synthetic FROM o LEFT JOIN c ON o_custkey = c_custkey"""
)
def complete_n1(spark, d):
    frames = {n: read(spark, d, n) for n in ("customer", "orders", "events")}
    kept = frames["customer"].filter(F.col("c_acctbal") >= 0).select("c_custkey")
    out = removal.remove(GRAPH, frames, "customer", kept, cascade=False)
    left = out["orders"].select("o_orderkey", "o_custkey", "o_orderstatus"), out["customer"].select("c_custkey", "c_mktsegment")
    done = completion.join_n1(*left, REL["orders_customer"], "o_orderkey", ["c_mktsegment"], ["o_orderstatus"])
    return done.agg(F.count("*").alias("n"), F.count_if(F.col("c_custkey") < 0).alias("synthetic"))


@query(
    """WITH t AS (SELECT c_custkey, count(o_orderkey) AS tf FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT CAST(sum(tf) AS DOUBLE) AS n FROM t"""
)
def complete_1n(spark, d):
    """orders removed by bias, completed from customers by the planner: with known tuple factors the count is the true one."""
    orders, customers = read(spark, d, "orders"), read(spark, d, "customer")
    kept = R.in_keys(orders, "o_orderkey", removal.bias_keys(orders.select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 0.5, 0.5, 2))
    s = planner.Scenario(GRAPH.with_complete("customer", "region", "nation"), {"customer": customers, "orders": kept}, {"customer": ["c_mktsegment"], "orders": ["o_orderstatus", "o_orderpriority"]}, seed=2)
    s = s.with_tuple_factors({"orders": orders})
    s.frames["customer"] = stored(s.frames["customer"], "customers")
    done = planner.complete(s, {"orders"}, ["o_orderstatus", "o_orderpriority"])
    return done.agg(F.sum(R.WEIGHT).alias("n"))


def cdf_sql(name: str, rows: str, context: str, value: str, mass: str = "count(*)", support: int = 20) -> str:
    """CTEs name_c (contexts with support) and name_m (no context): v with lo and hi, over the rows of a FROM clause."""
    up = lambda part: f"sum(m) OVER ({part} ORDER BY v) / sum(m) OVER ({part}) AS hi, (sum(m) OVER ({part} ORDER BY v) - m) / sum(m) OVER ({part}) AS lo"
    return f"""{name}_n AS (SELECT {context} AS g, {value} AS v, CAST({mass} AS DOUBLE) AS m, count(*) AS n FROM {rows} GROUP BY 1, 2),
    {name}_c AS (SELECT g, v, {up("PARTITION BY g")} FROM (SELECT *, sum(n) OVER (PARTITION BY g) AS r FROM {name}_n) WHERE r >= {support}),
    {name}_m AS (SELECT v, {up("PARTITION BY 1")} FROM (SELECT v, sum(m) AS m FROM {name}_n GROUP BY v))"""


def draw_sql(name: str, context: str, u: str) -> tuple[str, str]:
    """The drawn value, and the joins that it needs."""
    within = lambda t: f"{u} >= {t}.lo AND ({u} < {t}.hi OR {t}.hi >= 1 - 1e-12)"
    return f"coalesce({name}1.v, {name}2.v)", f"LEFT JOIN {name}_c {name}1 ON {name}1.g = {context} AND {within(name + '1')} LEFT JOIN {name}_m {name}2 ON {within(name + '2')}"


def _tf_mass(tf: str) -> str:
    return f"count(*) * CASE WHEN {tf} >= 1 THEN 1.0 / {tf} ELSE 1.0 END"


TF_ORDERS = "tf_orders_o_custkey"
DRAWN_TF, DRAWN_TF_JOIN = draw_sql("f", "c_mktsegment", uniform_sql("'2'", f"'{TF_ORDERS}'", "c_custkey"))
DRAWN_STATUS, DRAWN_STATUS_JOIN = draw_sql("s", "c_mktsegment", uniform_sql("'2'", "'o_orderstatus'", "c_custkey || '#' || nth"))


@query(
    f"""WITH k AS (SELECT * FROM orders QUALIFY row_number() OVER (ORDER BY {uniform_sql("'2'", "'keep'", "o_orderkey")}, o_orderkey) <= CAST(floor(0.5 * (SELECT count(*) FROM orders)) AS BIGINT)),
    kt AS (SELECT c_custkey FROM customer QUALIFY row_number() OVER (ORDER BY (c_acctbal IS NULL)::INT + {uniform_sql("'2'", "'tf'", "c_custkey")}, c_custkey) <= CAST(floor(0.5 * (SELECT count(*) FROM customer)) AS BIGINT)),
    c AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey IN (SELECT c_custkey FROM kt) THEN coalesce(n, 0) END AS tf, coalesce(cur, 0) AS cur FROM customer
      LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS cur FROM k GROUP BY 1) b ON b.o_custkey = c_custkey),
    {cdf_sql("f", "(SELECT * FROM c WHERE tf >= 0)", "c_mktsegment", "tf", _tf_mass("tf"))},
    e AS (SELECT c_custkey, c_mktsegment, cur, coalesce(tf, {DRAWN_TF}) AS ex FROM c {DRAWN_TF_JOIN}),
    m AS (SELECT CASE WHEN avg(greatest(0, ex - cur)) > 0 AND avg(ex) > avg(cur) THEN (avg(ex) - avg(cur)) / avg(greatest(0, ex - cur)) ELSE 1 END AS scale FROM e),
    l AS (SELECT c_custkey, c_mktsegment, unnest(range(1, CAST(floor(greatest(0, ex - cur) * scale + 1e-9) AS BIGINT) + 1)) AS nth FROM e, m),
    {cdf_sql("s", "c JOIN k ON o_custkey = c_custkey", "c_mktsegment", "o_orderstatus")},
    r AS (SELECT {DRAWN_STATUS} AS o_orderstatus FROM l {DRAWN_STATUS_JOIN} UNION ALL SELECT o_orderstatus FROM c JOIN k ON o_custkey = c_custkey)
    SELECT o_orderstatus, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY 1"""
)
def aqp_completed(spark, d):
    """Share of statuses after completion with half of the tuple factors unknown."""
    orders, customers = read(spark, d, "orders"), read(spark, d, "customer")
    r = REL["orders_customer"]
    kept = R.in_keys(orders, "o_orderkey", removal.uniform_keys(orders.select("o_orderkey"), "o_orderkey", 0.5, 2))
    c = TF.add_tf(customers, orders.select("o_custkey"), r)
    c = stored(R.unknown_tf(c, r, removal.known_tf_keys(customers, "c_custkey", "c_acctbal", 0.5, 2)), "customers")
    s = planner.Scenario(GRAPH.with_complete("customer"), {"customer": c, "orders": kept}, {"customer": ["c_mktsegment"], "orders": ["o_orderstatus"]}, seed=2)
    done = planner.complete(s, {"orders"}, ["o_orderstatus"])
    return aqp.AggregateQuery(("orders",), None, (), ("o_orderstatus",)).compute(done).select("o_orderstatus", "n")


@query(
    """WITH d AS (SELECT c_mktsegment AS g, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS pi FROM customer GROUP BY 1), p AS (SELECT c_mktsegment AS g, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM customer WHERE c_acctbal > 0 GROUP BY 1)
    SELECT round(1 - exp(-sum(p * ln(p / pi))), 8) AS kl, round(sum(greatest(0, least(1, (p - pi) / (1 - pi))) + greatest(0, least(1, (pi - p) / pi))), 8) AS by_prior,
      round(sum(p * 0.7 + 0.3 * (pi + 0.6 * (1 - pi))), 8) AS mixed FROM d JOIN p USING (g)"""
)
def predictability(spark, d):
    c = read(spark, d, "customer")
    a = models.domain(c, "c_mktsegment").select("value", F.col("prior").alias("pi"))
    b = models.domain(c.filter("c_acctbal > 0"), "c_mktsegment").select("value", F.col("prior").alias("p"))
    j = a.join(b, "value")
    mixed = S.percentile_mix(F.col("p"), F.col("pi"), F.lit(True), F.lit(0.8), F.lit(0.7), F.lit(4.0))
    x = j.agg(F.sort_array(F.collect_list(F.struct("value", "p", "pi"))).alias("x"), F.sum(S.prior_predictability(F.col("p"), F.col("pi"))).alias("by_prior"), F.sum(mixed).alias("mixed"))
    return x.select(F.round(S.kl_predictability(F.col("x.p"), F.col("x.pi")), 8).alias("kl"), F.round("by_prior", 8).alias("by_prior"), F.round("mixed", 8).alias("mixed"))


@query(
    """WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3)
    SELECT c_custkey, count(o_orderkey) AS set_size, count(*) FILTER (o_orderstatus = 'F') AS n_f FROM customer LEFT JOIN s ON o_custkey = c_custkey GROUP BY 1"""
)
def set_evidence(spark, d):
    x = models.set_evidence(read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders"), "c_custkey", "o_custkey", "o_orderkey", ["o_orderstatus"], 3)
    n = F.coalesce(F.size(F.filter("set", lambda s: s["o_orderstatus"] == "F")), F.lit(0)).cast("long")
    return x.select("c_custkey", F.col("set_size").cast("long").alias("set_size"), n.alias("n_f"))


@query("SELECT o_orderstatus, m AS best, o_orderpriority FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS m FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY m DESC, o_orderpriority) = 1")
def suspected_extreme(spark, d):
    n = read(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("best"))
    return aqp.suspected(n, ["o_orderstatus"], "best", "o_orderpriority", True).select("o_orderstatus", "best", "o_orderpriority")


@query("SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM events")
def running_sum(spark, d):
    return R.running_total(read(spark, d, "events"), "value", "event_id", "user_id").select("event_id", "running")


@query(
    """WITH RECURSIVE f AS (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS s FROM supplier),
    t AS (SELECT s_nationkey AS g, s_suppkey AS k, coalesce((coalesce(s_acctbal, m) - m) / nullif(s, 0), 0) AS x, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier, f),
    c AS (SELECT c_nationkey AS g, list({'k': c_custkey, 'x': coalesce((coalesce(c_acctbal, m) - m) / nullif(s, 0), 0)}) AS near FROM customer, f GROUP BY 1),
    r AS (SELECT g, 0 AS i, near, CAST(NULL AS BIGINT) AS existing, CAST(NULL AS BIGINT) AS synthetic FROM c
      UNION ALL SELECT g, i, list_filter(near, lambda z: z.k <> hit), k, hit
      FROM (SELECT r.g, t.i, r.near, t.k, list_sort(list_transform(r.near, lambda z: {'d': (z.x - t.x) * (z.x - t.x), 'k': z.k}))[1].k AS hit FROM r JOIN t ON t.g = r.g AND t.i = r.i + 1 WHERE len(r.near) > 0))
    SELECT existing, synthetic FROM r WHERE i > 0"""
)
def nearest_replacement(spark, d):
    """Existing suppliers take the place of synthetic customers of their nation, one to one, by nearest balance."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return completion.replace_nearest(c, s, "k", ["balance"], ["nation"])


def _zipf_sql(u: str, values: int = 20) -> str:
    """A value from 0 whose weight falls as 1 / (value + 1), by a draw u."""
    weights = [1 / (k + 1) for k in range(values)]
    steps = ", ".join(f"{s / sum(weights)!r}::DOUBLE" for s in itertools.accumulate(weights))
    return f"least({values}, len(list_filter([{steps}], lambda x: x <= {u})) + 1) - 1"


@query(
    f"""WITH p AS (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS predictability), a AS (SELECT id, {_zipf_sql(uniform_sql("'1'", "'a'", "id"))} AS a FROM range(1000) t(id)),
    c AS (SELECT a, {uniform_sql("'1'", "'flip'", "id * 5 + k")} AS flip, {_zipf_sql(uniform_sql("'1'", "'b'", "id * 5 + k"))} AS b FROM a, range(5) t(k))
    SELECT predictability, avg((CASE WHEN flip >= predictability THEN b ELSE a END = a)::INT) AS agreement FROM c, p GROUP BY 1"""
)
def synthetic_bias(spark, d):
    """Share of the children that have their parent's value, for three degrees of predictability."""
    from lacuna.sources.tables import synthetic

    out = None
    for p in (0.0, 0.5, 1.0):
        a, c = synthetic(spark, 1000, 5, 1.0, 20, p, seed=1)
        x = a.join(c, a["id"] == c["complete_id"]).agg(F.lit(p).alias("predictability"), F.avg((F.concat(F.lit("v"), F.col("attribute_a").cast("string")) == F.col("attribute_b")).cast("double")).alias("agreement"))
        out = x if out is None else out.unionByName(x)
    return out


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return streaming.windowed(read(spark, d, "events"), "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


VALUE, VALUE_JOIN = draw_sql("s", "c_mktsegment", uniform_sql("'4'", "'o_orderstatus'", "c_custkey || '#' || nth"))
KEPT4 = f"(SELECT * FROM orders WHERE {uniform_sql(chr(39) + '4' + chr(39), chr(39) + 'keep' + chr(39), 'o_orderkey')} < 0.5)"
LACK4 = f"""k AS {KEPT4}, c AS (SELECT c_custkey, c_mktsegment, coalesce(n, 0) - coalesce(cur, 0) AS lack FROM customer
      LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS cur FROM k GROUP BY 1) b ON b.o_custkey = c_custkey),
    l AS (SELECT c_custkey, c_mktsegment, unnest(range(1, lack + 1)) AS nth FROM c), w AS (SELECT max(lack) + 1 AS most FROM c),
    {cdf_sql("s", "c JOIN k ON o_custkey = c_custkey", "c_mktsegment", "o_orderstatus")}"""
#: Pairing of a customer and a place, as completion.synthetic_keys has it.
KEY4 = "-((CASE WHEN c_custkey > 0 THEN 2 * (c_custkey - 1) + 1 ELSE -2 * c_custkey END) * most + nth) - 1"


def _completed_orders(spark, d):
    orders, c = read(spark, d, "orders"), read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    r = REL["orders_customer"]
    c = stored(TF.add_tf(c, orders.select("o_custkey"), r), "customers")
    orders = TF.add_tf(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), read(spark, d, "lineitem").select("l_orderkey"), REL["lineitem_orders"])
    kept = orders.filter(uniform(4, "keep", F.col("o_orderkey")) < 0.5)
    return completion.join_1n(c, kept, r, c, "o_orderkey", ["o_orderstatus"], ["c_mktsegment"], seed=4)


@query(
    f"""WITH {LACK4}
    SELECT {KEY4} AS o_orderkey, c_custkey AS o_custkey, {VALUE} AS o_orderstatus, true AS synthetic FROM l CROSS JOIN w {VALUE_JOIN}
    UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, false FROM k"""
)
def complete_1n_values(spark, d):
    """Each completed order with its key and drawn status, replayed by the oracle."""
    return _completed_orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus", F.col(completion.SYNTHETIC).alias("synthetic"))


TF_ITEMS = "tf_lineitem_l_orderkey"
HOP_TF, HOP_TF_JOIN = draw_sql("f", "o_orderstatus", uniform_sql("'4'", f"'{TF_ITEMS}'", "o_orderkey"))
HOP_FLAG, HOP_FLAG_JOIN = draw_sql("g", "o_orderstatus", uniform_sql("'4'", "'l_returnflag'", "o_orderkey || '#' || nth"))


@query(
    f"""WITH {LACK4},
    o AS (SELECT {KEY4} AS o_orderkey, {VALUE} AS o_orderstatus, CAST(NULL AS BIGINT) AS tf FROM l CROSS JOIN w {VALUE_JOIN}
      UNION ALL SELECT o_orderkey, o_orderstatus, coalesce(n, 0) FROM k LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
    i AS (SELECT * FROM lineitem WHERE {uniform_sql("'4'", "'keep'", "l_partkey")} < 0.5),
    p AS (SELECT o.*, coalesce(cur, 0) AS cur FROM o LEFT JOIN (SELECT l_orderkey, count(*) AS cur FROM i GROUP BY 1) ON l_orderkey = o_orderkey),
    {cdf_sql("f", "(SELECT * FROM p WHERE tf >= 0)", "o_orderstatus", "tf", _tf_mass("tf"))},
    e AS (SELECT o_orderkey, o_orderstatus, cur, coalesce(tf, {HOP_TF}) AS ex FROM p {HOP_TF_JOIN}),
    m AS (SELECT CASE WHEN avg(greatest(0, ex - cur)) > 0 AND avg(ex) > avg(cur) THEN (avg(ex) - avg(cur)) / avg(greatest(0, ex - cur)) ELSE 1 END AS scale FROM e),
    ll AS (SELECT o_orderkey, o_orderstatus, unnest(range(1, CAST(floor(greatest(0, ex - cur) * scale + 1e-9) AS BIGINT) + 1)) AS nth FROM e, m),
    {cdf_sql("g", "o JOIN i ON l_orderkey = o_orderkey", "o_orderstatus", "l_returnflag")},
    r AS (SELECT o_orderstatus, {HOP_FLAG} AS l_returnflag, 1 AS made FROM ll {HOP_FLAG_JOIN} UNION ALL SELECT o_orderstatus, l_returnflag, 0 FROM o JOIN i ON l_orderkey = o_orderkey)
    SELECT o_orderstatus, l_returnflag, count(*) AS n, CAST(sum(made) AS BIGINT) AS made FROM r GROUP BY 1, 2"""
)
def complete_two_hops(spark, d):
    """Customers to orders to lineitems: synthesized orders have no tuple factor, and get synthesized items of their own."""
    df = _completed_orders(spark, d).drop(completion.SYNTHETIC)
    items = surrogate(read(spark, d, "lineitem")).select("l_id", "l_orderkey", "l_partkey", "l_returnflag").filter(uniform(4, "keep", F.col("l_partkey")) < 0.5)
    done = completion.join_1n(df, items, REL["lineitem_orders"], df, "l_id", ["l_returnflag"], ["o_orderstatus"], seed=4)
    return done.groupBy("o_orderstatus", "l_returnflag").agg(F.count("*").alias("n"), F.count_if(completion.SYNTHETIC).alias("made"))


@query(
    f"""WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal >= 0), o AS (SELECT o_orderkey, o_orderstatus, c_custkey FROM orders LEFT JOIN c ON o_custkey = c_custkey),
    {cdf_sql("s", "orders JOIN customer ON o_custkey = c_custkey AND c_acctbal >= 0", "o_orderstatus", "c_mktsegment")},
    r AS (SELECT o_orderkey, {draw_sql("s", "o_orderstatus", uniform_sql("'6'", "'c_mktsegment'", "o_orderkey"))[0]} AS c_mktsegment FROM o {draw_sql("s", "o_orderstatus", uniform_sql("'6'", "'c_mktsegment'", "o_orderkey"))[1]} WHERE c_custkey IS NULL)
    SELECT -(CASE WHEN o_orderkey > 0 THEN 2 * (o_orderkey - 1) + 1 ELSE -2 * o_orderkey END) - 1 AS c_custkey, o_orderkey, c_mktsegment FROM r"""
)
def complete_n1_values(spark, d):
    """The synthesized customers of orders that lost theirs."""
    frames = {n: read(spark, d, n) for n in ("customer", "orders", "events")}
    kept = frames["customer"].filter(F.col("c_acctbal") >= 0).select("c_custkey")
    out = removal.remove(GRAPH, frames, "customer", kept, cascade=False)
    done = completion.join_n1(out["orders"], out["customer"], REL["orders_customer"], "o_orderkey", ["c_mktsegment"], ["o_orderstatus"], seed=6)
    return done.filter(completion.SYNTHETIC).select("c_custkey", "o_orderkey", "c_mktsegment")


@query(
    """WITH n AS (SELECT o_orderstatus AS g, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2), pr AS (SELECT v, sum(n) / sum(sum(n)) OVER () AS pi FROM n GROUP BY v),
    p AS (SELECT g.g, pr.v, pr.pi, coalesce(n.n, 0) / CAST(sum(coalesce(n.n, 0)) OVER (PARTITION BY g.g) AS DOUBLE) AS p FROM (SELECT DISTINCT g FROM n) g CROSS JOIN pr LEFT JOIN n ON n.g = g.g AND n.v = pr.v),
    o AS (SELECT pi + (0.9 - 0.5) / 0.5 * (1 - pi) AS b, (SELECT count(*) FROM pr) - 1 AS others FROM pr WHERE v = '1-URGENT'),
    x AS (SELECT g, v, p * 0.6 + 0.4 * CASE WHEN v = '1-URGENT' THEN b ELSE (1 - b) / others END AS q FROM p, o)
    SELECT g AS o_orderstatus, v AS value, round(q / sum(q) OVER (PARTITION BY g), 8) AS p FROM x"""
)
def model_percentile(spark, d):
    """A model whose belief in urgent orders is drawn to its 0.9 quantile."""
    m = models.CountModel.fit(read(spark, d, "orders"), "o_orderpriority", ["o_orderstatus"], support=1)
    return m.bounded("1-URGENT", 0.9, 0.6).probabilities().withColumn("p", F.round("p", 8))


@query(
    """SELECT o_orderstatus, o_orderpriority AS value, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS DOUBLE), 8) AS p FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1, 2"""
)
def model_without_value(spark, d):
    m = models.CountModel.fit(read(spark, d, "orders"), "o_orderpriority", ["o_orderstatus"], support=1)
    return m.without("1-URGENT").probabilities().withColumn("p", F.round("p", 8))


SCENARIO = f"""WITH k AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders QUALIFY row_number() OVER (ORDER BY {uniform_sql("'9'", "'keep'", "o_orderkey")}, o_orderkey) <= CAST(floor(0.5 * (SELECT count(*) FROM orders)) AS BIGINT)),
    i AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM k))"""


def _scenario(spark, d):
    frames = dataset("sample").load(spark, d)
    return frames, *removal.incomplete(GRAPH, frames, [removal.Removal("orders", "uniform", 0.5)], ["customer", "orders", "lineitem"], seed=9)


@query(
    SCENARIO
    + """ SELECT 'customer' AS name, (SELECT count(*) FROM customer) AS n, true AS complete, (SELECT count(*) FROM orders) AS tfs UNION ALL SELECT 'orders', (SELECT count(*) FROM k), false, (SELECT count(*) FROM i) UNION ALL SELECT 'lineitem', (SELECT count(*) FROM i), false, NULL"""
)
def scenario(spark, d):
    """An incomplete schema in one call: rows and completeness of each table, and the children that its tuple factors promise."""
    _, graph, left = _scenario(spark, d)
    rows = None
    for t, tf in (("customer", TF_ORDERS), ("orders", TF_ITEMS), ("lineitem", None)):
        one = left[t].agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.lit(t in graph.complete).alias("complete"), (F.sum(tf) if tf else F.lit(None).cast("long")).alias("tfs"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(
    """WITH b AS (SELECT * FROM orders WHERE o_orderkey % 5 = 0), p AS (SELECT *, 2.0 AS w FROM orders WHERE o_orderkey % 2 = 0), t AS (SELECT * FROM orders)
    SELECT 'o_totalprice' AS attribute, round(t, 4) AS "true", round(b, 4) AS base, round(p, 4) AS pred, round(1 - abs((p - t) / (b - t)), 6) AS bias_reduction, tn AS true_rows, bn AS base_rows, pn AS pred_rows, round(greatest(0, 1 - abs((pn - tn) / (bn - tn))), 6) AS cardinality_correction
    FROM (SELECT avg(o_totalprice) AS t, CAST(count(*) AS DOUBLE) AS tn FROM t), (SELECT avg(o_totalprice) AS b, CAST(count(*) AS DOUBLE) AS bn FROM b), (SELECT avg(o_totalprice) AS p, CAST(sum(w) AS DOUBLE) AS pn FROM p)
    UNION ALL SELECT 'o_orderstatus', round(t, 4), round(b, 4), round(p, 4), round(1 - abs((p - t) / (b - t)), 6), tn, bn, pn, round(greatest(0, 1 - abs((pn - tn) / (bn - tn))), 6)
    FROM (SELECT avg((o_orderstatus = 'F')::INT) AS t, CAST(count(*) AS DOUBLE) AS tn FROM t), (SELECT avg((o_orderstatus = 'F')::INT) AS b, CAST(count(*) AS DOUBLE) AS bn FROM b), (SELECT avg((o_orderstatus = 'F')::INT) AS p, CAST(sum(w) AS DOUBLE) AS pn FROM p)"""
)
def evaluation_of_removals(spark, d):
    o = read(spark, d, "orders")
    removals = [removal.Removal("orders", "bias", 0.5, "o_totalprice", 0.5), removal.Removal("orders", "categorical", 0.5, "o_orderstatus", 0.5, ("F",)), removal.Removal("orders")]
    x = evaluation.evaluate(removals, o, o.filter("o_orderkey % 5 = 0"), o.filter("o_orderkey % 2 = 0").withColumn(R.WEIGHT, F.lit(2.0)))
    exact = {"true": 4, "base": 4, "pred": 4, "bias_reduction": 6, "cardinality_correction": 6}
    return x.select(*[F.round(c, exact[c]).alias(c) if c in exact else c for c in evaluation.MEASURES])


def _corpus_sql() -> str:
    one = """SELECT '{name}' AS name, round(be, 8) AS base_error, round(pe, 8) AS pred_error, round(be - pe, 8) AS improvement FROM (SELECT (SELECT avg(abs((t.v - b.v) / t.v)) FROM t{i} t JOIN b{i} b ON t.g = b.g) AS be, (SELECT avg(abs((t.v - p.v) / t.v)) FROM t{i} t JOIN p{i} p ON t.g = p.g) AS pe)"""
    spec = {"orders_by_status": ("o_orderstatus", "sum(w)", "true"), "orders_urgent": ("1", "sum(w)", "o_orderpriority IN ('1-URGENT', '2-HIGH')"), "price_by_priority": ("o_orderpriority", "sum(w * o_totalprice) / sum(w)", "true"), "price_of_finished": ("1", "sum(w * o_totalprice) / sum(w)", "o_orderstatus = 'F' AND o_totalprice >= 1000")}
    ctes, parts = [], []
    for i, (name, (g, v, test)) in enumerate(spec.items()):
        for side, where, w in (("t", "true", "1.0"), ("b", "o_orderkey % 5 = 0", "1.0"), ("p", "o_orderkey % 2 = 0", "2.0")):
            ctes.append(f"{side}{i} AS (SELECT {g} AS g, CAST({v} AS DOUBLE) AS v FROM (SELECT *, {w} AS w FROM orders WHERE {where}) WHERE {test} GROUP BY 1)")
        parts.append(one.format(name=name, i=i))
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(parts)}"


@query(_corpus_sql())
def evaluation_of_queries(spark, d):
    """All queries of the dataset's corpus over one table."""
    o = read(spark, d, "orders")
    x = evaluation.evaluate_queries(dataset("sample").queries, {"orders"}, o, o.filter("o_orderkey % 5 = 0"), o.filter("o_orderkey % 2 = 0").withColumn(R.WEIGHT, F.lit(2.0)))
    return x.select("name", *[F.round(c, 8).alias(c) for c in ("base_error", "pred_error", "improvement")])


@query()
def planner_selected(spark, d):
    """Each strategy's choice between the paths to nations' customers, scored in a validation scenario."""
    frames = {n: read(spark, d, n) for n in ("nation", "customer", "orders")}
    frames["orders"] = frames["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    bias = removal.Removal("customer", "bias", 0.6, "c_acctbal", 0.6, cascade=False)
    graph, left = removal.incomplete(GRAPH, frames, [bias], list(frames), seed=3)
    s = planner.Scenario(graph, left, {"nation": ["n_regionkey"], "orders": ["o_orderstatus"], "customer": ["c_acctbal"]}, seed=3, support=5)
    strategies = list(planner.Selection)
    plans = planner.plans_selected(s, {"customer"}, strategies, bias, "c_acctbal")
    out = [(x.value, p.branches[0].start if p.branches else "baseline", len(p.branches)) for x, p in zip(strategies, plans)]
    return spark.createDataFrame(out, "strategy string, start string, branches int")


@query(
    """WITH c AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0), a AS (SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
    SELECT (SELECT count(*) FROM orders) AS n, CAST(n AS BIGINT) AS linked, (SELECT count(*) FROM orders) - n AS made FROM a"""
)
def complete_n1_replaced(spark, d):
    """Existing customers with room take the place of synthesized ones: none has, while their factors are met; so all stay."""
    return _replaced(spark, d, 0)


@query(
    """WITH c AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0), a AS (SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), o AS (SELECT count(*) AS n FROM orders), r AS (SELECT least(o.n - a.n, (SELECT count(*) FROM c)) AS n FROM a, o)
    SELECT o.n AS n, CAST(a.n + r.n AS BIGINT) AS linked, o.n - a.n - r.n AS made FROM a, o, r"""
)
def complete_n1_replaced_some(spark, d):
    """Each customer has room for one more order."""
    return _replaced(spark, d, 1)


def _replaced(spark, d, room: int):
    frames = {n: read(spark, d, n) for n in ("customer", "orders", "events")}
    r = REL["orders_customer"]
    frames["customer"] = TF.add_tf(frames["customer"], frames["orders"].select("o_custkey"), r).withColumn(r.tf, F.col(r.tf) + room)
    out = removal.remove(GRAPH, frames, "customer", frames["customer"].filter("c_custkey % 3 <> 0").select("c_custkey"), cascade=False)
    s = planner.Scenario(GRAPH.with_complete("orders"), out, {"customer": ["c_acctbal"], "orders": ["o_orderstatus"]}, seed=8, replace={"customer": ["c_acctbal"]})
    done = planner.run_path(s, catalog.Path("orders", ((r, "customer"),), frozenset({"customer"})))
    return done.agg(F.count("*").alias("n"), F.count_if(F.col("c_custkey") >= 0).alias("linked"), F.count_if(F.col("c_custkey") < 0).alias("made"))


@query("SELECT (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most, (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*), 1 LIMIT 1) AS least")
def most_and_least_common(spark, d):
    return aqp.most_and_least_common(read(spark, d, "orders"), "o_orderpriority")


@query("SELECT o_custkey, round(avg(nullif(o_totalprice, 0)), 4) AS mean FROM orders GROUP BY 1")
def group_mean(spark, d):
    o = R.sentinel_to_null(read(spark, d, "orders"), {"o_totalprice": 0})
    return aqp.group_mean(o, "o_custkey", "o_totalprice").withColumn("mean", F.round("mean", 4))


@query("SELECT o_orderstatus, o_orderpriority, count(o_totalprice) AS runs, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1, 2")
def result_rollup(spark, d):
    return aqp.rollup(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice").withColumn("mean", F.round("mean", 4))


@query("SELECT event_id FROM (SELECT event_id, sum(CAST(value * 100 AS BIGINT)) OVER (ORDER BY event_id) AS s FROM events) WHERE s <= 100000")
def cut_batch(spark, d):
    """The events, in order of their id, whose amounts (whole hundredths) add up to a bound."""
    e = read(spark, d, "events").select("event_id", F.round(F.col("value") * 100, 0).cast("long").alias("amount"))
    return R.cut_batch(e, "amount", "event_id", 100_000).select("event_id")


@query(
    """WITH c AS (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS o, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS e FROM customer)
    SELECT (SELECT count(*) FROM c WHERE NOT (o = 0 AND e = 0)) AS connected, (SELECT count(*) FROM c WHERE e <> 0) AS on_path"""
)
def restrict_connected(spark, d):
    c = TF.add_tf(TF.add_tf(read(spark, d, "customer"), read(spark, d, "events"), REL["events_customer"]), read(spark, d, "orders"), REL["orders_customer"])
    on = R.connected_on_path(c, GRAPH.relationships, {"customer", "events"}).agg(F.count("*").alias("on_path"))
    return R.connected(c, [TF_ORDERS, "tf_events_user_id"]).agg(F.count("*").alias("connected")).crossJoin(on)


@query(f"SELECT o_orderkey FROM orders ORDER BY {uniform_sql(chr(39) + '1' + chr(39), chr(39) + 'first' + chr(39), 'o_orderkey')}, o_orderkey LIMIT 50")
def first_rows(spark, d):
    return R.first_rows(read(spark, d, "orders"), "o_orderkey", 50, 1).select("o_orderkey")


@query("SELECT o_orderkey, date_part('year', o_orderdate)::VARCHAR AS year, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey // 64 AS hi, o_orderkey % 64 AS lo FROM orders")
def dates_and_factors(spark, d):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    hi, lo = S.factors(F.col("o_orderkey"), 64)
    day = F.date_format(S.to_datetime(text), "yyyy-MM-dd")
    o = read(spark, d, "orders").select("o_orderkey", S.year_of(text).alias("year"), day.alias("day"), hi.alias("hi"), lo.alias("lo"))
    return o.filter(S.factored(F.col("hi"), F.col("lo"), 64) == F.col("o_orderkey"))

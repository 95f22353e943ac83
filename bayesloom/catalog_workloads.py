"""Registered queries of workload generation and of answers on supports, each with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import _LINEAGE, BASE, LS, N1, _pmfs, base, cpt_sql, edges, lineage, priced, query, r6, table
from .functions import divergence, records, scalars
from .operators import cpt, gaussian, graph, particles, workload
from .plans.kept import kept
from .sources import tables

_U = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0)"
_E = "e(parent, child) AS (VALUES " + ", ".join(f"('{p}', '{c}')" for c, ps in N1.items() for p in ps) + ")"


@query("k01_balanced_budget", f"WITH c AS (SELECT n_name, row_number() OVER (ORDER BY {_U.format(chr(39) + '4|' + chr(39) + ' || n_name')}, n_name) - 1 AS i FROM nation) SELECT n_name, (1000 // 25 + 0 + (i < 1007 % 25)::INT)::BIGINT AS n FROM c")
def balanced_budget(spark, d):
    return workload.balanced_budget(table(spark, d, "nation"), "n_name", 1007, seed=4)


@query("k05_drawn_evidence", f"WITH {_E}, m AS (SELECT child AS node, parent AS member FROM e UNION SELECT parent, child FROM e UNION SELECT a.parent, b.parent FROM e a JOIN e b USING (child) WHERE a.parent <> b.parent), q AS (SELECT c_custkey AS query_id, CASE c_custkey % 2 WHEN 0 THEN 'l_linestatus' ELSE 'o_orderstatus' END AS t FROM customer), r AS (SELECT q.query_id, m.member, floor({_U.format(chr(39) + '6|' + chr(39) + ' || q.query_id || ' + chr(39) + '|k' + chr(39))} * 3) AS k, row_number() OVER (PARTITION BY q.query_id ORDER BY {_U.format(chr(39) + '6|' + chr(39) + ' || q.query_id || ' + chr(39) + '|' + chr(39) + ' || m.member')}, m.member) AS r FROM q JOIN m ON m.node = q.t) SELECT query_id, member FROM r WHERE r <= k")
def drawn_evidence(spark, d):
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.when(F.col("c_custkey") % 2 == 0, "l_linestatus").otherwise("o_orderstatus").alias("target"))
    return workload.drawn_evidence(q, graph.markov_blanket(edges(spark, d)), "target", "node", "member", 2, seed=6)


@query("k06_evidence_values", f"WITH u AS (SELECT c_custkey, {_U.format(chr(39) + '8|' + chr(39) + ' || c_custkey')} AS u, {_U.format(chr(39) + '8|' + chr(39) + ' || c_custkey || ' + chr(39) + '|a' + chr(39))} + 0.5 / 4294967296.0 AS a, {_U.format(chr(39) + '8|' + chr(39) + ' || c_custkey || ' + chr(39) + '|b' + chr(39))} AS b FROM customer) SELECT c_custkey, floor(u * 5)::INT AS code, round(greatest(least(3 + 2 * sqrt(-2 * ln(a)) * cos(2 * pi() * b), 5), 0), 6) AS near, round(u * 5, 6) AS far FROM u")
def evidence_values(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.lit(5).alias("k"), F.lit(0.0).alias("low"), F.lit(5.0).alias("high"), F.lit(3.0).alias("mean"), F.lit(2.0).alias("std"))
    near = workload.continuous_values(workload.discrete_values(rows, "k", 8, "c_custkey"), 8, "c_custkey").withColumnRenamed("value", "near")
    return workload.continuous_values(near, 8, "c_custkey", on_manifold=False).select("c_custkey", "code", r6("near"), r6("value", "far"))


@query("k08_query_grid", "SELECT n_nationkey, m AS evidence_mode, t AS task, i::INT AS mc_id FROM nation, (VALUES ('empty'), ('on_manifold'), ('off_manifold')) a(m), (VALUES ('prediction'), ('diagnosis')) b(t), range(3) r(i) WHERE m <> 'empty' OR i = 0")
def query_grid(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey")
    return workload.query_grid(rows, ["empty", "on_manifold", "off_manifold"], ["prediction", "diagnosis"], 3)


@query("k04_target_candidates", f"WITH {_LINEAGE}, m AS (SELECT child AS node, parent AS member FROM e UNION SELECT parent, child FROM e UNION SELECT a.parent, b.parent FROM e a JOIN e b USING (child) WHERE a.parent <> b.parent), s AS (SELECT node, count(*) AS n FROM m GROUP BY node), h AS (SELECT n, sum(count(*)) OVER (ORDER BY n DESC) - count(*) + 1 AS place FROM s GROUP BY n) SELECT node, n AS n_blanket, place::BIGINT AS place FROM s JOIN h USING (n)")
def target_candidates(spark, d):
    """Nodes by the size of what shields them; equal sizes share a place. Places come from counts of sizes, not from one sorted task."""
    e = lineage(spark, d)
    sizes = kept(graph.report_sizes(e, graph.markov_blanket(e)).select("node", "n_blanket"))
    by = sizes.groupBy("n_blanket").agg(F.count("*").alias("c"))
    places = by.select("n_blanket", (F.sum("c").over(Window.orderBy(F.desc("n_blanket"))) - F.col("c") + 1).alias("place"))  # a row for each size
    return sizes.join(places, "n_blanket").select("node", "n_blanket", "place")


@query("p18_state_codes", "WITH s AS (SELECT o_orderpriority AS p, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)) SELECT o_orderkey, code::INT AS code FROM orders JOIN s ON p = o_orderpriority")
def state_codes(spark, d):
    orders = table(spark, d, "orders")
    states = orders.select(F.col("o_orderpriority").alias("state")).distinct()
    domain = states.select("state", (F.dense_rank().over(Window.orderBy("state")) - 1).alias("code"))  # one row for each state
    return workload.encoded(orders, domain, "o_orderpriority").select("o_orderkey", F.col("o_orderpriority_code").alias("code"))


@query("q23_direct_answers", f"WITH {BASE}, t AS ({cpt_sql('l_linestatus', LS)}), q AS (SELECT n_nationkey AS query_id, CASE n_nationkey % 2 WHEN 0 THEN 'F' ELSE 'O' END AS o_orderstatus, 'N' AS l_returnflag, CASE WHEN n_nationkey % 3 = 0 THEN 'O' END AS d FROM nation) SELECT query_id, l_linestatus, round(CASE WHEN d IS NULL THEN prob WHEN d = l_linestatus THEN 1 ELSE 0 END, 6) AS prob FROM q JOIN t USING (o_orderstatus, l_returnflag)")
def direct_answers(spark, d):
    q = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.when(F.col("n_nationkey") % 2 == 0, "F").otherwise("O").alias("o_orderstatus"), F.lit("N").alias("l_returnflag"), F.when(F.col("n_nationkey") % 3 == 0, "O").alias("d"))
    return workload.direct_answer(q, cpt.fit_cpt(base(spark, d), "l_linestatus", LS), "l_linestatus", LS, do="d").select("query_id", "l_linestatus", r6("prob"))


@query("q32_pmf_on_support", "WITH m AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem), g AS (SELECT n_nationkey AS query_id, x::DOUBLE AS x, exp(-0.5 * ((x + n_nationkey - m) / s) ** 2) AS e FROM nation, range(5) r(x), m) SELECT query_id, x, round(e / sum(e) OVER (PARTITION BY query_id), 6) AS prob FROM g")
def pmf_on_support(spark, d):
    f = gaussian.fit_linear(priced(spark, d), {"qty": []})["qty"]
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: i.cast("double"))).alias("x"))
    scored = rows.withColumn("log_prob", scalars.normal_log_density(F.col("x") + F.col("query_id"), F.lit(f.intercept), F.lit(f.std)))
    return workload.pmf_on_support(scored, ["query_id"], "x").select("query_id", "x", r6("prob"))



@query("z23_interventional_slope", "SELECT round(regr_slope(l_extendedprice * (1 - l_discount) / 1000, l_extendedprice / 1000), 4) AS slope FROM lineitem")
def interventional_slope(spark, d):
    f = gaussian.fit_linear(priced(spark, d), {"price": [], "revenue": ["price"]})["revenue"]
    q = spark.range(1).select(F.col("id").alias("query_id"))
    plus, minus = (q.withColumn("price", F.lit(x)).select("query_id", f.mean().alias("mean")) for x in (1.5, -1.5))
    return workload.mean_slope(plus, minus, 1.5).select(F.round("slope", 4).alias("slope"))


@query("z22_bin_geometry", "SELECT event_id, CASE WHEN value < 20 THEN 0.0 WHEN value < 60 THEN 20.0 ELSE 60.0 END AS lo, CASE WHEN value < 20 THEN 20.0 WHEN value < 60 THEN 40.0 ELSE 240.0 END AS width, CASE WHEN value < 20 THEN 10.0 WHEN value < 60 THEN 40.0 ELSE 180.0 END AS centre FROM events")
def bin_geometry(spark, d):
    cut = F.array(F.lit(0.0), F.lit(20.0), F.lit(60.0), F.lit(300.0))
    at = F.when(F.col("value") < 20, 0).when(F.col("value") < 60, 1).otherwise(2)
    g = workload.bin_geometry(at, cut)
    return table(spark, d, "events").select("event_id", g["left"].alias("lo"), g["width"].alias("width"), g["centre"].alias("centre"))


@query("z26_pmf_comparison", "WITH c AS (SELECT o_orderstatus AS s, o_orderpriority AS x, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS p FROM orders GROUP BY o_orderstatus, o_orderpriority), j AS (SELECT f.x, f.p AS a, q.p AS b FROM c f JOIN c q ON f.x = q.x AND f.s = 'F' AND q.s = 'P'), k AS (SELECT *, abs(sum(a - b) OVER (ORDER BY x)) AS g, row_number() OVER (ORDER BY a DESC, x) AS ra, row_number() OVER (ORDER BY b DESC, x) AS rb, row_number() OVER (ORDER BY x) - 1 AS i FROM j) SELECT round(sum(a * ln(a / b)), 6) AS kl, round(sum(g), 6) AS w1, abs(max(i) FILTER (ra = 1) - max(i) FILTER (rb = 1))::INT AS mode_error FROM k")
def pmf_comparison(spark, d):
    a, b = F.col("a"), F.col("b")
    return _pmfs(spark, d).select(F.round(divergence.kl(a, b), 6).alias("kl"), F.round(divergence.wasserstein(a, b), 6).alias("w1"), F.abs(records.mode_of(a) - records.mode_of(b)).alias("mode_error"))


@query("s16_clean_arcs", "SELECT DISTINCT c_nationkey AS parent, s_nationkey AS child FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE c_nationkey <> s_nationkey AND c_nationkey < 20 AND s_nationkey < 20")
def clean_arcs(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    arcs = c.join(s, F.col("s_suppkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("parent"), F.col("s_nationkey").alias("child"))
    return tables.clean_arcs(arcs, table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("node")))


@query("s19_latest_bundles", "SELECT o_orderstatus AS mode, o_orderpriority AS generator, path, modified FROM (SELECT *, 'run_' || o_orderkey AS path, o_orderdate AS modified, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderdate DESC, 'run_' || o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_bundles(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("mode"), F.col("o_orderpriority").alias("generator"), F.concat(F.lit("run_"), "o_orderkey").alias("path"), F.col("o_orderdate").alias("modified"))
    return tables.latest_bundle(o, ["mode", "generator"])

"""Registered queries of the evaluation side: records, report tables, divergences, graphs, workloads, and families by the library's operators.

The SQL of each is written by hand, not built from the library's own lists.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import _LINEAGE, _TRADE, SQL, lineage, query, r6, table, trade
from .functions import divergence, draws, records
from .operators import binned, graph, kernel, report, summary
from .plans.kept import kept
from .streaming import updates

#: Attempts of methods on queries, made of the event table; the same in both engines.
FIELDS = {
    "event_id": "event_id",
    "model": "event_type",
    "problem": "concat('p', user_id % 7)",
    "mode": "CASE WHEN event_id % 5 = 0 THEN 'cpds' ELSE 'inference' END",
    "ms": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END",
    "batch": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 4 + 1 END",
    "size": "event_id % 9",
    "ok": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value > 40 END",
    "error": "CASE WHEN event_id % 2 = 0 THEN concat('failed at step ', event_id) END",
    "stage": "CASE WHEN event_id % 4 = 0 THEN 'fit' WHEN event_id % 4 = 1 THEN 'infer' END",
    "jsd": "value - 30",
    "value": "value",
}
_REC = "rec AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in FIELDS.items()) + " FROM events)"


def rec(spark, d):
    return table(spark, d, "events").selectExpr(*[f"{v} AS {k}" for k, v in FIELDS.items()])


# report tables
@query("a04_trimmed_spread", f"WITH {_REC}, r AS (SELECT model, value, row_number() OVER (PARTITION BY model ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM rec) SELECT model, count(*) AS n, round(avg(value) FILTER (i >= floor(0.25 * n) AND i < ceil(0.75 * n)), 6) AS iqm, round((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349, 6) AS spread FROM r GROUP BY model")
def trimmed_spread(spark, d):
    return report.trimmed(rec(spark, d), ["model"], "value").select("model", "n", r6("iqm"), r6("spread"))


@query("a05_two_stage", f"WITH {_REC}, c AS (SELECT model, problem, median(value) AS c, count(value) AS n FROM rec GROUP BY ALL) SELECT model, count(DISTINCT problem) AS dataset_n, sum(n)::BIGINT AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, round(median(c), 6) AS median FROM c GROUP BY model")
def two_stage(spark, d):
    return report.two_stage(rec(spark, d), ["model"], "problem", "value").select("model", "dataset_n", "n", *[r6(c) for c in ("mean", "std", "median")])


@query("a06_time_table", f"WITH {_REC} SELECT model, mode, count(*) AS n_queries, count(ms) AS n_timed, round(coalesce(sum(ms), 0), 4) AS sum_ms, round(sum(ms) / count(*), 6) AS ms_per_query FROM rec GROUP BY model, mode")
def time_table(spark, d):
    return report.times(rec(spark, d), ["model", "mode"], "ms").select("model", "mode", "n_queries", "n_timed", F.round("sum_ms", 4).alias("sum_ms"), r6("ms_per_query"))


@query("a07_batching_table", f"WITH {_REC} SELECT model, count(*) AS n, round(avg(CASE WHEN batch > 1 THEN 1.0 ELSE 0.0 END), 6) AS fraction_batched, round(avg(batch), 6) AS avg_batch, round(1000 * count(ms) / sum(ms), 6) AS throughput_qps FROM rec GROUP BY model")
def batching_table(spark, d):
    return report.batching(rec(spark, d), ["model"], "batch", "ms").select("model", "n", *[r6(c) for c in ("fraction_batched", "avg_batch", "throughput_qps")])


_LINE = f"WITH {_REC}, q AS (SELECT quantile_cont(value, 0.0) AS a, quantile_cont(value, 0.25) AS b, quantile_cont(value, 0.5) AS c, quantile_cont(value, 0.75) AS d, quantile_cont(value, 1.0) AS e FROM rec), s AS (SELECT rec.*, CASE WHEN value <= b THEN a WHEN value <= c THEN b WHEN value <= d THEN c ELSE d END AS lo, CASE WHEN value <= b THEN b WHEN value <= c THEN c WHEN value <= d THEN d ELSE e END AS hi FROM rec, q)"


@query("a10_success_line", f"{_LINE} SELECT model, round(lo, 6) AS \"left\", round(hi, 6) AS \"right\", round((lo + hi) / 2, 6) AS mid, count(ok) AS n_total, round(avg(ok::INT), 6) AS rate FROM s GROUP BY model, lo, hi")
def success_line(spark, d):
    rows = summary.success(report.binned_line(rec(spark, d), ["model"], "value"), ["model", "left", "right", "mid"])
    return rows.select("model", r6("left"), r6("right"), r6("mid"), "n_total", r6("rate"))


@query("a11_coverage_line", f"{_LINE} SELECT round((lo + hi) / 2, 6) AS mid, count(*) AS attempts FROM s GROUP BY lo, hi")
def coverage_line(spark, d):
    return report.binned_line(rec(spark, d), [], "value").groupBy("mid").agg(F.count("*").alias("attempts")).select(r6("mid"), "attempts")


@query("a13_signatures_with_examples", f"WITH {_REC}, s AS (SELECT model, coalesce(stage, 'unknown') AS stage, event_id, error FROM rec) SELECT model, stage, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY model), 6) AS share, (list(error ORDER BY event_id) FILTER (error IS NOT NULL))[1] AS example FROM s GROUP BY model, stage")
def signatures_with_examples(spark, d):
    rows = rec(spark, d).withColumn("stage", F.coalesce("stage", F.lit("unknown")))
    return report.with_examples(rows, ["model"], "stage", "error", "event_id").select("model", "stage", "n", r6("share"), "example")


@query("a14_counters_by_scope", f"WITH {_REC}, c AS (SELECT model, problem, 'stage' AS counter, coalesce(stage, 'unknown') AS value FROM rec UNION ALL SELECT model, problem, 'mode', mode FROM rec), s AS (SELECT 'all' AS scope, NULL AS scope_value, counter, value FROM c UNION ALL SELECT 'model', model, counter, value FROM c UNION ALL SELECT 'problem', problem, counter, value FROM c) SELECT scope, scope_value, counter, value, count(*) AS n FROM s GROUP BY ALL")
def counters_by_scope(spark, d):
    return report.counters(rec(spark, d), ["stage", "mode"], ["model", "problem"])


@query("a17_a18_coverage", f"WITH {_REC} SELECT (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_acctbal > 9900) AS covered, count(*) AS possible, round((SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_acctbal > 9900) / count(*), 6) AS coverage FROM nation")
def nation_coverage(spark, d):
    asked = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    return report.coverage(asked, table(spark, d, "nation"), "n_nationkey").select("covered", "possible", r6("coverage"))


@query("a19_workload_counts", f"WITH {_REC} SELECT model, problem, count(*) AS n FROM rec GROUP BY GROUPING SETS ((), (model), (problem))")
def workload_counts(spark, d):
    return report.workload(rec(spark, d), ["model", "problem"])


@query("z07_partition_sets", f"WITH {_REC}, t AS (SELECT event_id // 8 AS q, model, max(coalesce(ok, false)::INT) AS k FROM rec GROUP BY ALL), s AS (SELECT q, string_agg(model, '|' ORDER BY model) FILTER (k = 1) AS solvers FROM t GROUP BY q), a AS (SELECT string_agg(DISTINCT model, '|' ORDER BY model) AS everyone FROM rec) SELECT q, 'all' AS partition, everyone AS shown FROM s, a UNION ALL SELECT q, CASE WHEN solvers = everyone THEN 'common' ELSE 'subset_' || solvers END, solvers FROM s, a WHERE solvers IS NOT NULL")
def partition_sets(spark, d):
    rows = rec(spark, d).withColumn("q", F.floor(F.col("event_id") / 8))
    return report.partition_sets(rows, "q", "model", "ok").select("q", "partition", F.array_join("shown", "|").alias("shown"))


@query("z06_error_bars", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), g AS (SELECT event_type, avg(value) FILTER (i >= floor(0.25 * n) AND i < floor(0.75 * n)) AS iqm, min(value) AS lo, max(value) AS hi, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 AS s FROM r GROUP BY event_type) SELECT event_type, round(iqm - greatest(iqm - s, lo), 6) AS below, round(least(iqm + s, hi) - iqm, 6) AS above FROM g")
def error_bars(spark, d):
    below, above = records.error_bars(F.col("iqm"), F.col("low"), F.col("high"))
    return summary.robust(table(spark, d, "events"), ["event_type"], "value").select("event_type", F.round(below, 6).alias("below"), F.round(above, 6).alias("above"))


@query("z09_pareto_by_type", f"WITH {_REC}, t AS (SELECT mode, model, round(avg(value), 6) AS error, round(avg(ms), 6) AS ms FROM rec GROUP BY ALL) SELECT * FROM t x WHERE NOT EXISTS (SELECT 1 FROM t y WHERE y.mode = x.mode AND y.error <= x.error AND y.ms <= x.ms AND (y.error < x.error OR y.ms < x.ms))")
def pareto_by_type(spark, d):
    rows = rec(spark, d).groupBy("mode", "model").agg(F.round(F.avg("value"), 6).alias("error"), F.round(F.avg("ms"), 6).alias("ms"))
    return summary.pareto(rows, ["mode"], "error", "ms")


@query("j01_composite_key", f"WITH {_REC}, p AS (SELECT event_id, model, stage, size, size % 3 + 1 AS k FROM rec WHERE event_id % 2 = 0), g AS (SELECT model, stage, size, event_id % 3 + 1 AS t, row_number() OVER (PARTITION BY model, stage, size ORDER BY event_id DESC) AS r FROM rec WHERE event_id % 2 = 1 OR stage IS NULL) SELECT p.event_id, g.t::BIGINT AS k FROM p JOIN g ON r = 1 AND p.model = g.model AND p.stage IS NOT DISTINCT FROM g.stage AND p.size = g.size WHERE p.k = g.t")
def composite_key(spark, d):
    ones = lambda n, x: F.transform(F.sequence(F.lit(0), (n % 3).cast("int")), lambda _: F.lit(x))
    rows = rec(spark, d)
    predictions = rows.where("event_id % 2 = 0").select("event_id", "model", "stage", "size", ones(F.col("size"), 1.0).alias("pmf"))
    truth = rows.where("event_id % 2 = 1 OR stage IS NULL").select("model", "stage", "size", F.col("event_id").alias("at"), ones(F.col("event_id"), 2.0).alias("truth"))
    return report.matched(predictions, truth, ["model", "stage", "size"], "at", "pmf", "truth").select("event_id", F.size("truth").cast("long").alias("k"))


@query("j02_j03_enrichment", f"WITH {_REC}, s AS (SELECT lower(n_name) AS name, n_regionkey AS category FROM nation), x AS (SELECT problem, count(*) AS n FROM rec GROUP BY problem) SELECT x.problem, n, category FROM x LEFT JOIN s ON s.name = 'nation_' || substr(x.problem, 2)")
def enrichment(spark, d):
    known = table(spark, d, "nation").select(F.lower("n_name").alias("name"), F.col("n_regionkey").alias("category"))
    rows = rec(spark, d).groupBy("problem").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("nation_"), F.substring("problem", 2, 9)))
    return rows.join(known, "name", "left").select("problem", "n", "category")


# record fields
@query("p07_p13_z13_record_fields", f"WITH {_REC} SELECT event_id, round(CASE WHEN jsd < 0 THEN 0 ELSE jsd END, 6) AS jsd, CASE WHEN mode = 'cpds' THEN 'cpd' ELSE 'inference' END AS kind, coalesce((CASE WHEN ok IS NOT NULL THEN ok WHEN ms IS NOT NULL THEN true WHEN error IS NOT NULL THEN false END)::VARCHAR, 'none') AS done, model || '/' || coalesce(stage, substr(md5(problem), 1, 8)) AS method, problem || '::' || mode || '::' || event_id AS id FROM rec")
def record_fields(spark, d):
    c = F.col
    return rec(spark, d).select("event_id", F.round(records.sanitised(c("jsd"), nonnegative=True), 6).alias("jsd"), records.query_type(c("mode")).alias("kind"), F.coalesce(records.outcome(c("ok"), c("ms"), c("error")).cast("string"), F.lit("none")).alias("done"), records.method_id(c("model"), c("stage"), F.md5("problem")).alias("method"), records.compact_id(c("problem"), c("mode"), c("event_id")).alias("id"))


@query("p08_whole_numbers", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id::BIGINT WHEN 1 THEN event_id::BIGINT ELSE -1 END AS n FROM events")
def whole_numbers(spark, d):
    text = F.expr("CASE event_id % 4 WHEN 0 THEN string(event_id) WHEN 1 THEN concat(event_id, '.0') WHEN 2 THEN concat(event_id, '.5') ELSE 'n/a' END")
    return table(spark, d, "events").select("event_id", F.coalesce(records.whole_number(text), F.lit(-1).cast("long")).alias("n"))


@query("p07_evidence_values", f"WITH {_REC} SELECT event_id, CASE WHEN stage IS NULL THEN 'size=' || size ELSE concat_ws(',', 'mode=' || mode, 'stage=' || stage) END AS evidence FROM rec")
def evidence_values(spark, d):
    own = F.when(F.col("stage").isNotNull(), F.create_map(F.lit("mode"), "mode", F.lit("stage"), "stage", F.lit("none"), F.lit(None).cast("string")))
    nested = F.create_map(F.lit("size"), F.col("size").cast("string"), F.lit("gone"), F.lit(None).cast("string"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(records.evidence_values(own, nested)), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return rec(spark, d).select("event_id", shown.alias("evidence"))


@query("p24_z03_z14_answers", "WITH a AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'categorical_probs' WHEN 1 THEN 'normal_params' WHEN 2 THEN 'samples' ELSE 'other' END AS kind, value FROM events) SELECT event_id, kind, CASE kind WHEN 'categorical_probs' THEN true WHEN 'normal_params' THEN value >= 20 WHEN 'samples' THEN value > 30 ELSE false END AS valid, kind = 'categorical_probs' AND event_id % 8 = 0 AS discrete, CASE WHEN kind = 'categorical_probs' THEN 1 ELSE -1 END AS mode FROM a")
def answers(spark, d):
    kind = F.expr("CASE event_id % 4 WHEN 0 THEN 'categorical_probs' WHEN 1 THEN 'normal_params' WHEN 2 THEN 'samples' ELSE 'other' END")
    a = table(spark, d, "events").select("event_id", kind.alias("kind"), "value")
    probs = F.when(F.col("kind") == "categorical_probs", F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)))
    support = F.when(F.col("event_id") % 8 == 0, records.support_or_range(F.lit(None).cast("array<int>"), probs).cast("array<double>")).otherwise(F.array(F.lit(0.5)))
    samples = F.filter(F.array("value"), lambda v: v > 30)
    return a.select("event_id", "kind", records.valid_answer(F.col("kind"), probs, F.col("value"), F.col("value") - 20, samples).alias("valid"), records.is_discrete_output(F.col("kind"), support).alias("discrete"), F.coalesce(records.mode_of(probs), F.lit(-1)).alias("mode"))


@query("z01_partition_keys", f"WITH {_REC} SELECT event_id, CASE WHEN size = 0 THEN NULL WHEN stage IS NOT NULL THEN 's|' || mode || '|' || problem || '|' || stage || '|' || model || '|-' WHEN batch IS NOT NULL THEN 'i|' || mode || '|' || problem || '|' || batch ELSE 'f|' || mode || '|' || problem || '|' || model || '|' || size END AS key FROM rec")
def partition_keys(spark, d):
    c = F.col
    kind = F.when(c("size") != 0, c("mode"))
    key = records.partition_key(kind, c("problem"), c("stage"), c("model"), F.lit(None).cast("string"), c("batch").cast("string"), c("model"), c("size"))
    return rec(spark, d).select("event_id", key.alias("key"))


@query("z02_ground_truth_source", f"WITH {_REC} SELECT event_id, round(CASE WHEN event_id % 11 <> 0 THEN value WHEN event_id % 3 <> 0 THEN event_id % 4 + 1 ELSE jsd END, 6) AS truth FROM rec")
def ground_truth_source(spark, d):
    none = F.lit(None).cast("double")
    return rec(spark, d).select("event_id", F.round(records.ground_truth(F.col("ms"), F.col("batch").cast("double"), none, F.col("jsd")), 6).alias("truth"))


@query("z05_model_filter", f"WITH {_REC} SELECT event_id FROM rec WHERE model IN ('click', 'view') OR stage = 'fit' OR model || '/' || stage = 'purchase/infer'")
def model_filter(spark, d):
    return rec(spark, d).where(records.matches_model(F.col("model"), F.col("stage"), ["click", "view", "fit", "purchase/infer"])).select("event_id")


@query("k11_failure_records", f"WITH {_REC} SELECT event_id, false AS ok, 'fit' AS error_stage, 'ValueError' AS error_type, 'no data' AS error_msg FROM rec WHERE problem = 'p3'")
def failure_records(spark, d):
    return report.failures(rec(spark, d).where("problem = 'p3'").select("event_id"), "fit", "ValueError", "no data")


# divergences on supports and on samples
@query("v06_v12_pmfs_on_a_support", "WITH c AS (SELECT o_orderstatus AS s, o_orderpriority AS x, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS p FROM orders GROUP BY o_orderstatus, o_orderpriority), j AS (SELECT f.x, f.p AS a, q.p AS b, row_number() OVER (ORDER BY f.x) AS i FROM c f JOIN c q ON f.x = q.x AND f.s = 'F' AND q.s = 'P'), h AS (SELECT *, sum(a - b) OVER (ORDER BY i) AS s, (i + 1) * (i + 1) - i * i AS w, count(*) OVER () AS n FROM j), k AS (SELECT *, abs(s) AS g FROM h) SELECT round(sum(g * w) FILTER (i < n), 6) AS w1, (SELECT (i - 1)::INT FROM k ORDER BY a DESC, i LIMIT 1) AS mode FROM k")
def pmfs_on_a_support(spark, d):
    from .catalog import _pmfs

    a, b = F.col("a"), F.col("b")
    support = F.transform(F.sequence(F.lit(1), F.size("a")), lambda i: (i * i).cast("double"))
    return _pmfs(spark, d).select(F.round(divergence.wasserstein_on(a, b, support), 6).alias("w1"), records.mode_of(a).alias("mode"))


def samples(spark, d):
    rows = table(spark, d, "events").where("event_type IN ('click', 'view')").select(F.when(F.col("event_type") == "click", 0).otherwise(1).alias("side"), F.col("value").alias("x"))
    return rows


_SAMPLES = "s AS (SELECT CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS side, value AS x FROM events WHERE event_type IN ('click', 'view'))"


@query("v07_wasserstein_on_samples", f"WITH {_SAMPLES}, p AS (SELECT x, CASE side WHEN 0 THEN 1.0 / (SELECT count(*) FROM s WHERE side = 0) ELSE -1.0 / (SELECT count(*) FROM s WHERE side = 1) END AS m FROM s), g AS (SELECT x, sum(m) AS m FROM p GROUP BY x), c AS (SELECT x, sum(m) OVER (ORDER BY x) AS gap, lead(x) OVER (ORDER BY x) - x AS step FROM g) SELECT round(sum(abs(gap) * step), 6) AS w1 FROM c")
def wasserstein_on_samples(spark, d):
    return report.wasserstein_of_samples(samples(spark, d), "side", "x").select(r6("w1"))


@query("v08_jsd_on_samples", f"WITH {_SAMPLES}, q AS (SELECT min(x) AS lo, (max(x) - min(x)) / 64 AS w FROM s), h AS (SELECT least(floor((x - lo) / w), 63)::INT AS bin, count(*) FILTER (side = 0) * 1.0 / (SELECT count(*) FROM s WHERE side = 0) + 1e-12 AS a, count(*) FILTER (side = 1) * 1.0 / (SELECT count(*) FROM s WHERE side = 1) + 1e-12 AS b FROM s, q GROUP BY 1), e AS (SELECT coalesce(a, 1e-12) AS a, coalesce(b, 1e-12) AS b FROM range(64) r(k) LEFT JOIN h ON h.bin = r.k), n AS (SELECT a / sum(a) OVER () AS a, b / sum(b) OVER () AS b FROM e) SELECT round(sum(0.5 * a * ln(2 * a / (a + b)) + 0.5 * b * ln(2 * b / (a + b))), 6) AS jsd FROM n")
def jsd_on_samples(spark, d):
    return report.jsd_of_samples(samples(spark, d), "side", "x").select(r6("jsd"))


@query("v10_mean_std_errors", f"WITH {_REC} SELECT model, round(abs(avg(value) - 50), 6) AS mean_error, round(abs(stddev_pop(value) - 48), 6) AS std_error FROM rec GROUP BY model")
def mean_std_errors(spark, d):
    rows = rec(spark, d).groupBy("model").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    a, b = divergence.moment_errors(F.col("mean"), F.col("std"), F.lit(50.0), F.lit(48.0))
    return rows.select("model", F.round(a, 6).alias("mean_error"), F.round(b, 6).alias("std_error"))


@query("v13_draws_from_moments", "WITH u AS (SELECT c_custkey, (('0x' || substr(md5('5|' || c_custkey || '|a'), 1, 8))::BIGINT / 4294967296.0) + 0.5 / 4294967296.0 AS a, ('0x' || substr(md5('5|' || c_custkey || '|b'), 1, 8))::BIGINT / 4294967296.0 AS b FROM customer) SELECT c_custkey, round(10 + 2 * sqrt(-2 * ln(a)) * cos(2 * pi() * b), 6) AS draw FROM u")
def draws_from_moments(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(10 + 2 * draws.normal(5, "c_custkey"), 6).alias("draw"))


# graphs over the whole tables
_MARKETS = "e AS (SELECT 'M' || c_nationkey || c_mktsegment AS parent, 'C' || c_custkey AS child FROM customer), u AS (SELECT parent AS x, child AS y FROM e UNION SELECT child, parent FROM e)"


def markets(spark, d):
    """Customers tied to the market segment of their nation: a component for each."""
    c = table(spark, d, "customer")
    return c.select(F.concat(F.lit("M"), F.col("c_nationkey").cast("string"), "c_mktsegment").alias("parent"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("child"))


@query("g05_connected_components", f"WITH RECURSIVE {_MARKETS}, r AS (SELECT DISTINCT x AS node, x AS seen FROM u UNION SELECT r.node, u.y FROM r JOIN u ON u.x = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node")
def connected_components(spark, d):
    return graph.connected_components(markets(spark, d))


@query("g08_articulation_points", f"WITH RECURSIVE {_TRADE}, n AS (SELECT DISTINCT x AS node FROM u), r AS (SELECT a.node AS cut, b.node, b.node AS seen FROM n a, n b WHERE a.node <> b.node UNION SELECT r.cut, r.node, u.y FROM r JOIN u ON u.x = r.seen WHERE u.y <> r.cut), l AS (SELECT cut, node, min(seen) AS label FROM r GROUP BY ALL) SELECT l.cut AS node FROM l JOIN u ON u.x = l.cut AND u.y = l.node GROUP BY l.cut HAVING count(DISTINCT label) > 1")
def articulation_points(spark, d):
    return graph.articulation_points(trade(spark, d))


@query("g09_betweenness", f"WITH RECURSIVE {_TRADE}, n AS (SELECT DISTINCT x AS node FROM u), p AS (SELECT node AS s, node AS t, [node] AS way FROM n UNION ALL SELECT p.s, u.y, list_append(p.way, u.y) FROM p JOIN u ON u.x = p.t WHERE NOT list_contains(p.way, u.y) AND len(p.way) < 10), m AS (SELECT *, min(len(way)) OVER (PARTITION BY s, t) AS k, count(*) OVER (PARTITION BY s, t, len(way)) AS c FROM p), w AS (SELECT s, t, c, unnest(way) AS v FROM m WHERE len(way) = k AND s <> t) SELECT n.node, round(coalesce(sum(1.0 / c) FILTER (v <> s AND v <> t), 0) / 2, 6) AS betweenness FROM n LEFT JOIN w ON w.v = n.node GROUP BY n.node")
def betweenness(spark, d):
    return graph.betweenness(trade(spark, d)).select("node", r6("betweenness"))


@query("g11_graph_sizes", f"WITH {_LINEAGE}, m AS (SELECT child AS node, parent AS member FROM e UNION SELECT parent, child FROM e UNION SELECT a.parent, b.parent FROM e a JOIN e b USING (child) WHERE a.parent <> b.parent), p AS (SELECT child AS node, count(DISTINCT parent) AS n FROM e GROUP BY child), b AS (SELECT node, count(*) AS n FROM m GROUP BY node) SELECT node, coalesce(p.n, 0) AS n_parents, b.n AS n_blanket FROM b LEFT JOIN p USING (node)")
def graph_sizes(spark, d):
    e = lineage(spark, d)
    return graph.report_sizes(e, graph.markov_blanket(e))


@query("g14_evaluation_cost", "SELECT n_nationkey, (SELECT sum(1 + least(3, i)) FROM range(n_nationkey + 1) r(i))::BIGINT AS cost FROM nation")
def evaluation_cost(spark, d):
    return table(spark, d, "nation").select("n_nationkey", report.evaluation_cost(F.col("n_nationkey") + 1, F.lit(3)).cast("long").alias("cost"))


# windows, sets and sketches
@query("w06_lag_differences", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id), 6) AS diff FROM events")
def lag_differences(spark, d):
    w = Window.partitionBy("event_type").orderBy("event_id")
    return table(spark, d, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("diff"))


@query("w09_ranks", "SELECT p_partkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nt, round(percent_rank() OVER w, 6) AS pr FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def ranks(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    nt = F.ntile(4).over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, d, "part").select("p_partkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), nt.cast("long").alias("nt"), F.round(F.percent_rank().over(w), 6).alias("pr"))


@query("x04_intersection", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def intersection(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    return a.intersect(table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("u08_session_windows", "WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT * FROM e)) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def session_windows(spark, d):
    rows = updates.sessions(table(spark, d, "events"), "ts", "1 hour", "30 minutes", ["user_id"], "value")
    return rows.select("user_id", "start", "n", F.round("total", 4).alias("total"))


@query("u08_sliding_windows", "SELECT event_type, w AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY event_type, w")
def sliding_windows(spark, d):
    rows = updates.windowed(table(spark, d, "events"), "ts", "1 day", "2 hours", ["event_type"], "value", slide="1 hour")
    return rows.select("event_type", "start", "n", F.round("total", 4).alias("total"))


@query("u06_family_counts", "SELECT 'event_type' AS node, 'None|' || event_type AS cells, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'size', event_type || '|' || (event_id % 3), count(*) FROM events GROUP BY event_type, event_id % 3")
def family_counts(spark, d):
    rows = updates.family_counts(table(spark, d, "events").withColumn("size", F.col("event_id") % 3), {"event_type": [], "size": ["event_type"]})
    return rows.select("node", F.when(F.size("cells") == 1, F.concat(F.lit("None|"), F.get("cells", F.lit(0)))).otherwise(F.array_join("cells", "|")).alias("cells"), "n")


@query("u06_merged_with_decay", "WITH b AS (SELECT event_type, event_id % 3 AS batch, count(*) AS n FROM events GROUP BY ALL) SELECT 'event_type' AS node, event_type AS cells, round(sum(n * 0.5 ** (2 - batch)), 6) AS n FROM b GROUP BY event_type")
def merged_with_decay(spark, d):
    rows = table(spark, d, "events").groupBy((F.col("event_id") % 3).alias("batch"), F.array("event_type").alias("cells")).agg(F.count("*").alias("n")).withColumn("node", F.lit("event_type"))
    return updates.merged(rows, decay=0.5).select("node", F.array_join("cells", "|").alias("cells"), r6("n"))


# families by their operators
@query("c10_c11_kernel_family", "WITH p AS (SELECT n_nationkey::DOUBLE AS x, n_regionkey::DOUBLE AS y FROM nation), q AS (SELECT unnest(range(0, 5))::DOUBLE AS x) SELECT q.x AS n_nationkey, round(ln(sum(exp(-0.5 * (((q.x - p.x) / 0.5) ** 2 + ((2 - p.y) / 0.7) ** 2)) / (0.7 * sqrt(2 * pi())))) - ln(sum(exp(-0.5 * ((q.x - p.x) / 0.5) ** 2))), 6) AS log_prob FROM q, p GROUP BY q.x")
def kernel_family(spark, d):
    points = kernel.fit(table(spark, d, "nation"), "n_regionkey", ["n_nationkey"])
    q = spark.range(5).select(F.col("id").cast("double").alias("n_nationkey"), F.lit(2.0).alias("n_regionkey"))
    return kernel.log_prob(q, points, "n_regionkey", ["n_nationkey"], bandwidth=0.7, parent_bandwidth=0.5).select("n_nationkey", r6("log_prob"))


@query("c20_uniform_and_gaussian_edges", "WITH s AS (SELECT min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT round(lo + (hi - lo) * 0.25, 6) AS u1, round(lo + (hi - lo) * 0.75, 6) AS u3, round(m, 6) AS g2, round(m + s * 0.6744897501960817, 6) AS g3 FROM s")
def uniform_and_gaussian_edges(spark, d):
    e = table(spark, d, "events")
    u, g = binned.bin_edges(e, "value", 4, "uniform"), binned.bin_edges(e, "value", 4, "gaussian").withColumnRenamed("edges", "g")
    pick = lambda c, i, n: F.round(F.element_at(c, i), 6).alias(n)
    return u.crossJoin(F.broadcast(g)).select(pick("edges", 2, "u1"), pick("edges", 4, "u3"), pick("g", 3, "g2"), pick("g", 4, "g3"))  # one row each


@query("c22_binned_frequencies", "WITH q AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT event_type, least(floor((value - lo) / ((hi - lo) / 8)), 7)::INT AS bin FROM events, q), k AS (SELECT DISTINCT event_type FROM events), g AS (SELECT k.event_type, r.i::INT AS bin FROM k, range(8) r(i)) SELECT g.event_type, g.bin, round(greatest(0.9 * (SELECT count(*) FROM b WHERE b.event_type = g.event_type AND b.bin = g.bin) / (SELECT count(*) FROM b WHERE b.event_type = g.event_type) + 0.1 / 8, 1e-12), 6) AS prob FROM g")
def binned_frequencies(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    rows = e.crossJoin(F.broadcast(binned.bin_edges(e, "value", 8, "uniform"))).withColumn("at", binned.bin_of(F.col("value"), F.col("edges")))  # one row
    return binned.frequencies(rows, "at", 8, ["event_type"], smoothing=0.1).select("event_type", "bin", r6("prob"))


@query("z28_random_table", "WITH g AS (SELECT n_nationkey AS parent, k, -ln(('0x' || substr(md5('9|' || n_nationkey || '|' || k), 1, 8))::BIGINT / 4294967296.0 + 0.5 / 4294967296.0) AS x FROM nation, range(3) r(k)) SELECT parent, k::INT AS k, round(x / sum(x) OVER (PARTITION BY parent), 6) AS prob FROM g")
def random_table(spark, d):
    """Rows of a flat Dirichlet: exponential draws over their sum."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("parent"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    x = -F.ln(draws.uniform(9, "parent", "k") + F.lit(0.5 / 4294967296.0))
    return rows.withColumn("x", x).select("parent", "k", F.round(F.col("x") / F.sum("x").over(Window.partitionBy("parent")), 6).alias("prob"))


@query("m06_ranges", "SELECT event_type, round(quantile_cont(value, 0.01), 6) AS low, round(quantile_cont(value, 0.99), 6) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def ranges(spark, d):
    return report.ranges(table(spark, d, "events"), ["event_type"], "value").select("event_type", *[r6(c) for c in ("low", "high", "mean", "std")])


@query("m08_distinct_query_rows", "WITH t AS (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer), o AS (SELECT *, row_number() OVER (ORDER BY md5('3|' || c_mktsegment || '|' || c_nationkey), c_mktsegment, c_nationkey) AS r FROM t) SELECT c_mktsegment, c_nationkey FROM o WHERE r <= 20")
def distinct_query_rows(spark, d):
    return report.distinct_rows(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], 20, seed=3)


_BETWEEN = SQL["g09_betweenness"]
_REACH = f"{_TRADE}, bt AS ({_BETWEEN}), nodes AS (SELECT DISTINCT x AS node FROM u), m AS (SELECT child AS node, parent AS member FROM e UNION SELECT parent, child FROM e UNION SELECT a.parent, b.parent FROM e a JOIN e b USING (child) WHERE a.parent <> b.parent), tt AS (SELECT DISTINCT child AS node FROM e WHERE parent LIKE 'N%'), ask AS (SELECT 'N' || n_nationkey AS node FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey HAVING avg(c_acctbal) > 4500), hub AS (SELECT node FROM bt WHERE betweenness >= (SELECT median(betweenness) FROM bt)), leaf AS (SELECT node FROM nodes WHERE node NOT IN (SELECT parent FROM e)), pr AS (SELECT DISTINCT least(node, member) AS a, greatest(node, member) AS b FROM m), pt AS (SELECT DISTINCT least(node, member) AS a, greatest(node, member) AS b FROM m WHERE node IN (FROM tt))"


@query(
    "a18_workload_coverage",
    f"WITH {_REACH}, c AS (SELECT count(*) AS n FROM nodes) SELECT round((SELECT count(*) FROM tt) / n, 6) AS target_coverage, round((SELECT count(DISTINCT parent) FROM e WHERE child IN (FROM tt)) / n, 6) AS parent_coverage, "
    "round(((SELECT count(*) FROM m WHERE node IN (FROM tt)) / (SELECT count(*) FROM tt)) / ((SELECT count(*) FROM m) / n), 6) AS blanket_ratio, round((SELECT count(*) FROM pt) / (SELECT count(*) FROM pr), 6) AS pair_coverage, "
    "round((SELECT count(*) FROM ask) / n, 6) AS asked_coverage, round((SELECT count(*) FROM ask JOIN hub USING (node)) / (SELECT count(*) FROM hub), 6) AS hub_coverage, round(coalesce((SELECT count(*) FROM ask JOIN leaf USING (node)) / nullif((SELECT count(*) FROM leaf), 0), 0), 6) AS terminal_coverage FROM c",
)
def workload_reach(spark, d):
    """How much of the trade graph is reached by tables of the nations bought from, and questions about nations of rich customers."""
    e = kept(trade(spark, d))
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a")).where("a > 4500")
    asked = c.select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("node"))
    leaves = e.select(F.col("child").alias("node")).join(e.select(F.col("parent").alias("node")), "node", "left_anti").distinct()
    rows = report.workload_coverage(e, e.where("parent LIKE 'N%'").select(F.col("child").alias("node")), asked, graph.betweenness(e), {"terminal": leaves})
    return rows.select(*[r6(x) for x in rows.columns])

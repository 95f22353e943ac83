"""Registered queries over the driver tables, each with the DuckDB SQL that gives the same rows.

Keys start with the number of the operator in the survey. Real numbers are rounded to 6 places on
both sides, since sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import divergence, draws, records, scalars
from .operators import binned, cpt, factor, gaussian, graph, particles, summary
from .plans.kept import compact, kept, kept_together
from .streaming import updates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: str, alias: str | None = None):
    return F.round(F.col(c), 6).alias(alias or c)


def base(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """The discrete network's rows: line items with their order and customer."""
    li, o, c = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return rows.select("c_mktsegment", "o_orderpriority", "o_orderstatus", "l_returnflag", "l_linestatus", *more)


BASE = "base AS (SELECT c_mktsegment, o_orderpriority, o_orderstatus, l_returnflag, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"
N1 = {"c_mktsegment": [], "o_orderpriority": ["c_mktsegment"], "o_orderstatus": ["o_orderpriority"], "l_returnflag": ["o_orderstatus"], "l_linestatus": ["o_orderstatus", "l_returnflag"]}


def cpt_sql(child: str, parents: list[str], smoothing: str = "total_mass", prior: str = "global", alpha: float = 1.0, source: str = "base", ess: float = 10.0) -> str:
    """SQL of a table's full grid: parents, child, n, prob (not rounded)."""
    p, fam = ", ".join(parents), ", ".join([*parents, child])
    values = "".join(f"(SELECT DISTINCT {x} FROM {source}) CROSS JOIN " for x in parents)
    g = f"(SELECT {child}, count(*) * 1.0 / (SELECT count(*) FROM {source}) AS g, (SELECT count(DISTINCT {child}) FROM {source}) AS k FROM {source} GROUP BY {child})"
    pi = "g" if prior == "global" else "1.0 / k"
    cells = "".join(f" * (SELECT count(DISTINCT {x}) FROM {source})" for x in parents)
    mass = {"total_mass": f"{alpha} * {pi}", "per_class": f"{alpha} * k * {pi}", "mle": "0.0", "bdeu": f"{ess} / (k{cells})"}[smoothing]
    over = f"OVER (PARTITION BY {p})" if parents else "OVER ()"
    return (
        f"SELECT {fam}, n, CASE WHEN sum(n) {over} + sum(m) {over} > 0 THEN (n + m) / (sum(n) {over} + sum(m) {over}) ELSE 1.0 / k END AS prob FROM "
        f"(SELECT {fam}, coalesce(n, 0) AS n, {mass} AS m, k FROM {values}{g} LEFT JOIN (SELECT {fam}, count(*) AS n FROM {source} GROUP BY {fam}) USING ({fam}))"
    )


def network(spark: SparkSession, d: str) -> particles.Network:
    """All tables from one aggregation that is kept, as are the tables: questions do not read the data."""
    rows = compact(kept(base(spark, d).groupBy(*N1).agg(F.count("*").alias("w"))))
    return particles.Network(dict(N1), kept_together({c: cpt.fit_cpt(rows, c, p, weight="w") for c, p in N1.items()}))


def _register_tables() -> None:
    for child, parents in N1.items():
        fam = ", ".join([*parents, child])

        def run(spark, d, child=child, parents=parents):
            return cpt.fit_cpt(base(spark, d), child, parents).select(*parents, child, "n", r6("prob"))

        query(f"c06_categorical_table_fit_{child}", f"WITH {BASE} SELECT {fam}, n, round(prob, 6) AS prob FROM ({cpt_sql(child, parents)})")(run)
    for smoothing, prior in (("per_class", "uniform"), ("mle", "uniform"), ("bdeu", "uniform"), ("per_class", "global")):
        name = {"mle": "c31_mle", "bdeu": "c31_bdeu"}.get(smoothing, f"c06_{smoothing}_{prior}")

        def run(spark, d, smoothing=smoothing, prior=prior):
            return cpt.fit_cpt(base(spark, d), "l_returnflag", ["o_orderstatus"], smoothing=smoothing, prior=prior).select("o_orderstatus", "l_returnflag", "n", r6("prob"))

        query(name, f"WITH {BASE} SELECT o_orderstatus, l_returnflag, n, round(prob, 6) AS prob FROM ({cpt_sql('l_returnflag', ['o_orderstatus'], smoothing, prior)})")(run)


_register_tables()


@query("c00_all_family_counts", f"WITH {BASE} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS node, concat_ws('|', {', '.join(sorted([*p, c]))}) AS cells, count(*) AS n FROM base GROUP BY {', '.join([*p, c])}" for c, p in N1.items()) + ")")
def all_family_counts(spark, d):
    """Counts of every family of the network from one scan."""
    return cpt.fit_all(base(spark, d), N1).select("node", F.concat_ws("|", F.map_values("cells")).alias("cells"), "n")


@query("c05_support", "SELECT DISTINCT o_orderstatus AS value FROM orders")
def support(spark, d):
    return cpt.support(table(spark, d, "orders"), "o_orderstatus").select(F.col("o_orderstatus").alias("value"))


LS = ["o_orderstatus", "l_returnflag"]


@query("q07_categorical_exact", f"WITH {BASE} SELECT l_linestatus, round(prob, 6) AS prob FROM ({cpt_sql('l_linestatus', LS)}) WHERE o_orderstatus = 'F' AND l_returnflag = 'R'")
def categorical_exact(spark, d):
    """P(l_linestatus | o_orderstatus = F, l_returnflag = R)."""
    q = spark.range(1).select(F.lit("F").alias("o_orderstatus"), F.lit("R").alias("l_returnflag"))
    return cpt.lookup(q, cpt.fit_cpt(base(spark, d), "l_linestatus", LS), "l_linestatus", LS).select("l_linestatus", r6("prob"))


@query("c07_categorical_log_prob", f"WITH {BASE}, t AS ({cpt_sql('l_linestatus', LS)}) SELECT o_orderstatus, l_returnflag, l_linestatus, count(*) AS n, round(sum(ln(greatest(prob, 1e-12))), 4) AS log_prob FROM base JOIN t USING (o_orderstatus, l_returnflag, l_linestatus) GROUP BY ALL")
def categorical_log_prob(spark, d):
    rows = base(spark, d)
    scored = cpt.log_prob(rows, cpt.fit_cpt(rows, "l_linestatus", LS), "l_linestatus", LS)
    return scored.groupBy(*LS, "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("log_prob"), 4).alias("log_prob"))


_HELD = BASE.replace("SELECT c_mktsegment", "SELECT l_orderkey % 5 = 0 AS held, c_mktsegment").replace("base AS", "every AS") + ", base AS (SELECT * FROM every WHERE NOT held), test AS (SELECT * FROM every WHERE held)"


@query("z24_held_out_nll", f"WITH {_HELD}, t AS ({cpt_sql('l_linestatus', LS)}) SELECT round(avg(-ln(greatest(prob, 1e-12))), 6) AS nll FROM test JOIN t USING (o_orderstatus, l_returnflag, l_linestatus)")
def held_out_nll(spark, d):
    """Fitted to four fifths of the orders, scored on the fifth."""
    rows, held = base(spark, d, "l_orderkey"), F.col("l_orderkey") % 5 == 0
    return cpt.log_prob(rows.where(held), cpt.fit_cpt(rows.where(~held), "l_linestatus", LS), "l_linestatus", LS).agg(F.round(F.avg(-F.col("log_prob")), 6).alias("nll"))


# exact elimination: P(c_mktsegment | l_linestatus = F)
_t = {c: cpt_sql(c, p) for c, p in N1.items()}
_JOINT = f"WITH {BASE}, a AS ({_t['c_mktsegment']}), b AS ({_t['o_orderpriority']}), c AS ({_t['o_orderstatus']}), e AS ({_t['l_returnflag']}), f AS ({_t['l_linestatus']}), j AS (SELECT c_mktsegment, o_orderpriority, o_orderstatus, l_returnflag, l_linestatus, a.prob * b.prob * c.prob * e.prob * f.prob AS p FROM a JOIN b USING (c_mktsegment) JOIN c USING (o_orderpriority) JOIN e USING (o_orderstatus) JOIN f USING (o_orderstatus, l_returnflag))"


def factors(net: particles.Network) -> list[factor.Factor]:
    return [factor.Factor([*p, c], net.tables[c].select(*p, c, F.col("prob").alias("p"))) for c, p in net.parents.items()]


@query("q15_variable_elimination", f"{_JOINT} SELECT c_mktsegment, round(sum(p) / (SELECT sum(p) FROM j WHERE l_linestatus = 'F'), 6) AS p FROM j WHERE l_linestatus = 'F' GROUP BY c_mktsegment")
def variable_elimination(spark, d):
    return factor.eliminate(factors(network(spark, d)), ["c_mktsegment"], {"l_linestatus": "F"}).select("c_mktsegment", r6("p"))


@query("q17_two_target_posterior", f"{_JOINT} SELECT o_orderpriority, l_returnflag, round(sum(p) / (SELECT sum(p) FROM j WHERE l_linestatus = 'O'), 6) AS p FROM j WHERE l_linestatus = 'O' GROUP BY o_orderpriority, l_returnflag")
def two_target_posterior(spark, d):
    return factor.eliminate(factors(network(spark, d)), ["o_orderpriority", "l_returnflag"], {"l_linestatus": "O"}).select("o_orderpriority", "l_returnflag", r6("p"))


@query("q16_factor_product_and_sum_out", f"WITH {BASE}, c AS ({_t['o_orderstatus']}), e AS ({_t['l_returnflag']}) SELECT o_orderpriority, l_returnflag, round(sum(c.prob * e.prob), 6) AS p FROM c JOIN e USING (o_orderstatus) GROUP BY o_orderpriority, l_returnflag")
def product_and_sum_out(spark, d):
    net = network(spark, d)
    f = {x.scope[-1]: x for x in factors(net)}
    return factor.sum_out(factor.multiply(f["o_orderstatus"], f["l_returnflag"]), "o_orderstatus").table.select("o_orderpriority", "l_returnflag", r6("p"))


@query("q14_intervention_vs_observation", f"{_JOINT}, do_ AS (SELECT l_linestatus, sum(e.prob * f.prob) AS p FROM e JOIN f USING (o_orderstatus, l_returnflag) WHERE o_orderstatus = 'P' GROUP BY l_linestatus) SELECT l_linestatus, round(do_.p, 6) AS p_do, round((SELECT sum(p) FROM j WHERE o_orderstatus = 'P' AND j.l_linestatus = do_.l_linestatus) / (SELECT sum(p) FROM j WHERE o_orderstatus = 'P'), 6) AS p_see FROM do_")
def intervention(spark, d):
    """An intervention drops the parents' edges; for a root cause it equals observation."""
    net = network(spark, d)
    fs = factors(net)
    cut = [f for f in fs if f.scope[-1] != "o_orderstatus"]
    done = factor.eliminate([f for f in cut if f.scope[-1] in ("l_returnflag", "l_linestatus")], ["l_linestatus"], {"o_orderstatus": "P"})
    seen = factor.eliminate(fs, ["l_linestatus"], {"o_orderstatus": "P"})
    return done.join(seen.withColumnRenamed("p", "q"), "l_linestatus").select("l_linestatus", r6("p", "p_do"), r6("q", "p_see"))


@query("q30_event_probability", f"{_JOINT} SELECT round(sum(p) FILTER (c_mktsegment = 'BUILDING' AND l_returnflag <> 'N') / sum(p), 6) AS p FROM j WHERE l_linestatus = 'F'")
def event_probability(spark, d):
    joint = factor.eliminate(factors(network(spark, d)), ["c_mktsegment", "l_returnflag"], {"l_linestatus": "F"})
    return joint.agg(F.round(F.sum(F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("l_returnflag") != "N"), F.col("p")).otherwise(0.0)), 6).alias("p"))


# linear Gaussian
_LG = "l_extendedprice / 1000 AS price, l_quantity AS qty, l_discount AS disc, l_extendedprice * (1 - l_discount) / 1000 AS revenue"


def priced(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_extendedprice / 1000 AS price", "l_quantity AS qty", "l_discount AS disc", "l_extendedprice * (1 - l_discount) / 1000 AS revenue", "l_returnflag")


@query("c02_gaussian_root_fit", "SELECT round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem")
def gaussian_root(spark, d):
    f = gaussian.fit_linear(priced(spark, d), {"qty": []})["qty"]
    return spark.createDataFrame([(round(f.intercept, 6), round(f.std, 6))], "mean double, std double")


@query("c03_linear_gaussian_fit", f"WITH t AS (SELECT {_LG} FROM lineitem) SELECT round(regr_intercept(revenue, price), 5) AS intercept, round(regr_slope(revenue, price), 5) AS slope, round(sqrt((regr_syy(revenue, price) - regr_sxy(revenue, price) * regr_sxy(revenue, price) / regr_sxx(revenue, price)) / (count(*) - 1)), 5) AS std FROM t")
def linear_gaussian(spark, d):
    f = gaussian.fit_linear(priced(spark, d), {"revenue": ["price"]})["revenue"]
    return spark.createDataFrame([(round(f.intercept, 5), round(f.coef[0], 5), round(f.std, 5))], "intercept double, slope double, std double")


@query("c29_conditional_linear_gaussian", f"WITH t AS (SELECT {_LG}, l_returnflag FROM lineitem), g AS (SELECT l_returnflag, regr_intercept(revenue, price) AS i, regr_slope(revenue, price) AS s, sqrt(greatest(regr_syy(revenue, price) - regr_sxy(revenue, price) * regr_sxy(revenue, price) / regr_sxx(revenue, price), 0) / (count(*) - 2)) AS e, count(*) AS n FROM t GROUP BY GROUPING SETS ((l_returnflag), ())) SELECT l_returnflag, n, round(i, 5) AS intercept, round(s, 5) AS slope, round(e, 5) AS std FROM g")
def conditional_linear(spark, d):
    rows = gaussian.fit_conditional(priced(spark, d), "revenue", ["l_returnflag"], ["price"])
    return spark.createDataFrame([(r["l_returnflag"], r["n"], round(r["intercept"], 5), round(r["coef"][0], 5), round(r["std"], 5)) for r in rows], "l_returnflag string, n long, intercept double, slope double, std double")


@query("p05_gaussian_log_density", "WITH m AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem) SELECT l_quantity AS qty, count(*) AS n, round(-0.5 * (((l_quantity - any_value(m)) / any_value(s)) ** 2 + 2 * ln(any_value(s)) + ln(2 * pi())), 6) AS log_density FROM lineitem, m GROUP BY l_quantity")
def gaussian_log_density(spark, d):
    rows = priced(spark, d)
    f = gaussian.fit_linear(rows, {"qty": []})["qty"]
    return rows.groupBy("qty").agg(F.count("*").alias("n")).select("qty", "n", F.round(f.log_density(), 6).alias("log_density"))


@query("q08_gaussian_exact_grid", "WITH m AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem), g AS (SELECT unnest(range(0, 33)) AS point) SELECT point::INT AS point, round(m + (-4 + point * 8.0 / 32) * s, 6) AS value, round(exp(-0.5 * (-4 + point * 8.0 / 32) ** 2) / (s * sqrt(2 * pi())), 6) AS density FROM g, m")
def gaussian_grid(spark, d):
    f = gaussian.fit_linear(priced(spark, d), {"qty": []})["qty"]
    return gaussian.density_grid(spark.range(1), F.lit(f.intercept), F.lit(f.std), 33).select("point", r6("value"), r6("density"))


@query("q18_joint_gaussian_conditioning", f"WITH t AS (SELECT {_LG} FROM lineitem), s AS (SELECT avg(price) AS mp, avg(revenue) AS mr, regr_slope(revenue, price) AS b, var_pop(price) AS vp, sqrt((regr_syy(revenue, price) - regr_sxy(revenue, price) * regr_sxy(revenue, price) / regr_sxx(revenue, price)) / (count(*) - 1)) AS e FROM t) SELECT k::BIGINT AS query_id, round(mp + b * vp / (b * b * vp + e * e) * (k * 10.0 - mr), 4) AS mean, round(sqrt(vp - b * b * vp * vp / (b * b * vp + e * e)), 4) AS std FROM s, (SELECT unnest(range(0, 8)) AS k)")
def gaussian_conditioning(spark, d):
    """The price that explains an observed revenue: evidence below the target, exactly."""
    fitted = gaussian.fit_linear(priced(spark, d), {"price": [], "revenue": ["price"]})
    q = spark.range(8).select(F.col("id").alias("query_id"), (F.col("id") * 10.0).alias("revenue"))
    out = gaussian.condition(q, [fitted["price"], fitted["revenue"]], "price", ["revenue"])
    return out.select("query_id", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


# scalar functions and workload columns
@query("p01_evidence_clamp", "SELECT event_id, round(CASE WHEN isnan(x) THEN 0 ELSE greatest(least(x, 1e6), -1e6) END, 6) AS x FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN value * 1e6 WHEN 2 THEN '-inf'::DOUBLE ELSE value END AS x FROM events)")
def evidence_clamp(spark, d):
    x = F.expr("CASE event_id % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN value * 1e6 WHEN 2 THEN double('-Infinity') ELSE value END")
    return table(spark, d, "events").select("event_id", F.round(scalars.clamp_evidence(x), 6).alias("x"))


@query("p03_softplus_and_log", "SELECT event_id, round(ln(1 + exp(-abs(value / 20 - 3))) + greatest(value / 20 - 3, 0) + 0.001, 6) AS sp, round(ln(greatest(value / 100, 1e-12)), 6) AS lg FROM events")
def softplus(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scalars.softplus(F.col("value") / 20 - 3, 0.001), 6).alias("sp"), F.round(scalars.stable_log(F.col("value") / 100), 6).alias("lg"))


@query("p06_json_path", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_path(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("p09_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


def messages(spark, d):
    kind = F.expr("CASE event_id % 4 WHEN 0 THEN concat('CUDA out of memory. Tried ', event_id, ' MiB') WHEN 1 THEN concat('State ''', user_id, '_1'' not found in pgmpy output for ''N6_d_g''') WHEN 2 THEN concat('Bad  pointer 0x', lower(hex(event_id)), ' at step ', event_id * 1000 + 123) ELSE null END")
    return table(spark, d, "events").select("event_id", "event_type", kind.alias("message"))


_MSG = "msgs AS (SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN 'CUDA out of memory. Tried ' || event_id || ' MiB' WHEN 1 THEN 'State ''' || user_id || '_1'' not found in pgmpy output for ''N6_d_g''' WHEN 2 THEN 'Bad  pointer 0x' || lower(to_hex(event_id)) || ' at step ' || (event_id * 1000 + 123) ELSE null END AS message FROM events)"
# written by hand, not from the library's lists
_SIG = r"""coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim('RuntimeError: ' || coalesce(message, ''))), '\s+', ' ', 'g'), '0x[0-9a-f]+', '<hex>', 'g'), 'state [''"][^''"]+[''"]', 'state <state>', 'g'), '(pgmpy output for) [''"][^''"]+[''"]', '\1 <var>', 'g'), '\b(node|variable|var) [''"][^''"]+[''"]', '\1 <var>', 'g'), '\bn[0-9]+[a-z0-9_]*\b', '<var>', 'g'), '[0-9]{3,}', '<num>', 'g'), '\s+', ' ', 'g')), ''), 'unknown')"""


@query("p11_error_signature", f"WITH {_MSG} SELECT {_SIG} AS signature, event_type, count(*) AS n FROM msgs GROUP BY ALL")
def error_signatures(spark, d):
    return messages(spark, d).select(records.error_signature(F.lit("RuntimeError"), F.col("message")).alias("signature"), "event_type").groupBy("signature", "event_type").agg(F.count("*").alias("n"))


@query("p12_out_of_memory", f"WITH {_MSG}, s AS (SELECT event_type, event_id, lower(coalesce(message, '')) AS t FROM msgs) SELECT event_type, count(*) FILTER (contains(t, 'out of memory') OR contains(t, 'cublas') OR contains(t, 'cudnn') OR contains(t, 'cuda error') OR contains(t, 'memoryerror') OR contains(t, 'std::bad_alloc') OR contains(t, 'cannot allocate memory') OR contains(t, 'allocation failed') OR contains(t, 'alloc failed') OR event_id % 10 = 0) AS n FROM s GROUP BY event_type")
def oom(spark, d):
    kind = F.when(F.col("event_id") % 10 == 0, "MemoryError").otherwise("RoomError")
    return messages(spark, d).groupBy("event_type").agg(F.count_if(records.is_out_of_memory(kind, F.col("message"))).alias("n"))


@query("p16_stable_seed", "SELECT n_nationkey, (42 + ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT) % 4294967296 AS seed FROM (SELECT n_nationkey, sha256(n_name) AS h FROM nation)")
def stable_seeds(spark, d):
    return table(spark, d, "nation").select("n_nationkey", scalars.stable_seed(42, F.col("n_name")).alias("seed"))


@query("p17_skeleton_id", "SELECT c_custkey, sha256(c_mktsegment || '|' || c_nationkey) AS skeleton_id FROM customer")
def skeleton_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_mktsegment", "c_nationkey"), 256).alias("skeleton_id"))


_U = "('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0"


@query("m00_uniform_draws", f"SELECT c_custkey, round({_U.format(key=chr(39) + '7|' + chr(39) + ' || c_custkey')}, 9) AS u FROM customer")
def uniform_draws(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(draws.uniform(7, "c_custkey"), 9).alias("u"))


# sampling: ancestral draws of the network's first three nodes
def _draw_sql(t: str, child: str, parents: list[str], rows: str, key: str) -> str:
    on = " AND ".join(f"r.{p} = t.{p}" for p in parents) or "true"
    cum = f"SELECT *, sum(prob) OVER ({'PARTITION BY ' + ', '.join(parents) if parents else ''} ORDER BY {child} ROWS UNBOUNDED PRECEDING) AS c FROM {t}"
    u = _U.format(key=key)
    return f"SELECT r.*, (SELECT coalesce(min(t.{child}) FILTER (t.c > {u}), max(t.{child})) FROM ({cum}) t WHERE {on}) AS {child} FROM {rows} r"


_K = "'{s}|' || r.query_id || '|' || r.particle_id || '|{v}'"
_N = 500
_PART = f"q0 AS (SELECT 0 AS query_id, unnest(range(0, {_N})) AS particle_id), a AS ({_t['c_mktsegment']}), b AS ({_t['o_orderpriority']}), c AS ({_t['o_orderstatus']})"
_S1 = f"s1 AS ({_draw_sql('a', 'c_mktsegment', [], 'q0', _K.format(s=0, v='c_mktsegment'))}), s2 AS ({_draw_sql('b', 'o_orderpriority', ['c_mktsegment'], 's1', _K.format(s=0, v='o_orderpriority'))}), s3 AS ({_draw_sql('c', 'o_orderstatus', ['o_orderpriority'], 's2', _K.format(s=0, v='o_orderstatus'))})"


@query("m01_ancestral_sampling", f"WITH {BASE}, {_PART}, {_S1} SELECT c_mktsegment, o_orderpriority, o_orderstatus, count(*) AS n FROM s3 GROUP BY ALL")
def ancestral(spark, d):
    q = spark.range(1).select(F.col("id").alias("query_id"))
    rows = particles.forward(network(spark, d), q, _N, [], [], targets=["o_orderstatus"])
    return rows.groupBy("c_mktsegment", "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


_LW = f"WITH {BASE}, {_PART}, {_S1.split(', s3 AS')[0]}, w AS (SELECT s2.c_mktsegment, c.prob FROM s2 JOIN c ON c.o_orderpriority = s2.o_orderpriority AND c.o_orderstatus = 'P')"


@query("q04_likelihood_weighting", f"{_LW} SELECT c_mktsegment, round(sum(prob) / (SELECT sum(prob) FROM w), 6) AS prob FROM w GROUP BY c_mktsegment")
def likelihood_weighting(spark, d):
    """P(c_mktsegment | o_orderstatus = P) by weighted particles; the same draws in both engines."""
    q = spark.range(1).select(F.col("id").alias("query_id"), F.lit("P").alias("ev_o_orderstatus"))
    weighted = particles.with_weights(particles.forward(network(spark, d), q, _N, ["o_orderstatus"], [], targets=["c_mktsegment"]))
    return particles.pmf(weighted, "c_mktsegment").select("c_mktsegment", r6("prob"))


@query("w02_effective_sample_size", f"{_LW} SELECT round(sum(prob) ** 2 / sum(prob * prob), 4) AS ess FROM w")
def effective_sample_size(spark, d):
    q = spark.range(1).select(F.col("id").alias("query_id"), F.lit("P").alias("ev_o_orderstatus"))
    weighted = particles.with_weights(particles.forward(network(spark, d), q, _N, ["o_orderstatus"], [], targets=["c_mktsegment"]))
    return particles.effective_size(weighted).select(F.round("ess", 4).alias("ess"))


@query("q09_rao_blackwell", f"WITH {BASE}, {_PART}, {_S1.split(', s3 AS')[0]} SELECT c.o_orderstatus, round(sum(c.prob) / {_N}, 6) AS prob FROM s2 JOIN c USING (o_orderpriority) GROUP BY c.o_orderstatus")
def rao_blackwell(spark, d):
    q = spark.range(1).select(F.col("id").alias("query_id"))
    return particles.rao_blackwell(network(spark, d), q, _N, [], [], "o_orderstatus").select("o_orderstatus", r6("prob"))


# divergences between tables of two slices
def _pmfs(spark, d):
    c = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus")))
    rows = p.groupBy("o_orderstatus").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderpriority", "p"))), lambda x: x["p"]).alias("p"))
    return rows.where("o_orderstatus = 'F'").select(F.col("p").alias("a")).crossJoin(rows.where("o_orderstatus = 'P'").select(F.col("p").alias("b")))


_PMF = "c AS (SELECT o_orderstatus AS s, o_orderpriority AS x, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS p FROM orders GROUP BY o_orderstatus, o_orderpriority), j AS (SELECT f.x, f.p AS a, q.p AS b FROM c f JOIN c q ON f.x = q.x AND f.s = 'F' AND q.s = 'P')"


@query("v03_v04_v05_divergences", f"WITH {_PMF}, k AS (SELECT *, abs(sum(a - b) OVER (ORDER BY x)) AS g FROM j) SELECT round(sum(a * ln(a / b)), 6) AS kl, round(sum(0.5 * a * ln(2 * a / (a + b)) + 0.5 * b * ln(2 * b / (a + b))), 6) AS jsd, round(sum(g), 6) AS w1 FROM k")
def divergences(spark, d):
    a, b = F.col("a"), F.col("b")
    return _pmfs(spark, d).select(F.round(divergence.kl(a, b), 6).alias("kl"), F.round(divergence.jsd(a, b), 6).alias("jsd"), F.round(divergence.wasserstein(a, b), 6).alias("w1"))


@query("v11_regression_errors", "WITH t AS (SELECT l_extendedprice / 1000 AS y, l_quantity * 0.75 AS p FROM lineitem) SELECT round(avg((y - p) ** 2), 4) AS mse, round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 5) AS r2 FROM t")
def regression_errors(spark, d):
    y, p = F.col("price"), F.col("qty") * 0.75
    errors = divergence.regression_errors(y, p)
    return priced(spark, d).agg(*[F.round(errors[n], k).alias(n) for n, k in (("mse", 4), ("mae", 4), ("r2", 5))])


# report tables
_ROB = "r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), g AS (SELECT event_type, count(*) AS n, avg(value) FILTER (i >= floor(0.25 * n) AND i < floor(0.75 * n)) AS iqm, min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM r GROUP BY event_type)"


@query("a02_robust_summary", f"WITH {_ROB} SELECT event_type, n, round(iqm, 6) AS iqm, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round((q3 - q1) / 1.349, 6) AS iqr_std, round(greatest(iqm - (q3 - q1) / 1.349, min), 6) AS low, round(least(iqm + (q3 - q1) / 1.349, max), 6) AS high FROM g")
def robust_summary(spark, d):
    out = summary.robust(table(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", "n", *[r6(c) for c in ("iqm", "q1", "median", "q3", "iqr_std", "low", "high")])


@query("a03_mean_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def mean_summary(spark, d):
    return summary.mean_summary(table(spark, d, "events"), ["event_type"], "value").select("event_type", "n", r6("mean"), r6("std"))


_ATT = "att AS (SELECT event_id // 8 AS query_id, event_type AS method, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value > 40 END AS ok, value FROM events)"


def attempts(spark, d):
    ok = F.when(F.col("event_id") % 7 != 0, F.col("value") > 40)
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 8).alias("query_id"), F.col("event_type").alias("method"), ok.alias("ok"), "value")


@query("a08_success_rate", f"WITH {_ATT} SELECT method, count(ok) AS n_total, coalesce(sum(ok::INT), 0)::BIGINT AS n_ok, round(sum(ok::INT) * 1.0 / count(ok), 6) AS rate FROM att GROUP BY method")
def success_rate(spark, d):
    return summary.success(attempts(spark, d), ["method"]).select("method", "n_total", "n_ok", r6("rate"))


@query("a16_solver_partitions", f"WITH {_ATT}, s AS (SELECT query_id, method, max(coalesce(ok, false)::INT) AS k FROM att GROUP BY ALL), t AS (SELECT query_id, coalesce(string_agg(method, '|' ORDER BY method) FILTER (k = 1), '') AS solvers, sum(k) AS k FROM s GROUP BY query_id), u AS (SELECT solvers, k = (SELECT count(DISTINCT method) FROM s) AS common, count(*) AS n FROM t GROUP BY ALL), v AS (SELECT solvers, common, n, CASE WHEN NOT common THEN round(n / sum(n) FILTER (NOT common) OVER (), 6) END AS share FROM u) SELECT * FROM v WHERE solvers <> ''")
def solver_partitions(spark, d):
    return summary.partitions(attempts(spark, d), "query_id", "method", "ok").select("solvers", "common", "n", r6("share"))


@query("a12_error_share", f"WITH {_MSG} SELECT event_type, message IS NULL AS missing, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS share FROM msgs GROUP BY event_type, message IS NULL")
def error_share(spark, d):
    rows = messages(spark, d).withColumn("missing", F.col("message").isNull())
    return summary.share(rows, ["event_type", "missing"], ["event_type"]).select("event_type", "missing", "n", r6("share"))


@query("a09_quantile_bins", "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events) SELECT (value > a)::INT + (value > b)::INT + (value > c)::INT AS bin, count(*) AS n FROM events, q GROUP BY 1")
def quantile_bins(spark, d):
    return summary.quantile_bins(table(spark, d, "events"), "value").groupBy("bin").agg(F.count("*").alias("n"))


@query("j07_pareto", "WITH t AS (SELECT p_brand, p_size, p_retailprice FROM part) SELECT p_brand, p_size, round(p_retailprice, 2) AS price FROM t x WHERE NOT EXISTS (SELECT 1 FROM t y WHERE y.p_brand = x.p_brand AND y.p_size <= x.p_size AND y.p_retailprice <= x.p_retailprice AND (y.p_size < x.p_size OR y.p_retailprice < x.p_retailprice))")
def pareto(spark, d):
    return summary.pareto(table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice").select("p_brand", "p_size", F.round("p_retailprice", 2).alias("price"))


@query("j01_prediction_ground_truth", "WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1) SELECT c_custkey, o_orderkey, round(abs(c_acctbal - o_totalprice), 4) AS error FROM customer JOIN t ON c_custkey = o_custkey")
def prediction_ground_truth(spark, d):
    """Duplicate keys of the ground truth: the last wins; unmatched predictions go."""
    truth = summary.latest(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderkey"))
    c = table(spark, d, "customer")
    return c.join(truth, c.c_custkey == truth.o_custkey).select("c_custkey", "o_orderkey", F.round(F.abs(F.col("c_acctbal") - F.col("o_totalprice")), 4).alias("error"))


@query("w08_q27_runs_and_chunks", "WITH e AS (SELECT event_id, event_type, coalesce((event_type <> lag(event_type) OVER (ORDER BY event_id))::INT, 1) AS new FROM events), r AS (SELECT *, sum(new) OVER (ORDER BY event_id) AS run FROM e) SELECT event_id, run::BIGINT AS run, ((row_number() OVER (PARTITION BY run ORDER BY event_id) - 1) // 2)::INT AS chunk FROM r")
def runs_and_chunks(spark, d):
    return summary.chunks(table(spark, d, "events"), "event_type", ["event_id"], 2).select("event_id", "run", "chunk")


@query("x06_pivot", "SELECT event_type, count(*) FILTER (value <= 20) AS low, count(*) FILTER (value > 20 AND value <= 60) AS mid, count(*) FILTER (value > 60) AS top FROM events GROUP BY event_type")
def pivot(spark, d):
    level = F.expr("CASE WHEN value <= 20 THEN 'low' WHEN value <= 60 THEN 'mid' ELSE 'top' END")
    return summary.outcome_pivot(table(spark, d, "events").withColumn("level", level), ["event_type"], "level", ["low", "mid", "top"])


@query("x05_jaccard", "WITH s AS (SELECT l_orderkey AS o, list(DISTINCT l_linenumber) AS x FROM lineitem GROUP BY 1) SELECT a.o AS a, b.o AS b, round(1 - len(list_intersect(a.x, b.x)) * 1.0 / len(list_distinct(list_concat(a.x, b.x))), 6) AS dist FROM s a JOIN s b ON b.o = a.o + 1")
def jaccard(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_set("l_linenumber").alias("x"))
    b = s.select((F.col("o") - 1).alias("o"), F.col("o").alias("b"), F.col("x").alias("y"))
    return s.join(b, "o").select(F.col("o").alias("a"), "b", F.round(summary.jaccard_distance(F.col("x"), F.col("y")), 6).alias("dist"))


# graphs: the network's edges, and a larger graph of keys
def edges(spark, d):
    pairs = [(p, c) for c, ps in N1.items() for p in ps]
    e = F.array(*[F.struct(F.lit(p).alias("parent"), F.lit(c).alias("child")) for p, c in pairs])
    return spark.range(1).select(F.explode(e).alias("e")).select("e.*")


def lineage(spark, d):
    """A graph over the whole tables: regions, nations, customers, orders and their priorities; orders have two parents."""
    n, c, o = (table(spark, d, t) for t in ("nation", "customer", "orders"))

    def arcs(df, a, x, b, y):
        return df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("parent"), F.concat(F.lit(b), F.col(y).cast("string")).alias("child"))

    return arcs(n, "R", "n_regionkey", "N", "n_nationkey").union(arcs(c, "N", "c_nationkey", "C", "c_custkey")).union(arcs(o, "C", "o_custkey", "O", "o_orderkey")).union(arcs(o, "P", "o_orderpriority", "O", "o_orderkey"))


_LINEAGE = "e AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders UNION ALL SELECT 'P' || o_orderpriority, 'O' || o_orderkey FROM orders)"


def trade(spark, d):
    """A graph of few nodes from all line items: regions, their nations, and from each nation an edge to the one it buys most from."""
    o, li, c, s, n = (table(spark, d, t) for t in ("orders", "lineitem", "customer", "supplier", "nation"))
    bought = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    most = bought.where("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("k"))
    best = most.groupBy("c_nationkey").agg(F.min(F.struct((-F.col("k")).alias("k"), F.col("s_nationkey").alias("to"))).alias("b"))
    name = lambda a, x: F.concat(F.lit(a), F.col(x).cast("string"))
    return n.select(name("R", "n_regionkey").alias("parent"), name("N", "n_nationkey").alias("child")).union(best.select(name("N", "c_nationkey"), name("N", "b.to")))


_TRADE = "k AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS k FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL), e AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION ALL SELECT 'N' || a, 'N' || b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY k DESC, b) AS r FROM k) WHERE r = 1), u AS (SELECT parent AS x, child AS y FROM e UNION SELECT child, parent FROM e)"

_E = "e(parent, child) AS (VALUES " + ", ".join(f"('{p}', '{c}')" for c, ps in N1.items() for p in ps) + ")"


@query("g03_markov_blanket", f"WITH {_LINEAGE} SELECT child AS node, parent AS member FROM e UNION SELECT parent, child FROM e UNION SELECT x.parent, y.parent FROM e x JOIN e y USING (child) WHERE x.parent <> y.parent")
def markov_blanket(spark, d):
    return graph.markov_blanket(lineage(spark, d))


@query("g04_moral_graph", f"WITH {_LINEAGE} SELECT least(parent, child) AS a, greatest(parent, child) AS b FROM e UNION SELECT x.parent, y.parent FROM e x JOIN e y USING (child) WHERE x.parent < y.parent")
def moral_graph(spark, d):
    return graph.moral(lineage(spark, d))


@query("g10_ancestors", f"WITH RECURSIVE {_LINEAGE}, r AS (SELECT parent AS ancestor, child AS descendant FROM e UNION SELECT r.ancestor, e.child FROM r JOIN e ON e.parent = r.descendant) SELECT * FROM r")
def ancestors(spark, d):
    return graph.reachable(lineage(spark, d))


@query("g06_bfs_distances", f"WITH RECURSIVE {_TRADE}, r AS (SELECT DISTINCT x AS source, x AS node, 0 AS dist FROM u UNION SELECT r.source, u.y, r.dist + 1 FROM r JOIN u ON u.x = r.node WHERE r.dist < 12) SELECT source, node, min(dist) AS dist FROM r GROUP BY ALL")
def bfs_distances(spark, d):
    return graph.distances(trade(spark, d))


@query("g07_eccentricity", f"WITH RECURSIVE {_TRADE}, r AS (SELECT DISTINCT x AS source, x AS node, 0 AS dist FROM u UNION SELECT r.source, u.y, r.dist + 1 FROM r JOIN u ON u.x = r.node WHERE r.dist < 12), s AS (SELECT source, node, min(dist) AS dist FROM r GROUP BY ALL) SELECT source AS node, max(dist) AS eccentricity FROM s GROUP BY source")
def eccentricity(spark, d):
    return graph.distances(trade(spark, d)).groupBy(F.col("source").alias("node")).agg(F.max("dist").alias("eccentricity"))


@query("g01_topological_levels", f"WITH RECURSIVE {_LINEAGE}, r AS (SELECT DISTINCT parent AS node, 0 AS level FROM e WHERE parent NOT IN (SELECT child FROM e) UNION SELECT e.child, r.level + 1 FROM r JOIN e ON e.parent = r.node) SELECT node, max(level) AS level FROM r GROUP BY node")
def topological_levels(spark, d):
    return graph.levels(lineage(spark, d))


@query("g13_parameter_counts", f"WITH {BASE}, {_E}, c(node, card) AS (" + " UNION ALL ".join(f"SELECT '{c}', count(DISTINCT {c}) FROM base" for c in N1) + ") SELECT node, ((card - 1) * coalesce((SELECT product(p.card) FROM e JOIN c p ON p.node = e.parent WHERE e.child = c.node), 1))::BIGINT AS parameters FROM c")
def parameter_counts(spark, d):
    row = base(spark, d).agg(*[F.count_distinct(c).alias(c) for c in N1])
    cards = row.unpivot([], list(N1), "node", "card")
    return graph.parameter_counts(edges(spark, d), cards)


# online updates as additive statistics
@query("u06_incremental_counts", "SELECT event_type, CAST(ts AS DATE) AS day, sum(count(*)) OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE))::BIGINT AS n FROM events GROUP BY event_type, CAST(ts AS DATE)")
def incremental_counts(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("c"))
    return daily.select("event_type", "day", F.sum("c").over(Window.partitionBy("event_type").orderBy("day")).alias("n"))


@query("u08_tumbling_windows", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, d):
    rows = updates.windowed(table(spark, d, "events"), "ts", "1 day", "1 hour", ["event_type"], "value")
    return rows.select("event_type", F.col("start").alias("hour"), "n", F.round("total", 4).alias("total"))


@query("w07_last_rows", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20")
def last_rows(spark, d):
    """A replay buffer: the last 20 rows of each group."""
    return summary.newest(table(spark, d, "events").select("event_type", "event_id"), ["event_type"], "event_id", 20)


@query("a14_error_counters", f"WITH {_MSG}, m AS (SELECT event_type, {_SIG} AS signature FROM msgs) SELECT event_type, signature, count(*) AS n FROM m GROUP BY GROUPING SETS ((event_type), (signature), (event_type, signature), ())")
def error_counters(spark, d):
    m = messages(spark, d).select("event_type", records.error_signature(F.lit("RuntimeError"), F.col("message")).alias("signature"))
    return m.cube("event_type", "signature").agg(F.count("*").alias("n"))


@query("c20_quantile_bin_edges", "SELECT event_type, round(quantile_cont(value, 0.125), 6) AS e1, round(quantile_cont(value, 0.5), 6) AS e4, round(quantile_cont(value, 0.875), 6) AS e7 FROM events GROUP BY event_type")
def bin_edges(spark, d):
    q = F.percentile("value", F.array(F.lit(0.125), F.lit(0.5), F.lit(0.875)))
    rows = table(spark, d, "events").groupBy("event_type").agg(q.alias("q"))
    return rows.select("event_type", *[F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(("e1", "e4", "e7"))])


@query("c22_binned_root_fit", "WITH q AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(floor((value - lo) / ((hi - lo) / 8)), 7)::INT AS bin, round(count(*) / (SELECT count(*) FROM events), 6) AS prob FROM events, q GROUP BY 1")
def binned_root(spark, d):
    h = particles.histogram(table(spark, d, "events"), "value", 8)
    return h.select("bin", F.round(F.col("density") * (F.col("right") - F.col("left")), 6).alias("prob"))


@query("c11_kde_log_density", "WITH p AS (SELECT value AS x FROM events), q AS (SELECT unnest(range(0, 100, 10))::DOUBLE AS v) SELECT v, round(ln(avg(exp(-0.5 * ((v - x) / 5.0) ** 2) / (5.0 * sqrt(2 * pi())))), 6) AS log_density FROM q, p GROUP BY v")
def kde(spark, d):
    """Kernel density at ten values with every row as a point: each row adds to ten partial sums."""
    rows = table(spark, d, "events").select(F.col("value").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(90), F.lit(10))).alias("v")).withColumn("v", F.col("v").cast("double"))
    k = scalars.normal_log_density(F.col("v"), F.col("x"), F.lit(5.0))
    return rows.groupBy("v").agg(F.round(F.ln(F.avg(F.exp(k))), 6).alias("log_density"))


@query("c20_c21_c25_binned_log_density", "WITH q AS (SELECT quantile_cont(value, 0.0) AS a, quantile_cont(value, 0.25) AS b, quantile_cont(value, 0.5) AS c, quantile_cont(value, 0.75) AS d, quantile_cont(value, 1.0) AS e FROM events), r AS (SELECT ((value >= b)::INT + (value >= c)::INT + (value >= d)::INT) AS bin, value, a, b, c, d, e FROM events, q) SELECT bin, count(*) AS n, round(ln(count(*) * 1.0 / sum(count(*)) OVER ()) - ln(any_value(CASE bin WHEN 0 THEN b - a WHEN 1 THEN c - b WHEN 2 THEN d - c ELSE e - d END)), 6) AS log_density FROM r GROUP BY bin")
def binned_log_density(spark, d):
    """Density of each quantile bin: log mass less log width, for every value in it alike."""
    events = table(spark, d, "events").select("value")
    rows = events.crossJoin(F.broadcast(binned.bin_edges(events, "value", 4, "quantile")))  # one row
    rows = rows.withColumn("bin", binned.bin_of(F.col("value"), F.col("edges")))
    scored = rows.join(F.broadcast(binned.frequencies(rows, "bin", 4)), "bin")  # four rows
    density = binned.log_density(F.col("value"), F.col("edges"), F.col("prob"))
    return scored.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.max(density), 6).alias("log_density"))


@query("p22_j11_nearest_support", "SELECT event_id, (CASE WHEN value <= 15 THEN 10 WHEN value <= 35 THEN 20 ELSE 50 END)::INT AS nearest FROM events")
def nearest_support(spark, d):
    values = F.array(F.lit(10), F.lit(20), F.lit(50))
    return table(spark, d, "events").select("event_id", scalars.nearest_in(F.col("value"), values).alias("nearest"))

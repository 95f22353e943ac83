"""Mixed networks, resampling along the way, mixtures of normals, batches, kept answers, merging samples, chains."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayesloom.operators import conditional, gaussian, kernel, ordered, particles
from bayesloom.plans.batch import AnswerCache, infer_batch
from bayesloom.plans.model import BeliefModel
from bayesloom.streaming import updates


def uniform(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def normal(*parts):
    u1, u2 = uniform(*parts, "a"), uniform(*parts, "b")
    return math.sqrt(-2 * math.log(u1 + 0.5 / 2**32)) * math.cos(2 * math.pi * u2)


@pytest.fixture(scope="module")
def mixed(spark):
    """c and d are discrete; y is linear in x with other coefficients for each configuration; z follows y."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(3000):
        c, d = rng.choice(["a", "b", "c"], p=[0.6, 0.3, 0.1]), int(rng.random() < 0.4)
        x = rng.normal(2.0, 1.5)
        y = {"a": 1.0, "b": -2.0, "c": 0.5}[c] * x + 3 * d + rng.normal() * (0.3 + d)
        rows.append((str(c), d, float(x), float(y), float(2 * y + 1 + 0.5 * rng.normal())))
    rows += [("c", 7, 1.0, 2.0, 5.0), (None, 1, 0.0, 1.0, 3.0), ("a", 0, None, 1.0, 3.0), ("a", 0, 1.0, None, 1.0)]
    return rows, spark.createDataFrame(rows, "c string, d int, x double, y double, z double")


CPDS = {"c": {"cpd": "categorical_table"}, "d": {"cpd": "categorical_table"}, "x": {"cpd": "linear_gaussian"}, "y": {"cpd": "conditional_gaussian"}, "z": {"cpd": "linear_gaussian"}}
NET = {"c": [], "d": [], "x": [], "y": ["c", "d", "x"], "z": ["y"]}


@pytest.fixture(scope="module")
def model(mixed):
    return BeliefModel(NET).set_learning_method(nodes_cpds=CPDS).fit(mixed[1])


def plain_regression(rows):
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    a = np.column_stack([np.ones(len(x)), x])
    coef = np.linalg.lstsq(a, y, rcond=None)[0]
    return coef[0], coef[1], math.sqrt(((y - a @ coef) ** 2).sum() / max(len(x) - 2, 1))


def test_regressions_by_configuration(mixed, model):
    rows = [r for r in mixed[0] if r[2] is not None and r[3] is not None]
    got = {(r.c, r.d) if not r.pooled else None: r for r in model.cpd("y").table.collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    want = {k: plain_regression(v) for k, v in groups.items() if len(v) >= 3 and k[0] is not None} | {None: plain_regression(rows)}
    assert set(got) == set(want) and ("c", 7) not in got
    for k, w in want.items():
        assert (got[k].intercept, got[k].coef[0], got[k].std) == pytest.approx(w, rel=1e-6, abs=1e-6)


def test_configurations_never_seen_take_the_pooled_row(spark, model):
    pooled = model.cpd("y").table.where("pooled").first()
    rows = spark.createDataFrame([(0, "zzz", 1, 2.0, 1.0), (1, None, 0, 2.0, 1.0), (2, "c", 7, 2.0, 1.0)], "row_id long, c string, d int, x double, y double")
    want = -0.5 * (((1.0 - pooled.intercept - 2 * pooled.coef[0]) / pooled.std) ** 2 + 2 * math.log(pooled.std) + math.log(2 * math.pi))
    assert [r.log_prob for r in model.handle("y").log_prob(rows).collect()] == pytest.approx([want] * 3)


def test_batches_of_statistics_merge(mixed):
    df = mixed[1]
    shift = {"x": 1.0, "y": 2.0}
    parts = [conditional.statistics(df.where(w), "y", ["c", "d"], ["x"], shift) for w in ("x > 2", "x <= 2 OR x IS NULL")]
    one = conditional.solved(conditional.merged(*parts, ["c", "d"]), "y", ["c", "d"], ["x"], shift)
    two = conditional.solved(conditional.statistics(df, "y", ["c", "d"], ["x"], shift), "y", ["c", "d"], ["x"], shift)
    key = lambda t: {(r.c, r.d, r.pooled): (r.n, round(r.intercept, 8), round(r.coef[0], 8), round(r.std, 8)) for r in t.collect()}
    assert key(one) == key(two)
    first, second = df.where("d = 0"), df.where("d <> 0")
    a = BeliefModel(NET).set_learning_method(nodes_cpds=CPDS).fit(first).update(second, "merge")
    want = {(r.c, r.d, r.pooled): (r.n, round(r.intercept, 6), round(r.std, 6)) for r in two.collect()}
    assert {(r.c, r.d, r.pooled): (r.n, round(r.intercept, 6), round(r.std, 6)) for r in a.cpd("y").table.collect()} == want


def test_no_rows_give_a_standard_normal(spark):
    empty = spark.createDataFrame([], "c string, x double, y double")
    m = BeliefModel({"c": [], "x": [], "y": ["c", "x"]}).set_learning_method(nodes_cpds={"c": {"cpd": "categorical_table"}, "x": {"cpd": "linear_gaussian"}, "y": {"cpd": "conditional_gaussian"}}).fit(empty)
    r = m.cpd("y").table.collect()
    assert [(x.pooled, x.n, x.intercept, list(x.coef), x.std) for x in r] == [(True, 0, 0.0, [0.0], 1.0)]


def test_one_scan_for_all_tables(spark):
    """Ten table nodes: the data are read once."""
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    base = spark.range(400).selectExpr(*[f"id % {k + 2} AS v{k}" for k in range(10)])
    data = base.mapInPandas(count, base.schema)
    m = BeliefModel({f"v{k}": [f"v{k - 1}"] if k else [] for k in range(10)}).set_learning_method(nodes_cpds={f"v{k}": {"cpd": "categorical_table"} for k in range(10)}).fit(data)
    assert seen.value == 400
    m.update(data, "merge")
    assert seen.value == 800 and m.cpd("v0").agg(F.sum("n")).first()[0] == 800


def plain_smc(model, table, regression, value, n, threshold, query_id, net_seed=0):
    """c, d and x are drawn, y is seen: one resampling if the effective size is too small; then z is drawn."""

    def pick(name, i):
        u, acc = uniform(net_seed, query_id, i, name), 0.0
        for v, p in table[name]:
            acc += p
            if acc > u:
                return v
        return table[name][-1][0]

    f = model.net.linear["x"]
    ps = [(pick("c", i), pick("d", i), f.intercept + f.std * normal(net_seed, query_id, i, "x")) for i in range(n)]
    logs = []
    for c, d, x in ps:
        b, w, s = regression.get((c, d), regression[None])
        logs.append(-0.5 * (((value - b - w * x) / s) ** 2 + 2 * math.log(s) + math.log(2 * math.pi)))
    e = np.exp(np.array(logs) - max(logs))
    weights = e / e.sum()
    ess = 1 / (weights**2).sum()
    if ess < threshold:
        u = uniform(net_seed, query_id, "y", "resample")
        at = np.minimum(np.searchsorted(np.cumsum(weights), (np.arange(n) + u) / n, side="left"), n - 1)
        ps, weights = [ps[i] for i in at], np.full(n, 1 / n)
    g = model.net.linear["z"]
    zs = [g.intercept + g.coef[0] * value + g.std * normal(net_seed, query_id, i, "z") for i in range(n)]
    return ess, ess < threshold, ps, weights, zs


@pytest.mark.parametrize("threshold", [0.2, 12.0])
def test_sequential_weights_equal_a_plain_version(spark, model, threshold):
    n = 120
    table = {v: sorted((r[v], r.prob) for r in model.net.tables[v].collect()) for v in ("c", "d")}
    regression = {None if r.pooled else (r.c, r.d): (r.intercept, r.coef[0], r.std) for r in model.cpd("y").table.collect()}
    asked = {1: -9.0, 2: 1.0, 3: 2.5, 4: 11.0}
    q = spark.createDataFrame(list(asked.items()), "query_id long, ev_y double")
    rows, log = particles.sequential(model.net, q, n, ["y"], [], 0, ["z"], threshold)
    got = {}
    for r in rows.collect():
        got.setdefault(r.query_id, []).append(r)
    said = {r.query_id: r for r in log.collect()}
    flags = set()
    for i, value in asked.items():
        ess, resampled, ps, weights, zs = plain_smc(model, table, regression, value, n, max(1, threshold * n) if threshold <= 1 else threshold, i)
        mine = sorted(got[i], key=lambda r: r.particle_id)
        assert [r.particle_id for r in mine] == list(range(n))
        assert (said[i].ess, said[i].resampled, said[i].node) == (pytest.approx(ess), resampled, "y")
        assert [(r.c, r.d) for r in mine] == [p[:2] for p in ps]
        assert [r.x for r in mine] == pytest.approx([p[2] for p in ps])
        assert [r.weight for r in mine] == pytest.approx(list(weights)) and [r.z for r in mine] == pytest.approx(zs)
        flags.add(resampled)
    assert flags == {True, False}


def test_particles_without_weight_are_not_resampled(spark):
    net = particles.Network({"A": [], "B": ["A"]}, {"A": spark.createDataFrame([(0, 1.0)], "A int, prob double")}, {"B": gaussian.Linear("B", ["A"], 0.0, [0.0], 0.0)})
    rows, log = particles.sequential(net, spark.createDataFrame([(1, 5.0)], "query_id long, ev_B double"), 10, ["B"], [], 0, ["A"], 0.9)
    assert rows.count() == 10 and {r.weight for r in rows.collect()} == {0.1} and not log.first().resampled


def test_mixture_of_normals(spark, mixed, model):
    """Density of z from draws of y, against the same mixture summed up here; and the mean of a chain of regressions."""
    model.set_inference_method("rao_blackwellized_marginalization", n_samples=81, n_particles=300)
    q = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "query_id long, c string, d int")
    rows = model.infer_posterior(q, "z", evidence=["c", "d"])
    assert {r.weight_kind for r in rows.collect()} == {"density"}
    above = particles.with_weights(particles.forward(model.net, q.select("query_id", F.col("c").alias("ev_c"), F.col("d").alias("ev_d")), 300, ["c", "d"], [], 0, ["y"])).collect()
    g = model.net.linear["z"]
    for i in (1, 2):
        m = np.array([g.intercept + g.coef[0] * r.y for r in above if r.query_id == i])
        mine = sorted((r.value, r.weight) for r in rows.where(F.col("query_id") == i).collect())
        v, w = map(np.array, zip(*mine, strict=True))
        spread = math.sqrt(g.std**2 + m.var())
        assert (v[0], v[-1]) == pytest.approx((m.mean() - 4 * spread, m.mean() + 4 * spread))
        want = np.exp(-0.5 * ((v[:, None] - m) / g.std) ** 2).mean(axis=1) / (g.std * math.sqrt(2 * math.pi))
        assert w == pytest.approx(want, rel=1e-9)
        assert (v * w).sum() / w.sum() == pytest.approx(m.mean(), abs=1e-3)


def test_mixture_falls_back_below_the_target(spark, model):
    model.set_inference_method("rao_blackwellized_marginalization", n_samples=9, n_particles=50)
    q = spark.createDataFrame([(1, 0.2)], "query_id long, z double")
    assert {r.weight_kind for r in model.infer_posterior(q, "y", evidence=["z"]).collect()} == {"weight"}
    model.set_inference_method("rao_blackwellized_marginalization", fallback="none")
    with pytest.raises(RuntimeError, match="fallback"):
        model.infer_posterior(q, "y", evidence=["z"])


# batches and kept answers
def ask(spark, rows):
    return spark.createDataFrame(rows, "query_id long, target string, evidence map<string,string>, do map<string,string>")


def test_batch_of_mixed_signatures(spark, model):
    model.set_inference_method("likelihood_weighting", n_samples=50)
    rows = [(1, "y", {"c": "a", "d": "0"}, None), (2, "x", {"y": "1.5"}, {"c": "b"}), (3, "y", {"d": "1", "c": "b"}, {}), (4, "c", None, None), (5, "y", {"c": "a", "d": None}, {"d": "1"})]
    got = infer_batch(model, ask(spark, rows))
    for i, target, evidence, do in rows:
        e = {k: v for k, v in (evidence or {}).items() if v is not None}
        own = spark.createDataFrame([(i,)], "query_id long")
        for k, v in {**e, **(do or {})}.items():
            own = own.withColumn(k, F.lit(v).cast(model.value_type(k)))
        want = model.infer_posterior(own, target, list(e), list(do or {}))
        a = sorted((r.value, round(r.weight, 12)) for r in got.where(F.col("query_id") == i).collect())
        b = sorted((str(r.value), round(r.weight, 12)) for r in want.select(F.col("value").cast("string").alias("value"), "weight").collect())
        assert a == b and len(a) == 50


def test_batch_errors_and_nothing(spark, model):
    assert infer_batch(model, ask(spark, [])).count() == 0
    with pytest.raises(ValueError, match="ids"):
        infer_batch(model, ask(spark, [(1, "y", None, None), (1, "x", None, None)]))
    with pytest.raises(ValueError, match="unknown"):
        infer_batch(model, ask(spark, [(1, "nothing", None, None)]))
    with pytest.raises(ValueError, match="signatures"):
        infer_batch(model, ask(spark, [(1, "y", None, None), (2, "x", None, None)]), most=1)


def test_answers_are_kept(spark, tmp_path, mixed):
    m = BeliefModel(NET).set_learning_method(nodes_cpds=CPDS).fit(mixed[1]).set_inference_method("likelihood_weighting", n_samples=20)
    cache = AnswerCache(m, str(tmp_path / "answers"))
    rows = [(1, "y", {"c": "a", "x": "1"}, None), (1, "y", {"x": "1.0000000000001", "c": "a"}, None), (2, "y", {"x": "1", "c": "b"}, {}), (None, "y", {"x": "1", "c": "b"}, None)]
    got = cache.ask(ask(spark, rows))
    assert cache.answered == 2 and got.count() == 80
    again = cache.ask(ask(spark, [*rows, (9, "y", {"x": "2"}, None)]))
    assert cache.answered == 1 and again.count() == 100
    assert AnswerCache(m, str(tmp_path / "answers")).ask(ask(spark, rows)).count() == 80
    m.set_inference_method("likelihood_weighting", n_samples=10)  # another method asks other questions
    assert cache.ask(ask(spark, rows)).count() == 40 and cache.answered == 2
    m.update(mixed[1], "merge")  # and so does another model
    cache.ask(ask(spark, rows))
    assert cache.answered == 2
    assert cache.ask(ask(spark, [])).count() == 0


# samples that merge
def test_samples_of_batches_merge_exactly(spark, tmp_path):
    df = spark.range(900).selectExpr("id", "CAST(id % 5 AS DOUBLE) AS v", "CAST(id % 2 AS DOUBLE) AS p", "id % 3 AS part").withColumn("v", F.when(F.col("id") == 7, None).otherwise(F.col("v")))
    key = lambda t: [tuple(r) for r in t.orderBy(*t.columns).collect()]
    for identity in (["id"], ["part"]):
        whole = kernel.sample(df, ["v", "p"], 100, 3, identity)
        parts = [kernel.sample(df.where(F.col("part") == i), ["v", "p"], 100, 3, identity) for i in range(3)]
        merged = kernel.merge(kernel.merge(parts[2], parts[0], 100), parts[1], 100)
        assert key(merged) == key(whole) and len(key(whole)) == 100
        assert key(kernel.sample(df.repartition(7), ["v", "p"], 100, 3, identity)) == key(whole)
    df.write.partitionBy("part").parquet(str(tmp_path / "in"))
    for i in range(3):
        df.where(F.col("part") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "stream"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "stream"))
    updates.sample_batches(stream, ["v", "p"], str(tmp_path / "out"), str(tmp_path / "c"), 100, 3, ["id"]).awaitTermination()
    assert key(updates.sampled(spark.read.parquet(str(tmp_path / "out")), 100)) == key(kernel.sample(df, ["v", "p"], 100, 3, ["id"]))
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3


def test_kernel_family_merges_batches(spark):
    df = spark.range(600).selectExpr("CAST(id AS DOUBLE) / 100 AS x")
    m = BeliefModel({"x": []}).set_learning_method(nodes_cpds={"x": {"cpd": "kde", "max_points": 50}}).fit(df.where("x < 2"))
    m.update(df.where("x >= 2"), "merge")
    labelled = df.withColumn("_label", F.when(F.col("x") < 2, 0).otherwise(1))
    want = kernel.as_points(kernel.sample(labelled, ["x"], 50, 0, ["_label"]), "x").first().points
    assert m.cpd("x").points.first().points == want and len(want) == 50


# chains
def test_chains_reach_the_exact_posterior(spark):
    """A chain x -> y -> z with y seen at one end only: chains against exact conditioning."""
    rng = np.random.default_rng(1)
    x = rng.normal(1.0, 1.2, 4000)
    y = 0.8 * x + 0.5 + 0.6 * rng.normal(size=4000)
    z = -1.1 * y + 0.9 * rng.normal(size=4000)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, z, strict=True)], "x double, y double, z double")
    net = {"x": [], "y": ["x"], "z": ["y"]}
    m = BeliefModel(net).set_learning_method(nodes_cpds={v: {"cpd": "linear_gaussian"} for v in net}).fit(df)
    m.set_sampling_method("hmc", n_samples=600, burn_in=8, step_size=0.3, n_leapfrog=5)
    q = spark.createDataFrame([(1, 3.0), (2, -2.0)], "query_id long, z double")
    got = {r.query_id: r for r in m.sample(q, evidence=["z"], targets=["x", "y"]).groupBy("query_id").agg(F.avg("x").alias("m"), F.stddev("x").alias("s"), F.count("*").alias("n")).collect()}
    exact = {r.query_id: r for r in gaussian.condition(q, [m.net.linear[v] for v in ("x", "y", "z")], "x", ["z"]).collect()}
    for i in (1, 2):
        assert got[i].n == 600 and got[i].m == pytest.approx(exact[i]["mean"], abs=0.15) and got[i].s == pytest.approx(exact[i]["std"], rel=0.15)


def test_gradients_of_families_equal_differences(spark, mixed, model):
    from bayesloom.operators import features, hmc

    df = mixed[1].dropna()
    net = particles.Network({"x": [], "y": ["x"], "z": ["x", "y"]})
    net.linear["x"] = gaussian.Linear("x", [], 2.0, [], 1.5)
    net.others["y"] = particles.Features("y", ["x"], features.fit(df, "y", ["x"], features=12))
    net.others["z"] = particles.Kernel("z", ["x", "y"], kernel.fit(df, "z", ["x", "y"], 40), 1.5, 1.0)
    at = spark.createDataFrame([(i, 1.0 + 0.3 * i, 2.0 - 0.4 * i, 4.0 + i) for i in range(4)], "i long, x double, y double, z double")
    for v in ("x", "y", "z"):
        rows = at.crossJoin(net.others["z"].points.withColumnRenamed("points", "_k_z")).withColumn("g", hmc.gradient(net, v, ["x", "y", "z"])).drop("_k_z")
        lp = lambda d, v=v: {r.i: r.t for r in hmc._log_joint(net, at.withColumn(v, F.col(v) + d), ["x", "y", "z"], "t").collect()}
        up, down = lp(1e-5), lp(-1e-5)
        for r in rows.collect():
            assert r.g == pytest.approx((up[r.i] - down[r.i]) / 2e-5, rel=1e-4, abs=1e-5)


def test_chains_with_conditional_nodes_and_free_values(spark, model):
    model.set_sampling_method("hmc", n_samples=300, burn_in=6, step_size=0.1, n_leapfrog=5)
    q = spark.createDataFrame([(1, "a", 0, 2.0)], "query_id long, c string, d int, y double")
    got = [r.x for r in model.sample(q, evidence=["c", "d", "y"], targets=["x"]).collect()]
    r = model.cpd("y").table.where("c = 'a' AND d = 0").first()
    f = model.net.linear["x"]
    precision = 1 / f.std**2 + r.coef[0] ** 2 / r.std**2
    mean = (f.intercept / f.std**2 + r.coef[0] * (2.0 - r.intercept) / r.std**2) / precision
    assert np.mean(got) == pytest.approx(mean, abs=0.1) and np.std(got) == pytest.approx(precision**-0.5, rel=0.2)
    assert model.sample(q.drop("c"), evidence=["d", "y"], targets=["c"]).count() == 300  # c is free: forward draws


def test_generated_rows_do_not_depend_on_partitions(spark, model):
    a, b = (sorted(map(tuple, model.generate(spark, 200, p).collect())) for p in (1, 5))
    assert a == b and [r[0] for r in a] == list(range(200))


# orders
def test_runs_over_ranges(spark):
    rng = random.Random(6)
    for sizes in ([1] * 30, [60], [2, 50, 1, 1, 40, 3], []):
        rows, i, want, run = [], 0, [], 0
        for s in sizes:
            key = rng.choice(["u", "v", "w", None])
            for _ in range(s):
                rows.append((i, key))
                i += 1
        last = object()
        for i, key in rows:
            if key is None or key != last:
                run, at = run + 1, 0
            want.append((i, run, at // 4))
            at, last = at + 1, key
        df = spark.createDataFrame(rows, "i long, k string").repartition(3)
        got = sorted((r.i, r.run, r.chunk) for r in ordered.runs(df, "k", ["i"], 4, 7).collect())
        assert got == want


def test_as_of_equals_a_plain_search(spark):
    rng = random.Random(8)
    left = [(i, rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, *range(40)])) for i in range(150)]
    right = [(rng.choice(["hot"] * 5 + ["a", "c", None]), rng.choice([None, *range(40)]), j) for j in range(60)]
    a = spark.createDataFrame(left, "i long, k string, t long")
    b = spark.createDataFrame(right, "k string, t long, j long")
    for ranges in (1, 9):
        got = {r.i: r.matched and tuple(r.matched) for r in ordered.as_of(a, b, "k", "t", ranges=ranges).collect()}
        for i, k, t in left:
            best = max(((u, j) for q, u, j in right if q == k and k is not None and u is not None and t is not None and u <= t), default=None)
            assert got[i] == best
    near = ordered.as_of(a, b, "k", "t", most=F.col("t") - F.col("matched.t") <= 3, ranges=5).collect()
    assert all(r.matched is None or r.t - r.matched.t <= 3 for r in near) and len(near) == 150


def test_points_within_intervals(spark):
    rng = random.Random(9)
    points = [(i, rng.choice("ab"), rng.choice([None, rng.uniform(-50, 50), float(rng.randint(-50, 50))])) for i in range(200)]
    spans = [(j, rng.choice("ab"), lo := float(rng.randint(-60, 60)), lo + rng.choice([0.0, 0.001, 1.0, 2.0, 3.7, 64.0, 500.0, -1.0])) for j in range(80)]
    spans += [(90, "a", None, 1.0), (91, "a", 0.0, float("inf")), (92, "a", float("nan"), 1.0)]
    p, s = spark.createDataFrame(points, "i long, k string, x double"), spark.createDataFrame(spans, "j long, k string, lo double, hi double")
    want = {(i, j) for i, k, x in points for j, q, lo, hi in spans if x is not None and None not in (lo, hi) and hi < float("inf") and lo <= x < hi}
    same = {(i, j) for i, j in want if points[i][1] == next(q for jj, q, *_ in spans if jj == j)}
    assert {(r.i, r.j) for r in ordered.within(p, s.drop("k"), "x", "lo", "hi").collect()} == want
    got = ordered.within(p, s, "x", "lo", "hi", "k").collect()
    assert {(r.i, r.j) for r in got} == same and len(got) == len(same)


def test_percentiles_by_counted_values(spark):
    rng = random.Random(3)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for values in ([rng.choice([1.0, 2.5, 2.5, 9.0, -4.0, None]) for _ in range(200)], [rng.gauss(0, 1) for _ in range(301)], [7.0], [None, None]):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        got = ordered.percentiles(df, "v", shares, 5).first()[0]
        known = [v for v in values if v is not None]
        assert got == (pytest.approx(list(np.quantile(known, shares))) if known else None)


def test_labels_of_bins(spark):
    from bayesloom.operators import summary

    rows = spark.createDataFrame([([0.0, 1.5, 12345.678, 2e6],), ([1.0],), (None,)], "e array<double>")
    assert [r[0] for r in rows.select(summary.bin_labels(F.col("e"))).collect()] == [["[0, 1.5]", "(1.5, 12350]", "(12350, 2000000]"], None, None]


def test_exact_answers_and_reasons(spark):
    from bayesloom.operators import workload
    from bayesloom.plans.batch import ground_truth

    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "y")], "u string, c string")
    m = BeliefModel({"u": [], "c": ["u"]}).set_learning_method(nodes_cpds={v: {"cpd": "categorical_table", "smoothing": "mle"} for v in "uc"}).fit(df)
    domain = workload.domain_of(df.unionByName(spark.createDataFrame([("never", None)], "u string, c string")), ["u", "c"])
    rows = [(1, "c", {"u": "a"}, None), (2, "u", {"c": "y"}, None), (3, "c", {"u": "zzz"}, None), (4, "other", {}, None), (5, "c", {"u": "never"}, None), (6, "u", None, None)]
    got = {r.query_id: (r.probs and [round(x, 6) for x in r.probs], r.reason) for r in ground_truth(m, ask(spark, rows), domain).collect()}
    assert got[1] == ([0.666667, 0.333333], None) and got[2] == ([0.5, 0.5, 0.0], None) and got[6] == ([0.75, 0.25, 0.0], None)
    assert got[3] == (None, "evidence outside the domain") and got[4] == (None, "target outside the domain") and got[5] == (None, "impossible evidence")
    assert m.inference[0] == "likelihood_weighting"

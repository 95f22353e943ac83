"""Small networks with answers worked out by hand, parameter recovery, and the error contract."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayesloom.operators import factor, gaussian, particles
from bayesloom.plans.model import BeliefModel



@pytest.fixture(scope="module")
def abc(spark):
    net = particles.Network({"A": [], "B": ["A"], "C": ["A", "B"]})
    net.tables = {
        "A": spark.createDataFrame([(0, 0.6), (1, 0.4)], "A int, prob double"),
        "B": spark.createDataFrame([(0, 0, 0.7), (0, 1, 0.3), (1, 0, 0.2), (1, 1, 0.8)], "A int, B int, prob double"),
        "C": spark.createDataFrame([(0, 0, 0, 0.5), (0, 0, 1, 0.5), (0, 1, 0, 0.4), (0, 1, 1, 0.6), (1, 0, 0, 0.3), (1, 0, 1, 0.7), (1, 1, 0, 0.2), (1, 1, 1, 0.8)], "A int, B int, C int, prob double"),
    }
    return net


def factors(net):
    return [factor.Factor([*p, c], net.tables[c].select(*p, c, F.col("prob").alias("p"))) for c, p in net.parents.items()]


@pytest.mark.parametrize(("target", "evidence", "value", "want"), [("B", {}, 1, 0.50), ("C", {}, 1, 0.630), ("A", {"C": 1}, 1, 0.312 / 0.630), ("A", {"B": 1}, 1, 0.64)])
def test_elimination(abc, target, evidence, value, want):
    got = {r[target]: r.p for r in factor.eliminate(factors(abc), [target], evidence).collect()}
    assert got[value] == pytest.approx(want)


def test_elimination_order_is_small_first():
    assert factor.elimination_order([["a", "b"], ["b", "c"], ["c", "d"]], {"d"}) == ["a", "b", "c"]


def test_weighting_agrees_with_elimination(spark, abc):
    q = spark.createDataFrame([(1, 1)], "query_id long, ev_C int")
    w = particles.with_weights(particles.forward(abc, q, 4000, ["C"], [], targets=["A"]))
    got = {r.A: r.prob for r in particles.pmf(w, "A").collect()}
    assert got[1] == pytest.approx(0.312 / 0.630, abs=0.04)
    again = particles.with_weights(particles.forward(abc, q.repartition(3), 4000, ["C"], [], targets=["A"]).repartition(7))
    assert {r.A: round(r.prob, 9) for r in particles.pmf(again, "A").collect()} == {k: round(v, 9) for k, v in got.items()}


def test_intervention_differs_from_observation(spark, abc):
    q = spark.createDataFrame([(1, 1)], "query_id long, do_B int")
    w = particles.with_weights(particles.forward(abc, q, 4000, [], ["B"], targets=["A"]))
    assert {r.A: r.prob for r in particles.pmf(w, "A").collect()}[1] == pytest.approx(0.4, abs=0.04)


def test_resampling_keeps_the_mean(spark, abc):
    q = spark.createDataFrame([(1, 1)], "query_id long, ev_C int")
    w = particles.with_weights(particles.forward(abc, q, 1000, ["C"], [], targets=["A"]))
    r = particles.resample(w)
    assert r.count() == 1000
    a, b = (particles.statistics(x, "A").first()["mean"] for x in (w, r))
    assert a == pytest.approx(b, abs=0.01)


def test_linear_recovery_and_conditioning(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    y = 1.5 * x + 0.4 + 0.15 * rng.normal(size=4000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    f = gaussian.fit_linear(df, {"x": [], "y": ["x"]})
    assert f["y"].coef[0] == pytest.approx(1.5, abs=0.02)
    assert f["y"].intercept == pytest.approx(0.4, abs=0.02)
    assert f["y"].std == pytest.approx(0.15, abs=0.01)
    got = gaussian.condition(spark.createDataFrame([(1.9,)], "y double"), [f["x"], f["y"]], "x", ["y"]).first()
    assert got["mean"] == pytest.approx(1.0, abs=0.02)


def disease(spark):
    rows = [(e, d, int(e + d > 0)) for e in (0, 1) for d in (0, 1) for _ in range(3 + 2 * (e == d))]
    return spark.createDataFrame(rows, "E int, D int, F int")


def fitted(spark):
    m = BeliefModel({"E": [], "D": ["E"], "F": ["D"]})
    m.set_learning_method("node_wise", {v: {"cpd": "categorical_table"} for v in "EDF"})
    return m.fit(disease(spark))


def test_model_posteriors_agree(spark):
    m = fitted(spark)
    q = spark.createDataFrame([(1, 1), (2, 0)], "query_id long, F int")
    exact = m.set_inference_method("variable_elimination").infer_posterior(q, "E", ["F"])
    exact = {(r.query_id, r.value): r.weight for r in exact.collect()}
    assert sum(v for (k, _), v in exact.items() if k == 1) == pytest.approx(1)
    m.set_inference_method("likelihood_weighting", n_samples=3000)
    means = {r.query_id: r["mean"] for r in m.statistics(m.infer_posterior(q, "E", ["F"])).collect()}
    assert means[1] == pytest.approx(exact[1, 1], abs=0.05)
    m.set_inference_method("categorical_exact")
    d = spark.createDataFrame([(1, 1)], "query_id long, E int")
    assert sum(r.weight for r in m.infer_posterior(d, "D", ["E"]).collect()) == pytest.approx(1)
    rel = m.infer_relative(d, d.withColumn("E", F.lit(0)), "D", ["E"], [], ["E"]).first()
    assert rel["delta_mean"] > 0


def test_updates_and_persistence(spark, tmp_path):
    m = fitted(spark)
    before = {r.D: r.n for r in m.counts["D"].groupBy("D").agg(F.sum("n").alias("n")).collect()}
    m.update(disease(spark), "merge")
    after = {r.D: r.n for r in m.counts["D"].groupBy("D").agg(F.sum("n").alias("n")).collect()}
    assert after == {k: 2 * v for k, v in before.items()}
    m.save(str(tmp_path / "model"))
    again = BeliefModel.load(spark, str(tmp_path / "model"))
    key = lambda t: sorted(map(tuple, t.collect()))
    assert key(again.cpd("D").select("E", "D", F.round("prob", 9))) == key(m.cpd("D").select("E", "D", F.round("prob", 9)))
    m.update(disease(spark), "replay_buffer", max_size=5)
    assert m.buffer.count() == 5


def test_errors(spark):
    with pytest.raises(ValueError, match="cycle"):
        BeliefModel({"a": ["b"], "b": ["a"]})
    m = BeliefModel({"E": [], "D": ["E"], "F": ["D"]})
    with pytest.raises(RuntimeError):
        m.fit(disease(spark))
    with pytest.raises(RuntimeError):
        m.update(disease(spark), "merge")
    with pytest.raises(ValueError, match="likelihood_weighting"):
        m.set_inference_method("nothing")
    m = fitted(spark)
    q = spark.createDataFrame([(1, 1, 1)], "query_id long, E int, D int")
    with pytest.raises(ValueError, match="unknown target"):
        m.infer_posterior(q, "Z")
    with pytest.raises(ValueError, match="in evidence and intervention"):
        m.infer_posterior(q, "F", ["E"], ["E"])
    with pytest.raises(ValueError, match="missing"):
        m.fit(disease(spark).drop("E"))


def continuous(spark, n=600):
    rng = np.random.default_rng(3)
    x = rng.normal(size=n)
    y = 1.2 * x + 0.3 + 0.2 * rng.normal(size=n)
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")


FAMILIES = [{"cpd": "linear_gaussian"}, {"cpd": "kde", "bandwidth": 0.2, "parent_bandwidth": 0.2}, {"cpd": "rff_gaussian", "features": 32}]


@pytest.mark.parametrize("conf", FAMILIES, ids=lambda c: c["cpd"])
def test_families_by_name(spark, conf):
    """Draws and densities of y given x, and the posterior of y, of every family that takes a number as parent."""
    m = BeliefModel({"x": [], "y": ["x"]})
    m.set_learning_method("node_wise", {"x": {"cpd": "binned", "bins": 12} if conf["cpd"] != "linear_gaussian" else conf, "y": conf}).fit(continuous(spark))
    h = m.handle("y")
    rows = spark.createDataFrame([(0, -0.5), (1, 0.8)], "row_id long, x double")
    got = {r.row_id: r for r in h.conditional_mean_std(rows, n=400).collect()}
    for k, x in ((0, -0.5), (1, 0.8)):
        assert got[k]["mean"] == pytest.approx(1.2 * x + 0.3, abs=0.15) and 0.1 < got[k]["std"] < 0.45
    near, far = (h.log_prob(rows.withColumn("y", 1.2 * F.col("x") + 0.3 + off)).collect() for off in (0.0, 1.5))
    assert all(a.log_prob > b.log_prob for a, b in zip(near, far, strict=True))
    assert h.pdf(rows.withColumn("y", F.lit(0.3))).first()["pdf"] >= 0
    assert h.sample(rows, 7).count() == 14
    m.set_inference_method("likelihood_weighting", n_samples=300)
    q = spark.createDataFrame([(1, 0.8)], "query_id long, x double")
    assert m.statistics(m.infer_posterior(q, "y", ["x"])).first()["mean"] == pytest.approx(1.26, abs=0.15)
    assert h.summary()["family"] == conf["cpd"] and h.conditional(rows).first()["conditional"]["kind"] in ("normal_params", "empirical_samples")
    with pytest.raises(ValueError, match="missing"):
        h.log_prob(rows)


def test_handle_of_a_table(spark):
    m = fitted(spark)
    rows = spark.createDataFrame([(0, 0), (1, 1)], "row_id long, E int")
    h = m.handle("D")
    got = h.conditional(rows).collect()
    probs = {(r.E, r.D): r.prob for r in m.cpd("D").collect()}
    assert all(r.conditional["probs"] == pytest.approx([probs[r.E, 0], probs[r.E, 1]]) for r in got)
    assert {r.row_id: r["mean"] for r in h.conditional_mean_std(rows).collect()} == pytest.approx({k: probs[k, 1] for k in (0, 1)})
    assert {r.row_id: r.pdf for r in h.pdf(rows.withColumn("D", F.lit(1))).collect()} == pytest.approx({k: probs[k, 1] for k in (0, 1)})
    with pytest.raises(KeyError):
        m.handle("Z")


def test_damped_weights_and_gibbs(spark):
    m = fitted(spark)
    q = spark.createDataFrame([(1, 1), (2, 0)], "query_id long, F int")
    exact = {r.query_id: r.weight for r in m.set_inference_method("variable_elimination").infer_posterior(q, "E", ["F"]).where("value = 1").collect()}
    m.set_inference_method("lbp", n_samples=2000)
    damped = {r.query_id: r["mean"] for r in m.statistics(m.infer_posterior(q, "E", ["F"])).collect()}
    assert all(damped[k] == pytest.approx(exact[k], abs=0.05) for k in exact)
    with pytest.raises(ValueError, match="damping"):
        m.set_inference_method("lbp", damping=1.5)
    m.set_sampling_method("gibbs", n_samples=400, burn_in=2)
    drawn = m.sample(q, ["F"]).groupBy("query_id").agg(F.avg("E").alias("e"), F.count("*").alias("n"), F.min("F").alias("lo"), F.max("F").alias("hi")).collect()
    assert {r.query_id: r.n for r in drawn} == {1: 400, 2: 400}
    assert all(r.lo == r.hi == (1 if r.query_id == 1 else 0) for r in drawn)
    by_id = {r.query_id: r.e for r in drawn}
    assert (by_id[1] > by_id[2]) == (exact[1] > exact[2])
    again = m.sample(q.repartition(3), ["F"]).groupBy("query_id").agg(F.avg("E").alias("e")).collect()
    assert {r.query_id: r.e for r in again} == by_id


def test_relative_to_one_query_and_to_none(spark):
    m = fitted(spark)
    m.set_inference_method("categorical_exact")
    q = spark.createDataFrame([(1, 1), (2, 0)], "query_id long, E int")
    one = spark.createDataFrame([(7, 0)], "query_id long, E int")
    got = {r.query_id: r for r in m.infer_relative(q, one, "D", ["E"], [], ["E"]).collect()}
    assert set(got) == {1, 2} and got[2]["delta_mean"] == pytest.approx(0) and got[1]["delta_mean"] > 0
    free = {r.query_id: r for r in m.infer_relative(q, None, "D", ["E"]).collect()}
    assert set(free) == {1, 2} and free[1]["delta_mean"] > 0 > free[2]["delta_mean"]


def test_ema_moves_parameters(spark):
    m = fitted(spark)
    before = {(r.E, r.D): r.prob for r in m.cpd("D").collect()}
    new = spark.createDataFrame([(0, 1, 1), (1, 1, 1), (1, 0, 1)], "E int, D int, F int")
    other = fitted(spark).fit(new)
    want = {(r.E, r.D): r.prob for r in other.cpd("D").collect()}
    m.update(new, "ema", alpha=0.25)
    assert {(r.E, r.D): r.prob for r in m.cpd("D").collect()} == pytest.approx({k: 0.75 * before[k] + 0.25 * want[k] for k in before})


def test_updates_keep_plans_small(spark):
    m = fitted(spark)
    sizes = []
    for _ in range(4):
        m.update(disease(spark), "merge")
        sizes.append(len(m.counts["D"]._jdf.queryExecution().optimizedPlan().toString()))
    assert len(set(sizes)) == 1
    assert m.counts["D"].agg(F.sum("n")).first()[0] == 5 * disease(spark).count()

"""Saving every family, families and methods of one's own, softmax over bins, handles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayesloom.operators import binned
from bayesloom.plans import model as models
from bayesloom.plans.model import BeliefModel

KINDS = {
    "c": {"cpd": "categorical_table"},
    "x": {"cpd": "binned", "bins": 5},
    "k": {"cpd": "kde", "max_points": 40},
    "r": {"cpd": "rff_gaussian", "features": 8},
    "n": {"cpd": "gaussian_nn", "hidden": 4, "steps": 3},
    "s": {"cpd": "softmax_nn", "hidden": 4, "steps": 3},
    "b": {"cpd": "softmax_nn", "bins": 4, "hidden": 4, "steps": 3, "within": "gaussian"},
    "g": {"cpd": "gaussian_process", "max_points": 30, "steps": 5},
    "m": {"cpd": "conditional_gaussian"},
    "l": {"cpd": "linear_gaussian"},
}
NET = {"c": [], "x": [], "k": ["x"], "r": ["x"], "n": ["x"], "s": ["c"], "b": ["x"], "g": ["x"], "m": ["c", "x"], "l": ["m"]}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    c = np.where(rng.random(300) < 0.5, "u", "v")
    rows = [(str(k), float(v), *(float(v * s + rng.normal() * 0.3) for s in (1, 2, -1)), "hi" if k == "u" else "lo", *(float(v * s + rng.normal() * 0.3) for s in (3, -2, 1, 0.5))) for k, v in zip(c, x, strict=True)]
    return spark.createDataFrame(rows, "c string, x double, k double, r double, n double, s string, b double, g double, m double, l double")


def test_every_family_is_saved_and_loaded(spark, data, tmp_path):
    m = BeliefModel(NET, seed=3).set_learning_method(nodes_cpds=KINDS).set_inference_method("importance_sampling", n_samples=7).fit(data)
    m.save(str(tmp_path / "model"))
    again = BeliefModel.load(spark, str(tmp_path / "model"))
    assert again.cpds == m.cpds and again.inference == m.inference and again.types == m.types
    few = data.limit(5).withColumn("row_id", F.monotonically_increasing_id())
    for v in NET:
        a, b = ([round(r.log_prob, 9) for r in h.handle(v).log_prob(few).orderBy("row_id").collect()] for h in (m, again))
        assert a == pytest.approx(b) and all(math.isfinite(x) or v == "x" for x in a)
    q = spark.range(3).select(F.col("id").alias("query_id"))
    draws = [sorted(map(str, h.sample(q).select("query_id", "particle_id", *sorted(NET)).limit(10_000).collect())) for h in (m.set_sampling_method("ancestral", n_samples=4), again.set_sampling_method("ancestral", n_samples=4))]
    assert draws[0] == draws[1]
    kept = {v: again.handle(v).state_dict() for v in NET}
    assert kept["l"]["std"] == m.net.linear["l"].std and kept["b"]["within"] == "gaussian" and "table" in kept["g"]


def test_merging_goes_on_after_loading(spark, data, tmp_path):
    some = {v: KINDS[v] for v in ("c", "x", "k", "m")} | {"x": {"cpd": "linear_gaussian"}}
    net = {v: NET[v] for v in some}
    m = BeliefModel(net).set_learning_method(nodes_cpds=some).fit(data.where("x < 0"))
    m.save(str(tmp_path / "model"))
    again = BeliefModel.load(spark, str(tmp_path / "model"))
    assert again.fingerprint() != "" and again.update(data.where("x >= 0"), "streaming_stats").cpd("c").agg(F.sum("n")).first()[0] == 300
    m.update(data.where("x >= 0"), "merge")
    assert again.cpd("k").points.first() == m.cpd("k").points.first()
    assert sorted(map(str, again.cpd("m").table.collect())) == sorted(map(str, m.cpd("m").table.collect()))


def test_softmax_over_bins(spark):
    rng = np.random.default_rng(1)
    x = rng.choice([-1.0, 1.0], size=1200)
    y = np.where(x > 0, rng.uniform(5, 9, 1200), rng.uniform(-3, 1, 1200))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    m = BeliefModel({"x": [], "y": ["x"]}).set_learning_method(nodes_cpds={"x": {"cpd": "linear_gaussian"}, "y": {"cpd": "softmax_nn", "bins": 6, "kind": "uniform", "within": "uniform", "smoothing": 0.02, "hidden": 6, "steps": 40, "rate": 0.1}}).fit(df)
    rows = spark.createDataFrame([(0, -1.0), (1, 1.0)], "row_id long, x double")
    got = {r.row_id: r for r in m.handle("y").conditional_mean_std(rows, n=300).collect()}
    assert got[0]["mean"] == pytest.approx(-1.0, abs=0.7) and got[1]["mean"] == pytest.approx(7.0, abs=0.7)
    grid = spark.range(-300, 1000).select(F.lit(1.0).alias("x"), (F.col("id") / 100 + 0.005).alias("y"))
    assert m.handle("y").pdf(grid).agg(F.sum("pdf")).first()[0] / 100 == pytest.approx(1.0, abs=0.02)


@pytest.mark.parametrize("within", ["uniform", "triangular", "gaussian"])
def test_density_within_bins_sums_to_one(spark, within):
    edges = F.array(*[F.lit(float(e)) for e in (0, 1, 3, 4)])
    x = spark.range(-400, 800).select(((F.col("id") + 0.5) / 100).alias("x"))
    mass = F.element_at(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)), binned.bin_of(F.col("x"), edges) + 1)
    total = x.agg(F.sum(F.exp(binned.log_density(F.col("x"), edges, mass, within))) / 100).first()[0]
    # a gaussian reaches over its bin's edges, where the density is the next bin's
    assert total == pytest.approx(1.0, abs=0.12 if within == "gaussian" else 0.01)
    u = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"))
    drawn = u.select(binned.draw_within(F.lit(1), edges, F.col("u"), within, (F.col("u") - 0.5) * 3, clip=True).alias("v")).agg(F.min("v"), F.max("v"), F.avg("v")).first()
    assert drawn[0] >= 1 and drawn[1] <= 3 and drawn[2] == pytest.approx(2.0, abs=0.01)
    with pytest.raises(ValueError, match="normal draw|unknown"):
        binned.draw_within(F.lit(1), edges, F.lit(0.5), "gaussian")


def test_families_and_methods_of_ones_own(spark, data):
    class Always:
        family = "always"

        def __init__(self, child, value):
            self.child, self.value = child, value

        def draw(self, rows, seed, keys):
            return rows.withColumn(self.child, F.lit(self.value))

        def log_prob(self, rows):
            return rows.withColumn("log_prob", F.when(F.col(self.child) == self.value, 0.0).otherwise(float("-inf")))

        def size(self):
            return {"value": self.value}

    try:
        models.register("cpd", "always", value=1.0)(lambda data, child, parents, value: Always(child, value))

        @models.register("inference", "first_guess", guess=4.0)
        def guess(model, q, target, evidence, do, guess):
            return q.select("query_id", F.lit(guess).alias("value"), F.lit(1.0).alias("weight"), F.lit("weight").alias("weight_kind"))

        m = BeliefModel({"x": [], "m": ["x"]}).set_learning_method(nodes_cpds={"x": {"cpd": "linear_gaussian"}, "m": {"cpd": "always", "value": 7.0}}).fit(data)
        q = spark.range(2).select(F.col("id").alias("query_id"))
        assert {r.value for r in m.infer_posterior(q, "m").collect()} == {7.0}
        assert [r.value for r in m.set_inference_method("first_guess").infer_posterior(q, "x").collect()] == [4.0, 4.0]
        with pytest.raises(ValueError, match="not saved"):
            m.save("/nowhere")
        with pytest.raises(ValueError, match="already"):
            models.register("cpd", "kde")
        with pytest.raises(ValueError, match="kind"):
            models.register("other", "x")
    finally:
        for kind, name, known in (("cpd", "always", models.CPDS), ("inference", "first_guess", models.INFERENCE)):
            models.OWN[kind].pop(name, None)
            known.pop(name, None)


def test_handles_export_and_clone(spark, data):
    m = BeliefModel({"x": [], "l": ["x"], "c": []}).set_learning_method(nodes_cpds={"x": {"cpd": "linear_gaussian"}, "l": {"cpd": "linear_gaussian"}, "c": KINDS["c"]}).fit(data)
    h = m.handle("l")
    assert h.export_config() == {"node": "l", "parents": ["x"], "family": "linear_gaussian", "settings": {"cpd": "linear_gaussian", "ridge": 1e-6}}
    copy, rows = h.clone(), data.limit(3)
    before = [r.log_prob for r in copy.log_prob(rows).collect()]
    m.fit(data.withColumn("l", F.col("l") * 5 + 3))
    assert [r.log_prob for r in copy.log_prob(rows).collect()] == before != [r.log_prob for r in m.handle("l").log_prob(rows).collect()]
    assert h.state_dict()["coef"] != copy.state_dict()["coef"] and "table" in m.handle("c").state_dict()

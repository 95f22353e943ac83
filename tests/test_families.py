"""Binned, kernel and random-feature families against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayesloom.operators import binned, features, kernel


def values(spark, xs):
    return spark.createDataFrame([(None if x is None else float(x),) for x in xs], "x double")


def test_edges_and_bins(spark):
    df = values(spark, [*np.linspace(0, 1, 9), None])
    edges = binned.bin_edges(df, "x", 4)
    assert edges.first()["edges"] == pytest.approx([0, 0.25, 0.5, 0.75, 1])
    at = values(spark, [-1, 2, 0.3, 1.0, None]).crossJoin(edges).select(binned.bin_of(F.col("x"), F.col("edges")).alias("b")).collect()
    assert [r.b for r in at] == [0, 3, 1, 3, None]
    same = binned.bin_edges(values(spark, [2.0] * 5), "x", 3, "quantile").first()["edges"]
    assert all(b > a for a, b in zip(same, same[1:], strict=False))
    normal = binned.bin_edges(values(spark, np.linspace(-3, 3, 61)), "x", 2, "gaussian").first()["edges"]
    assert normal == pytest.approx([-3, 0, 3])
    assert binned.bin_edges(df.limit(0), "x", 4).first()["edges"] is None
    with pytest.raises(ValueError, match="quantile"):
        binned.bin_edges(df, "x", 4, "other")


def test_frequencies_and_densities(spark):
    df = spark.createDataFrame([(0,), (0,), (2,), (None,)], "b int")
    probs = {r.bin: r.prob for r in binned.frequencies(df, "b", 3, smoothing=0.3).collect()}
    assert probs == pytest.approx({0: 0.7 * 2 / 3 + 0.1, 1: 0.1, 2: 0.7 / 3 + 0.1})
    grid = values(spark, np.linspace(-0.05, 2.05, 2101)).withColumn("e", F.array(F.lit(0.0), F.lit(0.5), F.lit(2.0)))
    mass = F.when(F.col("x") < 0.5, 0.3).otherwise(0.7)
    for within in ("uniform", "triangular"):  # a gaussian reaches over the edges, see test_stored
        total = grid.agg(F.sum(F.exp(binned.log_density(F.col("x"), F.col("e"), mass, within))) * 0.001).first()[0]
        assert total == pytest.approx(1, abs=0.01)
    clipped = values(spark, [9.0]).withColumn("e", F.array(F.lit(0.0), F.lit(0.5), F.lit(2.0)))
    assert clipped.select(binned.log_density(F.col("x"), F.col("e"), F.lit(0.7), clip=True)).first()[0] == pytest.approx(np.log(0.7 / 1.5))
    drawn = spark.range(2000).withColumn("u", (F.col("id") + 0.5) / 2000)
    rows = binned.draw_bin(binned.frequencies(df, "b", 3), drawn, [], F.col("u")).groupBy("bin").count().collect()
    assert {r.bin: r["count"] for r in rows} == {0: 1333, 2: 667}
    mid = drawn.withColumn("e", F.array(F.lit(1.0), F.lit(3.0))).select(F.avg(binned.draw_within(F.lit(0), F.col("e"), F.col("u"), "triangular"))).first()[0]
    assert mid == pytest.approx(2, abs=1e-3)


def test_kernel_density(spark):
    p = np.linspace(-1, 1, 7)
    df = spark.createDataFrame([(float(a), float(np.sin(a))) for a in p] + [(None, 1.0)], "p double, x double")
    points = kernel.fit(df, "x", ["p"])
    q = spark.createDataFrame([(-0.3, -0.2), (0.5, 0.4)], "p double, x double")
    got = [r.log_prob for r in kernel.log_prob(q, points, "x", ["p"], 0.4, 0.3).orderBy("p").collect()]

    def log_kernel(a, b, h):
        return -0.5 * ((a - b) / h) ** 2 - np.log(h * np.sqrt(2 * np.pi))

    want = [np.log(np.exp(log_kernel(a, p, 0.3) + log_kernel(b, np.sin(p), 0.4)).sum() / np.exp(log_kernel(a, p, 0.3)).sum()) for a, b in ((-0.3, -0.2), (0.5, 0.4))]
    assert got == pytest.approx(want)
    root = kernel.log_prob(q, kernel.fit(df, "x"), "x", bandwidth=0.4).orderBy("p").first()["log_prob"]
    xs = np.append(np.sin(p), 1.0)
    assert root == pytest.approx(np.log(np.exp(log_kernel(-0.2, xs, 0.4)).mean()))
    rows = spark.range(3000).select(F.col("id").alias("query_id"), F.lit(0.5).alias("p"))
    drawn = kernel.draw(rows, points, "x", ["p"], F.lit(1), "query_id", bandwidth=0.05, parent_bandwidth=0.2)
    w = np.exp(log_kernel(0.5, p, 0.2))
    assert drawn.agg(F.avg("x")).first()[0] == pytest.approx((w * np.sin(p)).sum() / w.sum(), abs=0.03)
    assert kernel.fit(df, "x", ["p"], max_points=3).select(F.size("points")).first()[0] == 3
    assert kernel.log_prob(q, kernel.fit(df.limit(0), "x"), "x").count() == 0


def test_random_features(spark):
    rng = np.random.default_rng(3)
    a = rng.uniform(-3, 3, 3000)
    y = np.sin(2 * a) * 5 + 20 + 0.1 * rng.normal(size=3000)
    df = spark.createDataFrame([(float(u), float(v)) for u, v in zip(a, y, strict=True)] + [(None, 1.0)], "a double, y double")
    model = features.fit(df, "y", ["a"], features=100, length_scale=0.5)
    assert model.std < 0.4
    got = features.predict(df.limit(50).union(spark.createDataFrame([(None, 0.0)], "a double, y double")), model).collect()
    assert all(abs(r["mean"] - (np.sin(2 * r.a) * 5 + 20)) < 0.5 for r in got if r.a is not None and abs(r.a) < 2.8)
    assert [r["mean"] for r in got if r.a is None] == [None]
    again = features.fit(df.repartition(5), "y", ["a"], features=100, length_scale=0.5)
    assert again.std == pytest.approx(model.std, rel=1e-4)
    assert features.fit(df.limit(0), "y", ["a"]).std == 1.0


def test_gradients_equal_differences():
    """Gradients of both losses against differences of the loss."""
    from bayesloom.operators import neural

    rng = np.random.default_rng(0)
    for loss, outs, y in ((neural.mixture_loss, 6, rng.normal(size=9)), (neural.class_loss, 4, rng.integers(0, 4, 9).astype(float))):
        net = neural.Net(["a", "b"], outs, 5, np.zeros(2), np.ones(2), rng.normal(size=3 * 5 + 6 * outs))
        x = rng.normal(size=(9, 2))
        z, h, out = net.forward(x)
        g = net.backward(z, h, loss(out, y)[1])
        for k in range(0, len(g), 7):
            w = net.weights.copy()
            net.weights[k] += 1e-6
            up = loss(net.forward(x)[2], y)[0]
            net.weights = w.copy()
            net.weights[k] -= 1e-6
            down = loss(net.forward(x)[2], y)[0]
            net.weights = w
            assert g[k] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)


def test_neural_families(spark):
    from bayesloom.plans.model import BeliefModel

    rng = np.random.default_rng(2)
    x = rng.normal(size=800)
    y = np.sin(1.5 * x) + 0.1 * rng.normal(size=800)
    c = np.where(x + 0.2 * rng.normal(size=800) > 0, "hi", "lo")
    df = spark.createDataFrame([(float(a), float(b), str(k), str(k) if rng.random() < 0.9 else "lo") for a, b, k in zip(x, y, c, strict=True)], "x double, y double, c string, e string").coalesce(2)
    m = BeliefModel({"x": [], "y": ["x"], "c": ["x"], "e": ["c"]})
    nn = {"hidden": 12, "steps": 40, "rate": 0.1}
    m.set_learning_method("node_wise", {"x": {"cpd": "gaussian_nn", **nn, "steps": 15}, "y": {"cpd": "mdn", "components": 2, **nn}, "c": {"cpd": "softmax_nn", **nn}, "e": {"cpd": "categorical_embedded_softmax", **nn}}).fit(df)
    rows = spark.createDataFrame([(0, -1.0), (1, 1.0)], "row_id long, x double")
    got = {r.row_id: r["mean"] for r in m.handle("y").conditional_mean_std(rows, n=200).collect()}
    assert got[0] == pytest.approx(np.sin(-1.5), abs=0.3) and got[1] == pytest.approx(np.sin(1.5), abs=0.3)
    p = {r.row_id: r.pdf for r in m.handle("c").pdf(rows.withColumn("c", F.lit("hi"))).collect()}
    assert p[0] < 0.1 and p[1] > 0.9
    q = spark.createDataFrame([(0, "lo"), (1, "hi")], "row_id long, c string")
    p = {r.row_id: r.pdf for r in m.handle("e").pdf(q.withColumn("e", F.lit("hi"))).collect()}
    assert p[0] < 0.1 and p[1] > 0.75
    drawn = m.handle("c").sample(rows, 50).groupBy("row_id", "c").count().collect()
    assert sum(r["count"] for r in drawn) == 100
    before = m.cpd("y").net
    m.update(df, "online_sgd", steps=1)
    assert m.cpd("y").net.steps == before.steps + 1 and not np.allclose(m.cpd("y").net.weights, before.weights)
    with pytest.raises(ValueError, match="outside its classes|RAISE"):
        try:
            m.handle("c").log_prob(rows.withColumn("c", F.lit("other"))).collect()
        except Exception as e:
            raise ValueError(str(e)) from None


def test_kernel_points_are_drawn_in_proportion(spark):
    """Half of all rows are copies of one value: about half of the points are it, in any partitioning."""
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(-1.0)).otherwise(F.col("id").cast("double")).alias("x"))
    points = [p.x for p in kernel.fit(df, "x", max_points=300).first().points]
    assert len(points) == 300 and 110 < points.count(-1.0) < 190
    assert [p.x for p in kernel.fit(df.repartition(5), "x", max_points=300).first().points] == points

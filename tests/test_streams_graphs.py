"""Streaming quantiles, sketches, and graphs against plain versions of the same."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayesloom.operators import graph, sketches
from bayesloom.streaming import quantiles


def test_markers_merge(spark):
    rng = np.random.default_rng(3)
    for q in (0.25, 0.5, 0.9):
        parts = [rng.normal(i, 1 + i, size=s) for i, s in enumerate((3000, 40, 4, 700, 1))]
        summaries = []
        for p in parts:
            m = quantiles.Markers(q)
            for x in p:
                m.add(float(x))
            summaries.append((m.n, m.heights))
        n, h = quantiles.merged(summaries, q)
        whole = np.concatenate(parts)
        assert n == len(whole) and (h[0], h[-1]) == (whole.min(), whole.max())
        assert abs((whole <= quantiles.quantile(n, h, q)).mean() - q) < 0.05
        assert h == sorted(h)
    assert quantiles.merged([(2, [3.0, 1.0]), (0, []), (1, [2.0])], 0.5) == (3, [1.0, 2.0, 3.0])
    assert quantiles.quantile(3, [1.0, 2.0, 3.0], 0.5) == 2.0 and quantiles.quantile(0, [], 0.5) is None
    n, h = quantiles.merged([(100, [5.0] * 5), (50, [5.0] * 5)], 0.5)
    assert (n, h) == (150, [5.0] * 5)


def test_table_quantiles_of_odd_rows(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", None), ("a", float("nan")), ("a", float("inf")), ("a", 2.0), ("b", None)]
    got = {r.k: (r.n, r["quantile"]) for r in quantiles.table_quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {None: (2, 2.0), "a": (1, 2.0)}
    assert quantiles.table_quantiles(spark.createDataFrame([], "k string, v double"), "k", "v").count() == 0


def test_streaming_quantiles(spark, tmp_path):
    """Five batches: state merges across them; with an expiry, keys that fall silent go by their timers."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rng = np.random.default_rng(5)
        held = {"a": [], "b": []}
        for i in range(5):
            rows = [("a", float(x)) for x in rng.exponential(2.0, 400)] + ([("b", float(i))] if i < 3 else [])
            for k, v in rows:
                held[k].append(v)
            spark.createDataFrame(rows, "k string, v double").coalesce(2).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema("k string, v double").option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        got: dict[str, tuple] = {}

        def keep(batch, _):
            for r in batch.collect():
                got[r.k] = max(got.get(r.k, (0,)), (r.n, r["quantile"]))

        q = quantiles.streaming_quantiles(stream, "k", "v", 0.5).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert got["a"][0] == 2000 and got["b"] == (3, 1.0)
        assert abs((np.array(held["a"]) <= got["a"][1]).mean() - 0.5) < 0.05
        gone: dict[str, int] = {}

        def expired(batch, _):
            gone.update({r.k: r.n for r in batch.where("expired").collect()})

        q = quantiles.streaming_quantiles(stream, "k", "v", 0.5, expiry_ms=500).writeStream.outputMode("update").foreachBatch(expired).option("checkpointLocation", str(tmp_path / "d")).trigger(processingTime="1 second").start()
        try:
            for _ in range(60):
                if sum(gone.values()) and set(gone) == {"a", "b"}:
                    break
                q.awaitTermination(1)
        finally:
            q.stop()
        assert set(gone) == {"a", "b"}
    finally:
        spark.conf.set(provider, before)


def test_sketches_of_days(spark):
    """Sketches stored by day: a new day is added without reading the others; unions and overlaps within their error."""
    df = spark.range(60_000).selectExpr("id % 30 AS d", "IF(id % 3 = 0, 'x', 'y') AS k", "IF(id % 11 = 0, NULL, id % 9000) AS v")
    one = sketches.daily(df.where("d < 20"), F.col("d"), ["k"], "v")
    two = sketches.daily(df.where("d >= 20"), F.col("d"), ["k"], "v")
    table = one.unionByName(two)
    exact = {r.k: (r.n, r.e) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("v").alias("e")).collect()}
    for r in sketches.distinct(table, ["k"]).collect():
        assert r.n == exact[r.k][0] and r.estimate == pytest.approx(exact[r.k][1], rel=4 * 1.04 / 64)
    o = sketches.overlap(table, F.col("day") < 10, F.col("day") >= 5).first()
    a, b = ({r.v for r in df.where(w).select("v").distinct().collect() if r.v is not None} for w in ("d < 10", "d >= 5"))
    assert (o["left"], o["right"], o["both"]) == (pytest.approx(len(a), rel=0.07), pytest.approx(len(b), rel=0.07), pytest.approx(len(a & b), rel=0.1))
    assert sketches.distinct(table.limit(0)).first().estimate in (0, None)


def plain_components(near):
    seen = {}
    for v in sorted(near):
        if v in seen:
            continue
        todo = deque([v])
        seen[v] = v
        while todo:
            for w in near[todo.popleft()]:
                if w not in seen:
                    seen[w] = v
                    todo.append(w)
    return seen


@pytest.mark.parametrize("seed", range(4))
def test_components_and_articulation_points(spark, seed):
    rng = random.Random(seed)
    n = 40
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range((20, 38, 45, 60)[seed])} | {(100, 101), (101, 102), (103, 103)} | {(200 + i, 201 + i) for i in range(9)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    edges = spark.createDataFrame(list(pairs), "parent long, child long")
    whole = plain_components(near)
    assert {r.node: r.component for r in graph.connected_components(edges).collect()} == whole
    cuts = set()
    for v in near:
        left = {a: bs - {v} for a, bs in near.items() if a != v}
        if len(set(plain_components(left).values())) > len(set(whole.values())) - (1 if near[v] <= {v} else 0):
            cuts.add(v)
    assert {r.node for r in graph.articulation_points(edges).collect()} == cuts


def test_graphs_without_edges(spark):
    none = spark.createDataFrame([], "parent long, child long")
    for f in (graph.connected_components, graph.articulation_points, graph.levels, graph.reachable, graph.distances, graph.betweenness):
        assert f(none).count() == 0

"""Readers, network files and streaming updates."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from bayesloom.functions import records
from bayesloom.operators import summary
from bayesloom.sources import tables
from bayesloom.streaming import updates

BIF = """network n {}
variable A { type discrete [ 2 ] { yes, no }; }
variable B { type discrete [ 2 ] { yes, no }; } // child
probability ( A ) { table 0.6, 0.4; }
probability ( B | A ) { (yes) 0.7, 0.3; default 0.2, 0.8; }
"""


def test_bif(spark):
    states, parents, _ = tables.parse_bif(BIF)
    assert states == {"A": ["yes", "no"], "B": ["yes", "no"]}
    assert parents == {"A": [], "B": ["A"]}
    got = {(r.A, r.B): r.prob for r in tables.bif_tables(spark, BIF)["B"].collect()}
    assert got[("no", "yes")] == pytest.approx(0.2)


def test_tolerant_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n\nnot json\n[1]\n{"a": 2}\n')
    schema = StructType([StructField("a", LongType()), StructField("b", StringType())])
    assert sorted(map(tuple, tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), schema).collect())) == [(1, "x"), (2, None)]
    assert tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), schema, per_file=1).count() == 1


@pytest.mark.parametrize("suffix", ["parquet", "csv", "orc", "json"])
def test_round_trip(spark, tmp_path, suffix):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    tables.write_table(df, str(tmp_path / f"t.{suffix}"))
    assert sorted((int(r.id), r.s) for r in tables.read_table(spark, str(tmp_path / f"t.{suffix}")).collect()) == [(1, "a"), (2, "b")]


def test_choose_data_file(spark):
    files = spark.createDataFrame([("data_x_n10_seed1.csv", 5), ("data_x_n20_seed1.csv", 1), ("data_x_n90_seed2.csv", 9)], "path string, modified long")
    assert tables.choose_data_file(files, 1).first()[0] == "data_x_n20_seed1.csv"
    assert tables.choose_data_file(files, 7).first()[0] == "data_x_n90_seed2.csv"


def test_streamed_counts_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    families = {"event_type": [], "user_id": ["event_type"]}
    updates.merge_batches(stream, families, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    key = lambda d: sorted((r.node, tuple(r.cells), r.n) for r in d.collect())
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.select("batch").distinct().count() == 3
    assert key(updates.merged(kept)) == key(updates.family_counts(events, families))


def test_windows_and_late_rows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = updates.windowed(stream, "ts", "1 day", "6 hours", ["event_type"], "value").writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("w")
    want = updates.windowed(events, "ts", "1 day", "6 hours", ["event_type"], "value")
    assert got.count() > 0
    assert got.select("start", "event_type", "n").exceptAll(want.select("start", "event_type", "n")).isEmpty()


def test_error_signature_and_partitions(spark):
    said = [("ValueError", "State '1_1' not found in pgmpy output for 'N6_d_g'"), ("ValueError", "Failed at step 123456"), (None, None), (None, "no node 'x7'\t at 0xAB1"), ("", " ")]
    rows = spark.createDataFrame(said, "k string, m string")
    got = [r[0] for r in rows.select(records.error_signature(F.col("k"), F.col("m"))).collect()]
    assert got == ["valueerror: state <state> not found in pgmpy output for <var>", "valueerror: failed at step <num>", "unknown", "no node <var> at <hex>", "unknown"]
    memory = [("RuntimeError", "CUDA out of memory. Tried to allocate"), ("MemoryError", None), (None, "cublas failed"), ("RuntimeError", "no room to zoom"), (None, None)]
    assert [r[0] for r in spark.createDataFrame(memory, "k string, m string").select(records.is_out_of_memory(F.col("k"), F.col("m"))).collect()] == [True, True, True, False, False]
    solved = {1: {1, 2, 3}, 2: {1, 2}, 3: {1}, 4: {2, 3}, 5: set(), 6: {1, 3}}
    df = spark.createDataFrame([(q, f"m{m}", m in s) for q, s in solved.items() for m in (1, 2, 3)], "q int, m string, ok boolean")
    rows = {r.solvers: (r.n, r.share) for r in summary.partitions(df, "q", "m", "ok").collect()}
    assert rows == {"m1|m2|m3": (1, None), "m1": (1, 0.2), "m1|m2": (1, 0.2), "m1|m3": (1, 0.2), "m2|m3": (1, 0.2)}


def test_pareto_keeps_equal_rows(spark):
    df = spark.createDataFrame([("g", 1, 5.0), ("g", 1, 5.0), ("g", 2, 5.0), ("g", 3, 4.0), ("g", 0, 9.0)], "k string, x int, y double")
    assert sorted((r.x, r.y) for r in summary.pareto(df, ["k"], "x", "y").collect()) == [(0, 9.0), (1, 5.0), (1, 5.0), (3, 4.0)]


def test_arrays_reports_and_fallback(spark, tmp_path):
    df = tables.from_arrays(spark, {"a": [2, 1], "b": [[1.0, 2.0], [3.0]]})
    assert df.count() == 2
    with pytest.raises(ValueError, match="length"):
        tables.from_arrays(spark, {"a": [1], "b": [1, 2]})
    assert tables.write_first(df, str(tmp_path / "t"), order=("csv", "parquet")).endswith(".parquet")
    tables.write_report(df.select("a", F.lit(None).cast("string").alias("c")), str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r.md")).collect()]
    assert lines == ["| a | c |", "|---|---|", "| 1 |  |", "| 2 |  |"]


def test_network_catalog_and_spec(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"asia": {"name": "Asia", "category": "small", "type": "discrete", "stats": {"nodes": 8, "arcs": 8, "parameters": 18}}, "x": {"name": "X"}}')
    got = {r.id: r for r in tables.network_catalog(spark, str(tmp_path / "n.json")).collect()}
    assert got["asia"].parameters == 18 and got["x"].nodes is None
    spec = {"A": {"states": ["a", "b"], "rows": {(): [3, 1]}}, "B": {"states": ["u", "v"], "parents": ["A"], "rows": {("a",): [1, 1]}, "default": [1, 3]}}
    parents, made = tables.spec_tables(spark, spec)
    assert parents == {"A": [], "B": ["A"]}
    assert {(r.A, r.B): r.prob for r in made["B"].collect()} == {("a", "u"): 0.5, ("a", "v"): 0.5, ("b", "u"): 0.25, ("b", "v"): 0.75}
    with pytest.raises(ValueError, match="no row"):
        tables.spec_tables(spark, {"A": {"states": ["a"], "rows": {}}})


def test_streams_meet_within_a_time(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    left, right = (x.where(f"event_id % 2 = {k}").select("user_id", F.col("ts").alias(n), F.col("event_id").alias(f"e{k}")) for k, n, x in ((0, "t0", stream), (1, "t1", stream)))
    q = updates.matched_within(left, right, "user_id", "t0", "t1", "1 day", "1 hour").select("e0", "e1").writeStream.format("memory").queryName("met").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    a, b = e.where("event_id % 2 = 0").alias("a"), e.where("event_id % 2 = 1").alias("b")
    want = a.join(b, F.expr("a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 hour")).select("a.event_id", "b.event_id")
    assert sorted(map(tuple, spark.table("met").collect())) == sorted(map(tuple, want.collect()))

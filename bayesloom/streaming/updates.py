"""Online learning: additive statistics kept by streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import kernel


def family_counts(stream: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """``node, cells, n``: running counts of every family in one aggregation (update or complete mode).

    Partial counts are combined before the shuffle; the state has a row for each cell, not for each event.
    """
    cells = [F.struct(F.lit(c).alias("node"), F.array(*[F.col(x).cast("string") for x in [*p, c]]).alias("cells")) for c, p in families.items()]
    return stream.select(F.explode(F.array(*cells)).alias("f")).groupBy("f.node", "f.cells").agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, time: str, late: str, window: str, keys: list[str], value: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window, with rows later than ``late`` dropped."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))  # event time has a zone
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("w.start", "w.end", *keys, "n", "total")


def sessions(stream: DataFrame, time: str, late: str, gap: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums of sessions: rows of a key that follow one another in less than ``gap``."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = stream.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select("w.start", "w.end", *keys, "n", "total")


def matched_within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, late: str, within: str) -> DataFrame:
    """Rows of two streams of one key whose times lie within ``within`` after the left one's; watermarks bound the state."""
    a = left.withWatermark(left_time, late).alias("a")
    b = right.withWatermark(right_time, late).alias("b")
    near = (F.col(f"b.{right_time}") >= F.col(f"a.{left_time}")) & (F.col(f"b.{right_time}") <= F.col(f"a.{left_time}") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & near)


def merge_batches(stream: DataFrame, families: dict[str, list[str]], path: str, checkpoint: str) -> StreamingQuery:
    """Counts of each micro-batch as a table of its own (``batch=<id>``): written again, not twice, after a failure.

    The model's counts are the sums over all batches (``merged``).
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        family_counts(batch, families).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(counts: DataFrame, decay: float = 0.0) -> DataFrame:
    """Sums over batches; with ``decay`` a batch weighs (1 - decay) to the power of its age."""
    if not decay:
        return counts.groupBy("node", "cells").agg(F.sum("n").alias("n"))
    newest = counts.agg(F.max("batch").alias("_last"))  # one row
    age = F.col("_last") - F.col("batch")
    return counts.crossJoin(F.broadcast(newest)).groupBy("node", "cells").agg(F.sum(F.col("n") * F.pow(F.lit(1 - decay), age)).alias("n"))


def sample_batches(stream: DataFrame, columns: list[str], path: str, checkpoint: str, max_points: int = 2000, seed: int = 0, identity: list[str] = ()) -> StreamingQuery:
    """The sample of each micro-batch as a table of its own (``batch=<id>``), written again after a failure.

    Without ``identity`` a batch's rows are labelled with its id, so that the samples of batches merge.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        named, by = (batch, list(identity)) if identity else (batch.withColumn("_label", F.lit(batch_id)), ["_label"])
        kernel.sample(named, columns, max_points, seed, by).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sampled(samples: DataFrame, max_points: int = 2000) -> DataFrame:
    """The sample of all batches' rows, from the tables of ``sample_batches``."""
    rows = samples.drop("batch")
    return rows.orderBy(*rows.columns).limit(max_points)


def deduplicated(stream: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)

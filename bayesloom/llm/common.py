"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition ``[^\x20\x09-\x0D]+``, as a Java character class.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``, or one below the warehouse where none is named.

    The warehouse is a folder that driver and executors share; a machine's own temporary folder is not.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, which survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_freed(df: DataFrame) -> DataFrame:
    """``cut``, after which the shuffle files that it took are removed at once, not when the driver happens to collect its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return cut(df.select("*"))
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def if_few(keys: DataFrame, most: int = 500_000) -> DataFrame:
    """The keys' side of a join, broadcast up to ``most`` rows (half a million take some 30 MB on the driver), so that the other side's texts stay where they lie."""
    return F.broadcast(keys) if keys.count() <= most else keys


def with_row_key(docs: DataFrame, key: str, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with a ``key`` that tells its rows apart: ``doc_id``, or a row number where ids repeat or are null.

    Row numbers are written to the checkpoint folder, so that a later reading gives the same ones.
    """
    if docs.groupBy(doc_id).count().where(F.col(doc_id).isNull() | (F.col("count") > 1)).isEmpty():
        return docs.withColumn(key, F.col(doc_id))
    return cut(docs.withColumn(key, F.monotonically_increasing_id()))


def released(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task that gives its freed memory back at its end: workers live on, and pools would keep their peaks."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return run


def uniform(*parts) -> Column:
    """A number in (0, 1) that depends on nothing but ``parts``: equal in every rerun and partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks_by_bytes(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` bytes in all; a longer text is alone."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def ceil_div(a: int, b: int) -> int:
    return max(1, math.ceil(a / b))


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty, without decoding."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]

"""Tables that are kept: cut off from the data they come from, in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there from now on; lost executors lose nothing."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """The folder for kept tables: that of ``spark.checkpoint.dir``, or one below the warehouse where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return sc.getCheckpointDir()


def compact(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A kept table of up to ``most`` rows as one partition, so that work on it needs no shuffle; larger ones as they are."""
    return df.coalesce(1) if df.count() <= most else df


def kept_together(tables: dict[str, DataFrame], most: int = 50) -> dict[str, DataFrame]:
    """Small tables written as one, ``most`` of them at a time: one job where each alone would take two.

    Columns of one name have one type in all tables.
    """
    names, out = list(tables), {}
    for at in range(0, len(names), most):
        whole = None
        for v in names[at : at + most]:
            one = tables[v].withColumn("_of", F.lit(v))
            whole = one if whole is None else whole.unionByName(one, allowMissingColumns=True)
        whole = compact(kept(whole))
        out |= {v: whole.where(F.col("_of") == v).select(*tables[v].columns) for v in names[at : at + most]}
    return out

"""Batches of queries of any signatures, and answers that are kept and asked for again.

A query is a row: ``query_id``, ``target``, and maps ``evidence`` and ``do`` from names to values written as
text. Queries of one signature (target and sorted names) share a plan; a batch has as many plans as it has
signatures, however many queries. Names with a null value are not given.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import runs
from .kept import kept
from .model import BeliefModel


def _given(column: str, queries: DataFrame) -> Column:
    none = F.create_map().cast("map<string,string>")
    return F.map_filter(F.coalesce(F.col(column), none), lambda k, v: v.isNotNull()) if column in queries.columns else none


def normalised(queries: DataFrame) -> DataFrame:
    """``query_id, target, evidence, do, signature``: maps without nulls, and the key of the plan that answers."""
    rows = queries.select("query_id", "target", _given("evidence", queries).alias("evidence"), _given("do", queries).alias("do"))
    names = lambda c: F.array_join(F.array_sort(F.map_keys(c)), ",")
    return rows.withColumn("signature", F.concat_ws("|", F.coalesce("target", F.lit("")), names("evidence"), names("do")))


def signatures(queries: DataFrame) -> DataFrame:
    """The distinct signatures of normalised queries and how many queries each has."""
    names = lambda c: F.array_sort(F.map_keys(c))
    return queries.groupBy("signature").agg(F.first("target").alias("target"), F.first(names("evidence")).alias("evidence"), F.first(names("do")).alias("do"), F.count("*").alias("n"))


def batches(queries: DataFrame, size: int, order: list[str] | None = None) -> DataFrame:
    """Normalised queries with ``run`` and ``chunk``: consecutive ones of one signature, in chunks of ``size``."""
    return runs(normalised(queries), "signature", order or ["query_id"], size)


def infer_batch(model: BeliefModel, queries: DataFrame, most: int = 1000) -> DataFrame:
    """``query_id, target, value, number, weight, weight_kind``: the answers to queries of up to ``most`` signatures.

    ``value`` is text, ``number`` its value where it is a number. Ids tell queries apart: a repeated or null one is an
    error, as are unknown names, and more signatures than ``most`` (plans, not queries).
    """
    rows = kept(normalised(queries))
    twice = rows.groupBy("query_id").count().where("count > 1 OR query_id IS NULL").limit(3).collect()
    if twice:
        raise ValueError(f"query ids do not tell queries apart: {[r.query_id for r in twice]}")
    plans = signatures(rows).orderBy("signature").limit(most + 1).collect()
    if len(plans) > most:
        raise ValueError(f"more than {most} signatures")
    out = None
    for p in plans:
        own = rows.where(F.col("signature") == p.signature)
        given = [F.element_at(c, v).cast(model.value_type(v)).alias(v) for c, vs in (("evidence", p.evidence), ("do", p["do"])) for v in vs]
        found = model.infer_posterior(own.select("query_id", *given), p.target, list(p.evidence), list(p["do"]))
        found = found.select("query_id", F.lit(p.target).alias("target"), F.col("value").cast("string").alias("value"), F.col("value").cast("string").try_cast("double").alias("number"), "weight", "weight_kind")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.select("query_id", "target", F.lit("").alias("value"), F.lit(0.0).alias("number"), F.lit(0.0).alias("weight"), F.lit("").alias("weight_kind"))
    return out


class AnswerCache:
    """Answers below a folder that driver and executors share, reused by every later call and session.

    A question is what is asked of which model by which method: the model's fingerprint, the method with its settings,
    the target, and names and values in order, numbers rounded to ``places``. A call finds its distinct
    questions, leaves out by an anti-join those already answered, answers the rest, and joins. A call's answers count
    once the list of its questions is written, after them, so that a call that died leaves nothing behind.
    """

    def __init__(self, model: BeliefModel, path: str, places: int = 12):
        self.model, self.path, self.places = model, path.rstrip("/"), places
        self.answered = 0  # questions of the last call that had to be answered

    def _key(self) -> Column:
        numbers = [v for v in self.model.net.parents if self.model.value_type(v) not in ("string", "boolean", "date", "timestamp")]

        def written(k: Column, v: Column) -> Column:
            x = F.round(v.try_cast("double"), self.places)
            return F.when(k.isin(*numbers) & x.isNotNull(), (x + 0.0).cast("string")).otherwise(v) if numbers else v

        def entries(c: str) -> Column:
            return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("k"), written(e["key"], e["value"]).alias("v"))))

        name, conf = self.model.inference
        asked = F.lit(json.dumps([self.model.fingerprint(), self.model.seed, name, conf], sort_keys=True))
        return F.sha2(F.to_json(F.struct(asked.alias("asked"), F.col("target"), entries("evidence").alias("evidence"), entries("do").alias("do"))), 256)

    def _read(self, spark, what: str, like: DataFrame) -> DataFrame:
        """What earlier calls left under ``what``; an empty table of the form of ``like`` where there is nothing yet."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return like.limit(0).withColumn("call", F.lit(""))
        return spark.read.schema(like.withColumn("call", F.lit("")).schema).parquet(f"{self.path}/{what}")

    def ask(self, queries: DataFrame) -> DataFrame:
        """The answers of ``infer_batch``; ids may repeat here, for a question is known by what it asks."""
        spark = queries.sparkSession
        rows = kept(normalised(queries).withColumn("_key", self._key()))
        questions = rows.groupBy("_key").agg(*[F.first(c).alias(c) for c in ("target", "evidence", "do")])
        known = self._read(spark, "questions", questions.select("_key"))
        new = kept(questions.join(known, "_key", "left_anti"))
        self.answered = new.count()
        form = "_key string, target string, value string, number double, weight double, weight_kind string"
        if self.answered:
            call = uuid.uuid4().hex
            found = infer_batch(self.model, new.select(F.col("_key").alias("query_id"), "target", "evidence", "do")).withColumnRenamed("query_id", "_key")
            found.write.parquet(f"{self.path}/answers/call={call}")
            new.select("_key").write.parquet(f"{self.path}/questions/call={call}")
        like = spark.createDataFrame([], form)
        known = self._read(spark, "questions", like.select("_key"))
        answers = self._read(spark, "answers", like).join(known, ["_key", "call"]).drop("call", "target")
        return rows.select("query_id", "target", "_key").join(answers, "_key").drop("_key")


def ground_truth(model: BeliefModel, queries: DataFrame, domain: DataFrame) -> DataFrame:
    """``query_id, target, probs, reason``: exact answers as arrays in the order of the target's state codes.

    ``domain`` has ``node, state, code``. A state that an answer lacks has probability 0. A query whose target, or a piece of whose
    evidence, the domain does not have, or whose evidence is impossible, has null ``probs`` and a ``reason``.
    """
    rows = kept(normalised(queries))
    known = domain.select(F.col("node").alias("_n"), F.col("state").alias("_s"))
    given = rows.select("query_id", F.explode(F.map_entries("evidence")).alias("e")).select("query_id", F.col("e.key").alias("_n"), F.col("e.value").alias("_s"))
    odd = given.join(known, ["_n", "_s"], "left_anti").select("query_id").distinct().withColumn("_odd", F.lit("evidence outside the domain"))
    targets = domain.select(F.col("node").alias("target")).distinct().withColumn("_there", F.lit(True))
    marked = kept(rows.join(odd, "query_id", "left").join(targets, "target", "left").withColumn("reason", F.when(F.col("_there").isNull(), "target outside the domain").otherwise(F.col("_odd"))))
    before = model.inference
    try:
        model.set_inference_method("variable_elimination")
        answers = infer_batch(model, marked.where("reason IS NULL").select("query_id", "target", "evidence", "do"))
    finally:
        model.inference = before
    cells = marked.where("reason IS NULL").select("query_id", "target").join(domain.select(F.col("node").alias("target"), F.col("state").alias("value"), "code"), "target")
    full = cells.join(answers.select("query_id", "value", "weight"), ["query_id", "value"], "left").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", F.coalesce("weight", F.lit(0.0)).alias("w")))), lambda x: x["w"]).alias("probs"), F.count("weight").alias("_some"))
    out = marked.select("query_id", "target", "reason").join(full, "query_id", "left")
    impossible = F.col("reason").isNull() & (F.coalesce("_some", F.lit(0)) == 0)
    return out.select("query_id", "target", F.when(~impossible, F.col("probs")).alias("probs"), F.when(impossible, "impossible evidence").otherwise(F.col("reason")).alias("reason"))

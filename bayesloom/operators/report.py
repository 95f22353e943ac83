"""Report tables over benchmark records: times, batching, lines over bins, errors with examples, workloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.kept import kept
from . import graph, ordered
from .summary import latest


def trimmed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``n, iqm, spread`` per group: the mean of the ranks floor(n/4) to ceil(3n/4), and the quartiles' distance over 1.349."""
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    inside = (F.col("_i") >= F.floor(0.25 * F.col("_n"))) & (F.col("_i") < F.ceil(0.75 * F.col("_n")))
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.when(inside, F.col(value))).alias("iqm"), ((F.get(q, F.lit(1)) - F.get(q, F.lit(0))) / 1.349).alias("spread"))


def two_stage(df: DataFrame, keys: list[str], dataset: str, value: str) -> DataFrame:
    """Medians of each dataset, summarised over datasets: ``dataset_n, n, mean, std, median``."""
    centres = df.groupBy(*keys, dataset).agg(F.median(value).alias("_c"), F.count(value).alias("_n")).where("_c is not null")
    return centres.groupBy(*keys).agg(F.count_distinct(dataset).alias("dataset_n"), F.sum("_n").alias("n"), F.avg("_c").alias("mean"), F.stddev_pop("_c").alias("std"), F.median("_c").alias("median"))


def times(df: DataFrame, keys: list[str], ms: str) -> DataFrame:
    """Queries, timed ones, milliseconds in all, and per query (of all, timed or not)."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n_queries"), F.count(ms).alias("n_timed"), F.coalesce(F.sum(ms), F.lit(0.0)).alias("sum_ms"))
    return out.withColumn("ms_per_query", F.when(F.col("n_timed") > 0, F.col("sum_ms") / F.col("n_queries")))


def batching(df: DataFrame, keys: list[str], size: str, ms: str) -> DataFrame:
    """Share of batched queries (size over 1), mean batch, and queries a second over the timed ones."""
    batched = F.col(size) > 1
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.coalesce(batched, F.lit(False)).cast("int")).alias("fraction_batched"), F.avg(size).alias("avg_batch"), F.count(ms).alias("_t"), F.sum(ms).alias("_ms"))
    return out.withColumn("throughput_qps", F.when(F.col("_ms") > 0, 1000 * F.col("_t") / F.col("_ms"))).drop("_t", "_ms")


def binned_line(df: DataFrame, keys: list[str], x: str, bins: int = 4) -> DataFrame:
    """``df`` with ``left, right, mid`` of the quantile bin of ``x``, right-closed, the lowest value in the first; rows without ``x`` go."""
    cuts = F.broadcast(ordered.percentiles(df, x, [i / bins for i in range(bins + 1)]).select(F.array_distinct("values").alias("_e")))  # one row
    rows = df.where(F.col(x).isNotNull()).crossJoin(cuts).where(F.size("_e") >= 2)
    at = F.greatest(F.size(F.filter("_e", lambda e: e < F.col(x))), F.lit(1))
    rows = rows.withColumn("left", F.element_at("_e", at)).withColumn("right", F.element_at("_e", at + 1))
    return rows.withColumn("mid", (F.col("left") + F.col("right")) / 2).drop("_e")


def with_examples(df: DataFrame, keys: list[str], signature: str, message: str, order: str) -> DataFrame:
    """Counts of signatures, their share within ``keys``, and the first message there is by ``order``."""
    first = F.min_by(message, F.when(F.col(message).isNotNull(), F.col(order)))
    out = df.groupBy(*keys, signature).agg(F.count("*").alias("n"), first.alias("example"))
    total = F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy())
    return out.withColumn("share", F.col("n") / total)


def counters(df: DataFrame, kinds: list[str], by: list[str]) -> DataFrame:
    """``scope, scope_value, counter, value, n``: counts of each kind's values over all rows and by each of ``by``, from one scan."""
    item = F.explode(F.array(*[F.struct(F.lit(k).alias("counter"), F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias("value")) for k in kinds])).alias("c")
    scopes = [F.struct(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("scope_value"))]
    scopes += [F.struct(F.lit(b).alias("scope"), F.coalesce(F.col(b).cast("string"), F.lit("unknown")).alias("scope_value")) for b in by]
    rows = df.select(item, F.array(*scopes).alias("_s")).select("c.*", F.explode("_s").alias("s")).select("s.*", "counter", "value")
    return rows.groupBy("scope", "scope_value", "counter", "value").agg(F.count("*").alias("n"))


def matched(predictions: DataFrame, truth: DataFrame, keys: list[str], order: str, prediction: str, answer: str) -> DataFrame:
    """Predictions with their ground truth by all of ``keys`` (null equals null); the last of repeated truths wins, pmfs of other lengths go."""
    last = latest(truth, keys, F.col(order)).drop(order)
    renamed = last.select(*[F.col(k).alias(f"_t_{k}") for k in keys], answer)
    same = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    rows = predictions.join(renamed, same).drop(*[f"_t_{k}" for k in keys])
    return rows.where(F.size(prediction) == F.size(answer))


def coverage(asked: DataFrame, possible: DataFrame, column: str) -> DataFrame:
    """One row: distinct values asked for, those possible, and the share of the possible that was asked."""
    asked, possible = asked.select(column).dropna().distinct(), possible.select(column).dropna().distinct()
    both = possible.join(asked.withColumn("_hit", F.lit(1)), column, "left")
    return both.agg(F.count("_hit").alias("covered"), F.count("*").alias("possible"), (F.count("_hit") / F.count("*")).alias("coverage"))


def workload(df: DataFrame, by: list[str]) -> DataFrame:
    """Totals over all rows and by each of ``by`` alone."""
    return df.groupingSets([[], *[[b] for b in by]], *by).agg(F.count("*").alias("n"))


def partition_sets(attempts: DataFrame, query: str, method: str, ok: str) -> DataFrame:
    """``partition, query``: all queries, those that every method solved, and each set of solvers'; ``shown`` are the methods to report."""
    solved = attempts.groupBy(query, method).agg(F.max(F.coalesce(ok, F.lit(False))).alias("_ok"))
    everyone = F.broadcast(attempts.select(F.array_sort(F.collect_set(method)).alias("_all")))  # one row: the methods
    sets = solved.groupBy(query).agg(F.array_sort(F.collect_set(F.when(F.col("_ok"), F.col(method)))).alias("_s")).crossJoin(everyone)
    common = F.col("_s") == F.col("_all")
    own = F.when(common, F.struct(F.lit("common").alias("partition"), F.col("_all").alias("shown"))).when(F.size("_s") > 0, F.struct(F.concat(F.lit("subset_"), F.array_join("_s", "|")).alias("partition"), F.col("_s").alias("shown")))
    both = F.filter(F.array(F.struct(F.lit("all").alias("partition"), F.col("_all").alias("shown")), own), lambda x: x.isNotNull())
    return sets.select(query, F.explode(both).alias("p")).select(query, "p.*")


def failures(queries: DataFrame, stage: str, kind: str, message: str) -> DataFrame:
    """A failed record for each query of a run that did not come so far as to answer."""
    return queries.select("*", F.lit(False).alias("ok"), F.lit(stage).alias("error_stage"), F.lit(kind).alias("error_type"), F.lit(message).alias("error_msg"))


def evaluation_cost(nodes: Column, parents: Column) -> Column:
    """Sum of 1 + min(parents, i) over the nodes i = 0..nodes-1: what evaluating a network once is thought to cost."""
    p = F.least(parents, nodes - 1)  # nodes from p on have p parents
    return nodes + F.floor(p * (p - 1) / 2) + p * (nodes - p)


def wasserstein_of_samples(df: DataFrame, side: str, value: str) -> DataFrame:
    """One row ``w1``: the area between the distribution functions of the samples of side 0 and 1, of equal or different sizes.

    Values are ordered in range partitions; only each partition's mass and first value go on to the next.
    """
    sizes = df.agg(F.count_if(F.col(side) == 0).alias("_a"), F.count_if(F.col(side) == 1).alias("_b"))
    mass = F.sum(F.when(F.col(side) == 0, 1 / F.col("_a")).otherwise(-1 / F.col("_b")))
    steps = df.crossJoin(F.broadcast(sizes)).groupBy(F.col(value).alias("x")).agg(mass.alias("m"))  # one row of sizes
    parts = steps.repartitionByRange("x").withColumn("part", F.spark_partition_id()).cache()
    before = parts.groupBy("part").agg(F.sum("m").alias("m"), F.min("x").alias("first"))
    onward = Window.orderBy("part")  # one row for each partition
    before = before.select("part", F.coalesce(F.sum("m").over(onward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("gap"), F.lead("first").over(onward).alias("next"))
    own = Window.partitionBy("part").orderBy("x")
    rows = parts.join(F.broadcast(before), "part")  # one row for each partition
    gap = F.col("gap") + F.sum("m").over(own)
    step = F.coalesce(F.lead("x").over(own), F.col("next")) - F.col("x")
    return rows.select((F.abs(gap) * step).alias("_w")).agg(F.sum("_w").alias("w1"))


def jsd_of_samples(df: DataFrame, side: str, value: str, bins: int = 64, eps: float = 1e-12) -> DataFrame:
    """One row ``jsd``: Jensen-Shannon divergence of two samples' histograms over their common range; 0 for a range of one value."""
    span = F.broadcast(df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))  # one row
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1)).cast("int")
    seen = df.crossJoin(span).groupBy(F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(seen, "bin", "left").na.fill(0)
    everyone = Window.partitionBy()  # as many rows as bins
    shares = every.select(*[(F.col(c) / F.sum(c).over(everyone) + eps).alias(c) for c in "ab"])
    p = shares.select(*[(F.col(c) / F.sum(c).over(everyone)).alias(c) for c in "ab"])
    m = (F.col("a") + F.col("b")) / 2
    return p.agg(F.sum(0.5 * F.col("a") * F.ln(F.col("a") / m) + 0.5 * F.col("b") * F.ln(F.col("b") / m)).alias("jsd"))


def ranges(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``low, high`` (1 % and 99 % quantiles, one to each side of a single value), ``mean``, ``std``."""
    q = F.percentile(value, F.array(F.lit(0.01), F.lit(0.99)))
    out = df.groupBy(*keys).agg(q.alias("_q"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    lo, hi = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    return out.select(*keys, F.when(lo == hi, lo - 1).otherwise(lo).alias("low"), F.when(lo == hi, hi + 1).otherwise(hi).alias("high"), "mean", "std")


def distinct_rows(df: DataFrame, columns: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` of the distinct rows over ``columns``, chosen by hash, without replacement."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))
    return df.select(*columns).distinct().orderBy(key, *columns).limit(n)


def workload_coverage(edges: DataFrame, table_targets: DataFrame, asked_targets: DataFrame, centrality: DataFrame, groups: dict[str, DataFrame]) -> DataFrame:
    """One row: how much of a network a workload of queries reaches.

    Of the targets of table queries: the share of nodes (``target_coverage``), of nodes that are their parents
    (``parent_coverage``), their mean blanket size over that of all nodes (``blanket_ratio``), and the share of all pairs of a node and
    a blanket member that has one of them (``pair_coverage``). Of the targets of inference queries: the share of nodes
    (``asked_coverage``), of hubs (nodes whose ``betweenness`` is at least the median), and of each of ``groups``. Shares of nothing are 0.
    """
    node = lambda df, c: df.select(F.col(c).alias("node"))
    nodes = kept(node(edges, "parent").union(node(edges, "child")).distinct())
    pairs = kept(graph.markov_blanket(edges))
    n = nodes.count()
    targets, asked = (kept(nodes.join(node(t, "node").distinct(), "node")) for t in (table_targets, asked_targets))
    half = kept(centrality.join(nodes, "node", "right").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("b")))
    median = ordered.percentiles(half, "b", [0.5]).first()[0]
    hubs = half.where(F.col("b") >= F.lit(median[0] if median else 0.0)).select("node")
    unordered = lambda p: p.select(F.least("node", "member").alias("a"), F.greatest("node", "member").alias("b")).distinct()

    def part(have: DataFrame, of: DataFrame) -> float:
        size = of.distinct().count()
        return have.join(of.distinct(), "node", "left_semi").distinct().count() / size if size else 0.0

    of_targets = pairs.join(targets, "node", "left_semi")
    mean = lambda p, k: p.count() / k if k else 0.0
    whole, mine = mean(pairs, n), mean(of_targets, targets.count())
    all_pairs = unordered(pairs).count()
    said = {
        "target_coverage": targets.count() / max(n, 1),
        "parent_coverage": edges.join(targets.withColumnRenamed("node", "child"), "child", "left_semi").select("parent").distinct().count() / max(n, 1),
        "blanket_ratio": mine / whole if whole else 0.0,
        "pair_coverage": unordered(of_targets).count() / all_pairs if all_pairs else 0.0,
        "asked_coverage": asked.count() / max(n, 1),
        "hub_coverage": part(asked, hubs),
        **{f"{name}_coverage": part(asked, g) for name, g in groups.items()},
    }
    return edges.sparkSession.range(1).select(*[F.lit(float(v)).alias(k) for k, v in said.items()])

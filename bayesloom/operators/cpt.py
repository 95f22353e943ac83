"""Conditional probability tables as long tables: parents, child value, count, probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..plans.kept import compact, kept


def support(df: DataFrame, column: str, declared: int | None = None) -> DataFrame:
    """Values of a discrete column: 0..declared-1, or what occurs."""
    if declared is not None:
        return df.sparkSession.range(declared).select(F.col("id").cast(df.schema[column].dataType).alias(column))
    return df.where(F.col(column).isNotNull()).select(column).distinct()


def fit_cpt(df: DataFrame, child: str, parents: list[str], alpha: float = 1.0, smoothing: str = "total_mass", prior: str = "global", cards: dict[str, int] | None = None, ess: float = 10.0, weight: str | None = None) -> DataFrame:
    """``parents..., child, n, prob`` on the full grid of supports.

    ``smoothing``: ``total_mass`` adds alpha times the prior to each parent row, ``per_class``
    alpha times the number of values times the prior, ``mle`` nothing, ``bdeu`` an equivalent
    sample size over all cells. ``prior``: ``uniform``, or ``global``, the child's marginal.
    ``weight`` names a column of counts, if rows stand for several. Rows with a null in the family are left out. Data are read once, aggregated map-side; the
    grid has the size of the table itself.
    """
    family = [*parents, child]
    n = F.sum(weight) if weight else F.count("*")
    counts = df.dropna(subset=family).groupBy(*family).agg(n.alias("n"))
    cards = cards or {}
    spark = df.sparkSession

    def values(c: str) -> DataFrame:
        return spark.range(cards[c]).select(F.col("id").cast(df.schema[c].dataType).alias(c)) if c in cards else counts.select(c).distinct()

    marginal = values(child).join(counts.groupBy(child).agg(F.sum("n").alias("_m")), child, "left").select(child, F.coalesce("_m", F.lit(0)).alias("_m"))
    k = F.count("*").over(Window.partitionBy())
    share = F.coalesce(F.col("_m") / F.nullif(F.sum("_m").over(Window.partitionBy()), F.lit(0)), 1 / k) if prior == "global" else 1 / k
    grid = marginal.select(child, share.alias("_prior"), k.alias("_k"))
    cells = F.lit(1.0)
    for p in parents:
        grid = values(p).select(p, F.count("*").over(Window.partitionBy()).alias(f"_k_{p}")).crossJoin(grid)
        cells = cells * F.col(f"_k_{p}")
    mass = {"total_mass": alpha * F.col("_prior"), "per_class": alpha * F.col("_k") * F.col("_prior"), "mle": F.lit(0.0), "bdeu": ess / (F.col("_k") * cells)}[smoothing]
    full = grid.join(counts.withColumnRenamed("n", "_n"), family, "left").select(*family, F.coalesce("_n", F.lit(0)).alias("n"), mass.alias("_mass"), (1 / F.col("_k")).alias("_flat"))
    row = Window.partitionBy(*parents) if parents else Window.partitionBy()
    total = F.sum("n").over(row) + F.sum("_mass").over(row)
    return full.select(*family, "n", F.when(total > 0, (F.col("n") + F.col("_mass")) / total).otherwise(F.col("_flat")).alias("prob"))


def fit_all(df: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """Counts of every family in one scan by grouping sets: ``node``, a map of the family's values, ``n``."""
    sets = [[*p, c] for c, p in families.items()]
    columns = list(dict.fromkeys(c for s in sets for c in s))
    keys = ", ".join(f"`{c}`" for c in columns)
    groups = ", ".join("(" + ", ".join(f"`{c}`" for c in s) + ")" for s in sets)
    rows = df.sparkSession.sql(f"SELECT {keys}, grouping_id() AS g, count(*) AS n FROM {{df}} GROUP BY GROUPING SETS ({groups})", df=df.select(*columns))
    out = None
    for child, parents in families.items():
        own = {*parents, child}
        gid = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in own)
        cells = F.map_from_arrays(F.array(*[F.lit(c) for c in sorted(own)]), F.array(*[F.col(c).cast("string") for c in sorted(own)]))
        one = rows.where(F.col("g") == gid).select(F.lit(child).alias("node"), cells.alias("cells"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def count_families(df: DataFrame, families: dict[str, list[str]]) -> dict[str, DataFrame]:
    """``parents..., child, n`` for each family, all from one scan by grouping sets, whose result is kept.

    Each family leaves out the rows that have a null in it, and only those.
    """
    if not families:
        return {}
    sets = [[*p, c] for c, p in families.items()]
    columns = list(dict.fromkeys(c for s in sets for c in s))
    rows = compact(kept(df.select(*columns).groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"))))
    out = {}
    for child, parents in families.items():
        own = {*parents, child}
        gid = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in own)
        out[child] = rows.where(F.col("_g") == gid).select(*parents, child, "n").dropna(subset=[*parents, child])
    return out


def lookup(queries: DataFrame, cpt: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """Exact posterior of the child given all its parents: the matching rows of the table for each query."""
    return queries.join(cpt.select(*parents, child, "prob"), parents) if parents else queries.crossJoin(cpt.select(child, "prob"))


def log_prob(rows: DataFrame, cpt: DataFrame, child: str, parents: list[str], eps: float = 1e-12) -> DataFrame:
    """``rows`` with ``log_prob``; a value or parent row that the table lacks raises an error."""
    joined = rows.join(cpt.select(*parents, child, F.col("prob").alias("_p")), [*parents, child], "left")
    known = F.when(F.col("_p").isNull(), F.raise_error(F.lit(f"value of {child} outside its support"))).otherwise(F.ln(F.greatest("_p", F.lit(eps))))
    return joined.withColumn("log_prob", known.cast("double")).drop("_p")


def inverse_cdf(cpt: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """One row for each parent row, with sorted values and their cumulative probabilities."""
    item = F.struct(F.col(child).alias("v"), F.col("prob").alias("p"))
    rows = cpt.groupBy(*parents).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("c"))
    cdf = F.aggregate("_items", start, lambda a, x: F.struct((a["s"] + x["p"]).alias("s"), F.concat(a["c"], F.array(a["s"] + x["p"])).alias("c")), lambda a: a["c"])
    return rows.select(*parents, F.transform("_items", lambda x: x["v"]).alias(f"_v_{child}"), cdf.alias(f"_c_{child}"))


def draw(rows: DataFrame, cpt: DataFrame, child: str, parents: list[str], *key: Column | str | int) -> DataFrame:
    """``rows`` with a drawn ``child``: the first value whose cumulative probability exceeds a hashed uniform."""
    table = inverse_cdf(cpt, child, parents)
    joined = rows.join(table, parents) if parents else rows.crossJoin(table)
    u = uniform(*key, F.lit(child))
    at = F.least(F.size(F.filter(f"_c_{child}", lambda c: c <= F.col("_u"))), F.size(f"_c_{child}") - 1)
    return joined.withColumn("_u", u).withColumn(child, F.get(f"_v_{child}", at)).drop("_u", f"_v_{child}", f"_c_{child}")

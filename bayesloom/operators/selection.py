"""Selection of diverse candidates and allocation of targets to categories, for many problems at once.

A round works on the whole frame of (problem, candidate) rows: every problem chooses one candidate, and each candidate's least
distance to those chosen, a column of its own, is brought up to date by one join with the choices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..plans.kept import kept
from .summary import jaccard_distance


def diverse(candidates: DataFrame, problem: str, candidate: str, context: str, take: DataFrame, seed: int = 0) -> DataFrame:
    """``problem, candidate, place, least, filled``: up to ``take`` candidates of each problem, far from one another.

    Candidates are looked at once, in the order of a hash. The first is chosen, and after it each whose least Jaccard distance
    of contexts (arrays, taken as sets) to those chosen is no less than the mean of such distances at earlier choices. Places
    left are filled with those passed over, in the same order. ``take`` has a row for each problem: ``problem, take``;
    problems without one, or with none or a null, choose nothing. Rows of one problem and candidate count once.
    """
    u = uniform(F.lit(seed), problem, candidate)
    rows = candidates.where(F.col(problem).isNotNull() & F.col(candidate).isNotNull()).groupBy(problem, candidate).agg(F.first(context).alias("_ctx"))
    rows = rows.join(take.select(problem, F.col("take").cast("long").alias("_take")).where("_take > 0"), problem)
    at = F.struct(u.alias("u"), F.col(candidate).alias("c"))
    rows = kept(rows.select(problem, candidate, "_ctx", "_take", at.alias("_at"), F.lit(None).cast("double").alias("_least"), F.lit(None).cast("long").alias("_place"), F.lit(False).alias("_over")))
    means = None  # problem, number and sum of the distances at choices, number chosen
    while True:
        open_ = rows.where("_place IS NULL AND NOT _over")
        if means is not None:
            open_ = open_.join(means, problem).where("_n < _take AND _least >= coalesce(_sum / nullif(_n - 1, 0), 0D)")
        best = open_.groupBy(problem).agg(F.min(F.struct("_at", "_ctx", F.coalesce("_least", F.lit(0.0)).alias("d"))).alias("_b"))
        best = kept(best.select(problem, F.col("_b._at").alias("_chosen"), F.col("_b._ctx").alias("_chosen_ctx"), F.col("_b.d").alias("_d")))
        if best.isEmpty():
            break
        if means is None:
            means = kept(best.select(problem, F.lit(1).cast("long").alias("_n"), F.lit(0.0).alias("_sum")))
        else:
            means = kept(means.join(best.select(problem, "_d"), problem, "left").select(problem, (F.col("_n") + F.col("_d").isNotNull().cast("long")).alias("_n"), (F.col("_sum") + F.coalesce("_d", F.lit(0.0))).alias("_sum")))
        both = rows.join(best, problem, "left").join(means.select(problem, "_n"), problem, "left")
        mine = F.coalesce(F.col("_at") == F.col("_chosen"), F.lit(False))
        far = jaccard_distance(F.col("_ctx"), F.col("_chosen_ctx"))
        least = F.when(F.col("_place").isNull() & F.col("_chosen").isNotNull() & ~mine, F.least("_least", far)).when(mine, F.coalesce("_least", F.lit(0.0))).otherwise(F.col("_least"))
        over = F.col("_over") | F.coalesce(F.col("_place").isNull() & (F.col("_at") < F.col("_chosen")), F.lit(False))
        rows = kept(both.select(problem, candidate, "_ctx", "_take", "_at", least.alias("_least"), F.coalesce("_place", F.when(mine, F.col("_n"))).alias("_place"), over.alias("_over")))
    chosen = rows.where("_place IS NOT NULL")
    counts = chosen.groupBy(problem).agg(F.count("*").alias("_had"))
    rest = rows.where("_place IS NULL").join(counts, problem, "left").withColumn("_r", F.row_number().over(Window.partitionBy(problem).orderBy("_at")))
    filled = rest.where("_r <= _take - coalesce(_had, 0)").select(problem, candidate, (F.coalesce("_had", F.lit(0)) + F.col("_r")).alias("place"), F.col("_least").alias("least"), F.lit(True).alias("filled"))
    return chosen.select(problem, candidate, F.col("_place").alias("place"), F.col("_least").alias("least"), F.lit(False).alias("filled")).unionByName(filled)


def allocate(budgets: DataFrame, candidates: DataFrame, categories: list[str], problem: str, category: str, candidate: str, context: str, diverse_category: str | None = None, seed: int = 0) -> DataFrame:
    """``problem, candidate, category``: each problem's targets, a candidate at most once, category after category.

    ``budgets`` are rows of ``problem, category, n``. A category takes its first candidates by name that no earlier one took, the
    ``diverse_category`` by ``diverse``; what it lacks is added to the next one's budget, and after the last one taken from
    what is left of the diverse category, under the last category's name.
    """
    key = [problem, candidate]
    known = kept(candidates.select(problem, category, candidate, context).dropDuplicates([problem, category, candidate]))
    want = kept(budgets.groupBy(problem).pivot(category, categories).agg(F.sum("n")).na.fill(0, categories).withColumn("_spill", F.lit(0).cast("long")))
    taken = None
    for last, name in [*[(False, c) for c in categories], *([(True, diverse_category)] if diverse_category else [])]:
        pool = known.where(F.col(category) == name)
        pool = pool if taken is None else pool.join(taken.select(*key), key, "left_anti")
        wanted = F.col("_spill") if last else F.col(f"`{name}`") + F.col("_spill")
        take = kept(want.select(problem, wanted.cast("long").alias("take")))
        if name == diverse_category:
            got = diverse(pool, problem, candidate, context, take, seed).select(*key)
        else:
            place = F.row_number().over(Window.partitionBy(problem).orderBy(candidate))
            got = pool.select(*key).join(take, problem).withColumn("_r", place).where("_r <= take").select(*key)
        got = kept(got.withColumn(category, F.lit(categories[-1] if last else name)))
        short = take.join(got.groupBy(problem).agg(F.count("*").alias("_c")), problem, "left").select(problem, (F.col("take") - F.coalesce("_c", F.lit(0))).alias("_s"))
        want = kept(want.join(short, problem).withColumn("_spill", F.greatest("_s", F.lit(0)).cast("long")).drop("_s"))
        taken = got if taken is None else kept(taken.unionByName(got))
    return taken


def allocate_exact(budgets: DataFrame, candidates: DataFrame, problem: str, category: str, candidate: str, fallback: str | None = None, seed: int = 0) -> DataFrame:
    """``problem, category, item, candidate``: exactly ``n`` targets of each budget, a category's candidates in a hashed order, over and over.

    A category without candidates takes those of the ``fallback`` category, or else of all. A problem with a budget and no candidates is an error.
    """
    known = candidates.select(problem, category, candidate).distinct()
    asked = budgets.select(problem, category, F.col("n").cast("long").alias("n")).where("n > 0")
    rest = known.where(F.col(category) == fallback).select(problem, candidate).distinct() if fallback else known.select(problem, candidate).distinct()
    rest = rest.unionByName(known.join(rest.select(problem).distinct(), problem, "left_anti").select(problem, candidate).distinct())
    own = asked.join(known, [problem, category])
    lent = asked.join(known.select(problem, category).distinct(), [problem, category], "left_anti").join(rest, problem, "left")
    w = Window.partitionBy(problem, category)
    ranked = own.unionByName(lent).withColumn("_r", F.row_number().over(w.orderBy(uniform(F.lit(seed), problem, category, candidate), candidate)) - 1).withColumn("_k", F.count(candidate).over(w))
    times = F.when(F.col("_k") == 0, F.raise_error(F.lit("there are no candidates")).cast("long")).otherwise(F.floor((F.col("n") - 1 - F.col("_r")) / F.greatest("_k", F.lit(1))))
    some = ranked.withColumn("_t", times).where("_t >= 0")
    return some.select(problem, category, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), "_t"), lambda i: i * F.col("_k") + F.col("_r"))).alias("item"), candidate)

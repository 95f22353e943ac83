"""Mixing of sources to target weights by pivotal dependent rounding.

A source's rate is its target over its size. A document is copied floor(rate) times and once
more with the fractional probability; pivotal rounding makes those probabilities 0 or 1 in
pairs, so that a source's total hardly moves. Documents of about equal size in one source meet
in small chunks, where a pair exchanges *words*: the one gains what the other loses, until one
copy is integral. What is left fractional, at most one document of each chunk, meets the
left-overs of other chunks one level higher: a reduction tree whose groups have a bounded size.
At the root the left-overs of a source's size classes meet from large to small. Random choices
are hashes of the documents, so reruns agree, whatever the partitioning. Rows of one id, source
and size cannot be told apart: of ``n`` such rows ``floor(n * p)`` get their copy by arithmetic,
and one of them stands in the rounding for what is left, so that no chunk grows with them.

Cases: null or empty text has size 0 and is taken 0 times; a null source is a source of its own
(the last in order); rows that repeat a ``doc_id``, or have none, each count; a source without
words has target 0; an empty table gives no rows. Other columns are ignored. One row for each
source is sorted in a single task to rank sources and to share out their targets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, partitions, uniform

#: Rows in a chunk (on average), and chunks that meet one level higher.
CHUNK, FAN_IN = 48, 48
#: Copies of one row that a task repeats at once.
PART = 4096
#: Tables of up to so many rows (sources, size classes of sources) are broadcast; larger ones are joined.
BROADCAST_ROWS = 50_000
TINY = 1e-9


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size, target``: weights by rank of the source, water-filled below ``cap`` times its size."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    ranked = totals.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    caps = ranked.select("source", "source_size", "place", weight.alias("w"), (F.col("source_size") * F.lit(float(cap))).alias("most"))
    # sources reach their cap in the order of cap over weight
    by_cap = Window.orderBy(F.col("most") / F.col("w"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everyone) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    levels = caps.withColumn("level", level).withColumn("at", F.row_number().over(by_cap))
    fits = F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct("at", "level"))
    chosen = levels.withColumn("chosen", F.min(fits).over(everyone).getField("level"))
    target = F.least(F.col("most"), F.coalesce(F.col("chosen") * F.col("w"), F.col("most")))
    return chosen.select("source", "source_size", target.cast("double").alias("target"))


def _checked(small: DataFrame) -> DataFrame:
    """The side of a join, broadcast only if its counted rows are few."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _pivot(level: int, by_words: bool) -> Column:
    """Sequential pivotal rounding of the array ``units`` (struct doc_id, size, p, ...), as an array of the same structs.

    ``p`` becomes 0 or 1 for all but at most one, which has ``open`` true.
    """
    item = "struct<size:bigint,doc_id:bigint,p:double,base:bigint,class:int,open:boolean>"
    start = F.struct(F.lit(None).cast(item).alias("a"), F.array().cast(f"array<{item}>").alias("done"))

    def snap(p: Column) -> Column:
        return F.when(p < TINY, F.lit(0.0)).when(p > 1 - TINY, F.lit(1.0)).otherwise(p)

    def put(x: Column, p: Column, open_: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), p.alias("p"), x["base"].alias("base"), x["class"].alias("class"), open_.alias("open"))

    def meet(acc: Column, x: Column) -> Column:
        a, done = acc["a"], acc["done"]
        wa, wx = (a["size"].cast("double"), x["size"].cast("double")) if by_words else (F.lit(1.0), F.lit(1.0))
        up = F.least((1 - a["p"]) * wa, x["p"] * wx)
        down = F.least(a["p"] * wa, (1 - x["p"]) * wx)
        rise = uniform(F.lit(level), a["doc_id"], x["doc_id"], a["size"], x["size"]) * (up + down) < down
        moved = F.when(rise, up).otherwise(-down)
        pa, px = snap(a["p"] + moved / wa), snap(x["p"] - moved / wx)
        a_open, x_open = (pa > 0) & (pa < 1), (px > 0) & (px < 1)
        first, second = put(a, pa, F.lit(False)), put(x, px, F.lit(False))
        still = F.when(a_open, put(a, pa, F.lit(True))).when(x_open, put(x, px, F.lit(True)))
        # of a pair that stays open on both sides by rounding errors, the second is settled
        closed = F.when(a_open & x_open, F.array(put(x, F.round(px), F.lit(False)))).when(a_open, F.array(second)).when(x_open, F.array(first)).otherwise(F.array(first, second))
        return F.when(a.isNull(), F.struct(put(x, x["p"], F.lit(True)).alias("a"), done.alias("done"))).otherwise(F.struct(still.alias("a"), F.concat(done, closed).alias("done")))

    return F.aggregate("units", start, meet, lambda acc: F.when(acc["a"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["a"]))))


def _round_level(rows: DataFrame, keys: list[str], level: int, by_words: bool, large_first: bool = False) -> DataFrame:
    unit = F.struct("size", "doc_id", "p", "base", "class", F.lit(True).alias("open"))
    units = F.sort_array(F.collect_list(unit), asc=not large_first)
    out = rows.groupBy(*keys).agg(units.alias("units")).select(*keys, F.explode(_pivot(level, by_words)).alias("u"))
    return out.select(*keys, "u.*")


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row ``n`` times; many at once are dealt out in parts first."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PART).cast("long"))).alias("part")
    few, many = rows.where(F.col("n").between(1, PART)), rows.where(F.col("n") > PART)
    dealt = many.select("*", part).repartition(partitions(rows.sparkSession), "part", "doc_id", "size")
    dealt = dealt.withColumn("n", F.least(F.lit(PART).cast("long"), F.col("n") - F.col("part") * PART)).drop("part")
    return few.unionByName(dealt).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for every row of ``docs`` (``doc_id``, ``source``, ``text``)."""
    sized = cut(docs.select("doc_id", "source", word_count().alias("size")))
    targets = cut(source_targets(sized, weights, share, cap))
    t = _checked(targets.select(F.col("source").alias("s"), "source_size", "target"))
    rated = sized.join(t, sized.source.eqNullSafe(F.col("s")), "left").drop("s")
    rate = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    part = F.col("rate") - F.floor("rate")
    near_one = part > 1 - TINY
    rated = rated.withColumn("rate", rate).withColumn("base", (F.floor("rate") + near_one.cast("long")).cast("long")).withColumn("p", F.when(near_one | (part < TINY), 0.0).otherwise(part))
    rated = rated.withColumn("class", F.floor(F.log2(F.greatest("size", F.lit(1)).cast("double")) * 8).cast("int"))
    whole = rated.where("p = 0").select("doc_id", "source", "size", F.col("base").alias("copies"))

    same = ["doc_id", "source", "size", "p", "base", "class"]
    groups = cut(rated.where("p > 0").groupBy(*same).agg(F.count("*").alias("n")).withColumn("sum", F.col("n") * F.col("p")))
    groups = groups.withColumn("up", F.floor(F.col("sum") + TINY)).withColumn("part", F.col("sum") - F.col("up"))
    left = (F.col("part") > TINY).cast("long")
    open_ = groups.where(left > 0).select("doc_id", "source", "size", F.col("part").alias("p"), "base", "class")
    for n, more in ((F.col("up"), 1), (F.col("n") - F.col("up") - left, 0)):
        whole = whole.unionByName(_repeated(groups.select("doc_id", "source", "size", (F.col("base") + more).alias("copies"), n.alias("n"))))
    cells = cut(open_.groupBy("source", "class").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks")))
    most = cells.agg(F.max("chunks")).first()[0] or 1
    c = _checked(cells.select(F.col("source").alias("s"), F.col("class").alias("c"), "chunks"))
    open_ = open_.join(c, open_.source.eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")))
    open_ = open_.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), "chunks")).drop("s", "c", "chunks")
    settled = []
    for level in range(math.ceil(math.log(most, FAN_IN)) + 1 if most > 1 else 1):
        done = cut(_round_level(open_.withColumn("k", F.col("class")), ["source", "k", "chunk"], level, by_words=True))
        settled.append(done.where("not open"))
        open_ = done.where("open").select("doc_id", "source", "size", "p", "base", "class", F.floor(F.col("chunk") / FAN_IN).alias("chunk"))
    root = cut(_round_level(open_, ["source"], 99, by_words=False, large_first=True))
    last = F.when(F.col("open"), (uniform(F.lit(100), "doc_id", "size") < F.col("p")).cast("double")).otherwise(F.col("p"))
    settled.append(root.withColumn("p", last))
    for x in settled:
        whole = whole.unionByName(x.select("doc_id", "source", "size", (F.col("base") + F.round("p").cast("long")).alias("copies")))
    return whole.join(t, whole.source.eqNullSafe(F.col("s")), "left").select("doc_id", "source", "size", "source_size", "target", "copies")

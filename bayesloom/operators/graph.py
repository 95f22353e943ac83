"""Graph analytics over edge tables (``parent``, ``child``): rounds of joins, each round kept in the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.kept import kept


def markov_blanket(edges: DataFrame) -> DataFrame:
    """``node, member``: parents, children, and the children's other parents."""
    up = edges.select(F.col("child").alias("node"), F.col("parent").alias("member"))
    down = edges.select(F.col("parent").alias("node"), F.col("child").alias("member"))
    other = edges.select(F.col("parent").alias("member"), "child")
    spouses = edges.join(other, "child").select(F.col("parent").alias("node"), "member").where("node <> member")
    return up.union(down).union(spouses).distinct()


def moral(edges: DataFrame) -> DataFrame:
    """``a, b`` with a < b: edges without direction, and parents of a common child married."""
    plain = edges.select(F.least("parent", "child").alias("a"), F.greatest("parent", "child").alias("b"))
    left, right = edges.select(F.col("parent").alias("a"), "child"), edges.select(F.col("parent").alias("b"), "child")
    return plain.union(left.join(right, "child").where("a < b").select("a", "b")).distinct()


def reachable(edges: DataFrame) -> DataFrame:
    """``ancestor, descendant`` of a directed graph: the transitive closure, path doubling until nothing is new."""
    closed = kept(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct())
    n = closed.count()
    while True:
        right = closed.select(F.col("ancestor").alias("m"), F.col("descendant").alias("d"))
        grown = kept(closed.union(closed.join(right, F.col("descendant") == F.col("m")).select("ancestor", F.col("d").alias("descendant"))).distinct())
        more = grown.count()
        if more == n:
            return grown
        closed, n = grown, more


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("x"), F.col("child").alias("y")).union(edges.select("child", "parent")).distinct()


def distances(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``source, node, dist``: hops between nodes of the undirected graph, up to ``most``, or as far as there are any."""
    both = kept(_undirected(edges))
    found = both.select(F.col("x").alias("source")).distinct().select("source", F.col("source").alias("node"), F.lit(0).alias("dist"))
    edge, k = found, 0
    while most is None or k < most:
        k += 1
        edge = kept(edge.join(both, F.col("node") == F.col("x")).select("source", F.col("y").alias("node")).distinct().join(found.select("source", "node"), ["source", "node"], "left_anti").withColumn("dist", F.lit(k)))
        if edge.isEmpty():
            break
        found = found.unionByName(edge)
    return found


def levels(edges: DataFrame) -> DataFrame:
    """``node, level``: the longest path from a root; the order of levels is topological. A cycle is an error."""
    edges = kept(edges.select("parent", "child").distinct())
    nodes = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    count = nodes.count()
    at = kept(nodes.join(edges.select(F.col("child").alias("node")), "node", "left_anti").withColumn("level", F.lit(0)))
    found, k = at, 0
    if count and at.isEmpty():
        raise ValueError("the graph has a cycle")
    while True:
        k += 1
        at = kept(at.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct().withColumn("level", F.lit(k)))
        if at.isEmpty():
            break
        if k >= count:
            raise ValueError("the graph has a cycle")
        found = found.unionByName(at)
    placed = found.groupBy("node").agg(F.max("level").alias("level"))
    if placed.count() < count:
        raise ValueError("the graph has a cycle")
    return placed


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that can be reached without regard to direction.

    Stars in turn: every node ties its larger neighbours to the least node around it, then its smaller ones, until all
    components are stars. The number of rounds grows with the logarithm of the graph's size, not with its diameter.
    """
    both = kept(_undirected(edges))
    nodes = both.select(F.col("x").alias("node")).distinct()
    pairs = both.where("x > y")
    state = None
    while True:
        around = pairs.union(pairs.select("y", "x"))
        least = around.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = around.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        lower = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(lower, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y"))
        pairs = kept(small.union(lower.select("x", F.col("m").alias("y"))).distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return nodes.join(pairs.select(F.col("x").alias("node"), "y"), "node", "left").select("node", F.coalesce("y", "node").alias("component"))


def _spanning_trees(both: DataFrame) -> tuple[DataFrame, int]:
    """``node, up, level`` of a breadth-first tree for each component, from its smallest node; and the number of levels."""
    roots = connected_components(both.select(F.col("x").alias("parent"), F.col("y").alias("child"))).where("node = component")
    front = kept(roots.select("node", F.lit(None).cast(both.schema["x"].dataType).alias("up"), F.lit(0).alias("level")))
    tree, k = front, 0
    while True:
        k += 1
        reached = front.join(both, F.col("node") == F.col("x")).select(F.col("y").alias("node"), F.col("x").alias("up")).groupBy("node").agg(F.min("up").alias("up"))
        front = kept(reached.join(tree.select("node"), "node", "left_anti").withColumn("level", F.lit(k)))
        if front.isEmpty():
            return kept(tree), k
        tree = tree.unionByName(front)


def biconnected(edges: DataFrame) -> DataFrame:
    """``node, up, block``: each edge of a spanning tree, and the two-connected block it belongs to.

    Tarjan and Vishkin's reduction: nodes are numbered in preorder of a breadth-first tree, every subtree learns the
    least and greatest number that its edges reach, and tree edges that lie on a common cycle are components of a graph
    over tree edges. Rounds follow the tree's depth; rows are linear in the edges.
    """
    both = kept(_undirected(edges).where("x <> y"))
    tree, depth = _spanning_trees(both)
    sizes = tree.where(F.lit(False)).select("node", F.lit(0).cast("long").alias("size"))
    for k in range(depth - 1, -1, -1):  # subtrees, from the leaves
        own = tree.where(F.col("level") == k).select("node")
        below = tree.where(F.col("level") == k + 1).join(sizes, "node").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("s"))
        sizes = kept(sizes.unionByName(own.join(below, "node", "left").select("node", (F.coalesce("s", F.lit(0)) + 1).alias("size"))))
    sized = tree.join(sizes, "node")
    before = Window.partitionBy("up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    placed = kept(sized.where("level = 0").select("node", "up", "level", "size", F.lit(0).cast("long").alias("pre")))
    shifts = sized.where("level > 0").withColumn("shift", F.coalesce(F.sum("size").over(before), F.lit(0)) + 1)
    for k in range(1, depth):  # numbers within each tree, from its root
        own = shifts.where(F.col("level") == k).join(placed.select(F.col("node").alias("up"), F.col("pre").alias("_p")), "up")
        placed = kept(placed.unionByName(own.select("node", "up", "level", "size", (F.col("_p") + F.col("shift")).alias("pre"))))
    number = placed.select(F.col("node").alias("y"), F.col("pre").alias("yp"), F.col("size").alias("ys"), F.col("up").alias("yup"))
    across = both.join(placed.select(F.col("node").alias("x"), F.col("pre").alias("xp"), F.col("size").alias("xs"), F.col("up").alias("xup")), "x").join(number, "y")
    across = kept(across.where("NOT coalesce(xup = y, false) AND NOT coalesce(yup = x, false)"))  # edges outside the trees
    reach = placed.join(across.groupBy(F.col("x").alias("node")).agg(F.min("yp").alias("a"), F.max("yp").alias("b")), "node", "left")
    reach = kept(reach.select("node", "up", "level", "size", "pre", F.least("pre", "a").alias("low"), F.greatest("pre", "b").alias("high")))
    spans = reach.where(F.lit(False)).select("node", "low", "high")
    for k in range(depth - 1, -1, -1):
        own = reach.where(F.col("level") == k).select("node", "low", "high")
        below = reach.where(F.col("level") == k + 1).select("node", "up").join(spans, "node").groupBy(F.col("up").alias("node")).agg(F.min("low").alias("a"), F.max("high").alias("b"))
        spans = kept(spans.unionByName(own.join(below, "node", "left").select("node", F.least("low", "a").alias("low"), F.greatest("high", "b").alias("high"))))
    side = across.where("xp + xs <= yp").select(F.col("x").alias("parent"), F.col("y").alias("child"))
    above = placed.select(F.col("node").alias("up"), F.col("pre").alias("up_pre"), F.col("size").alias("up_size"), F.col("level").alias("up_level"))
    chain = placed.select("node", "up").join(spans, "node").join(above, "up").where("up_level > 0 AND (low < up_pre OR high >= up_pre + up_size)")
    joined = connected_components(side.union(chain.select(F.col("up").alias("parent"), F.col("node").alias("child"))))
    return placed.where("up IS NOT NULL").join(joined, "node", "left").select("node", "up", F.coalesce("component", "node").alias("block"))


def articulation_points(edges: DataFrame) -> DataFrame:
    """``node``: nodes without which their component falls apart, those of more than one two-connected block."""
    blocks = kept(biconnected(edges))
    ends = blocks.select("node", "block").union(blocks.select("up", "block"))
    return ends.groupBy("node").agg(F.count_distinct("block").alias("blocks")).where("blocks > 1").select("node")


def betweenness(edges: DataFrame, sources: int | None = None, seed: int = 0) -> DataFrame:
    """``node, betweenness``: shortest paths through a node, from all sources or ``sources`` of them chosen by hash and scaled up; halved, as edges have no direction."""
    both = kept(_undirected(edges))
    nodes = kept(both.select(F.col("x").alias("node")).distinct())
    n = nodes.count()
    starts = nodes if sources is None else nodes.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(sources)
    used = starts.count()
    front = kept(starts.select(F.col("node").alias("source"), "node", F.lit(0).alias("dist"), F.lit(1.0).alias("paths")))
    steps = [front]
    seen = front.select("source", "node")
    while True:  # paths counted level by level
        ahead = steps[-1].join(both, F.col("node") == F.col("x")).groupBy("source", "y").agg(F.sum("paths").alias("paths"), (F.max("dist") + 1).alias("dist"))
        ahead = kept(ahead.select("source", F.col("y").alias("node"), "dist", "paths").join(seen, ["source", "node"], "left_anti"))
        if ahead.isEmpty():
            break
        steps.append(ahead)
        seen = seen.union(ahead.select("source", "node"))
    depend = steps[-1].select("source", "node", "paths", F.lit(0.0).alias("d"))
    out = []
    for level in reversed(steps[:-1]):  # dependencies gathered back, level by level
        out.append(depend)
        below = depend.select("source", F.col("node").alias("y"), (F.lit(1.0) + F.col("d")).alias("one"), F.col("paths").alias("below"))
        part = level.join(both, F.col("node") == F.col("x")).join(below, ["source", "y"]).groupBy("source", "node").agg(F.sum(F.col("paths") / F.col("below") * F.col("one")).alias("d"))
        depend = kept(level.select("source", "node", "paths").join(part, ["source", "node"], "left").select("source", "node", "paths", F.coalesce("d", F.lit(0.0)).alias("d")))
    total = out[0] if out else depend.where(F.lit(False))
    for x in out[1:]:
        total = total.union(x)
    sums = total.groupBy("node").agg(F.sum("d").alias("d"))
    return nodes.join(sums, "node", "left").select("node", (F.coalesce("d", F.lit(0.0)) * (n / max(used, 1) / 2)).alias("betweenness"))


def report_sizes(edges: DataFrame, blanket: DataFrame) -> DataFrame:
    """``node, n_parents, n_blanket`` for every node, 0 where there are none."""
    nodes = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    parents = edges.groupBy(F.col("child").alias("node")).agg(F.count_distinct("parent").alias("n_parents"))
    members = blanket.groupBy("node").agg(F.count_distinct("member").alias("n_blanket"))
    return nodes.join(parents, "node", "left").join(members, "node", "left").na.fill(0, ["n_parents", "n_blanket"])


def parameter_counts(edges: DataFrame, cards: DataFrame) -> DataFrame:
    """``node, parameters``: (values - 1) times the product of the parents' values."""
    c = cards.select(F.col("node").alias("parent"), F.col("card").alias("pc"))
    above = edges.join(c, "parent").groupBy(F.col("child").alias("node")).agg(F.product(F.col("pc").cast("double")).alias("rows"))
    return cards.join(above, "node", "left").select("node", ((F.col("card") - 1) * F.coalesce("rows", F.lit(1.0))).cast("long").alias("parameters"))

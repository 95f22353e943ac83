"""Search over vectors: exact top-k by tiled matrix products, and approximate neighbours by projected kd-trees.

Candidates are dealt into shards, each a task of its own (a partition per shard), where a stream
sorted by shard gives first the vectors, then the queries in blocks. Each shard returns its best
few for each query, and these lists are merged in a tree of bounded fan-in.

*Exact top-k* deals vectors by hash and sends every query to each shard. *Neighbours* deals them
by the cell of a kd-tree over a few Gaussian projections; a cell that holds more than a shard is
split by hash. A query first searches its own cell, which bounds its k-th distance, and then
only those cells whose projected box the stopping test cannot rule out under that bound. Cells
are cut from a bounded sample (``SAMPLE`` vectors), but every vector is placed in one.

Cases: vectors that are null, or hold null or non-finite numbers, take no part (nor do zero
vectors in the neighbour search); a query is never its own candidate, and rows that repeat a
``vec_id`` are one query (of their smallest vector), candidates each, but not for one another;
fewer candidates than ``k`` are all returned; ties go to the smaller id; vectors of other lengths
than the query's are no candidates; an integer product beyond 64 bits is an error; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ceil_div, cut, released

#: Vectors in a shard (on average), queries in a block, lists merged at once.
SHARD, BLOCK, FAN_IN = 32_768, 512, 16
#: Vectors that cells are cut from, cells at most (larger cells are split by hash), points opened at once in a walk, and verified before the first test.
SAMPLE, CELLS, STEP, FIRST = 20_000, 4096, 1024, 128

#: From a block of ids, vectors and bounds: query ids, vector ids, scores, and how many vectors were scored (on a query's first row).
Answer = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def usable(vector: str = "embedding", zero: bool = True) -> Column:
    """Whether a vector takes part; ``zero``: zero vectors do too."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & finite
    return fine if zero else fine & F.exists(vector, lambda x: x != 0)


def shard_stream(vectors: DataFrame, queries: DataFrame, shards: int, index: Callable[[np.ndarray, np.ndarray], Answer], kind: str) -> DataFrame:
    """``query_id, shard, vec_id, score, scored``: each shard's answers to the queries sent to it.

    ``vectors`` and ``queries`` have ``shard``, ``vec_id`` and ``vec`` (array of double), queries
    also ``bound``. ``index`` is called with a shard's ids and matrix (one dimension) and gives
    the function that answers a block.
    """
    columns = ["shard", "asks", "vec_id", "bound", "vec"]
    mine = vectors.withColumn("asks", F.lit(False)).withColumn("bound", F.lit(None).cast("double")).select(columns)
    stream = mine.union(queries.withColumn("asks", F.lit(True)).select(columns)).withColumn("dim", F.size("vec"))
    stream = stream.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dim", "asks", "vec_id")

    @released
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows, answer = None, [], [], None
        for batch in batches:
            shard_, asks, vec_id, dim, bound = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "asks", "vec_id", "dim", "bound"))
            values = batch.column("vec").flatten().to_numpy()
            ends = np.cumsum(dim)
            cuts = np.flatnonzero((np.diff(shard_) != 0) | (np.diff(dim) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(shard_)], strict=True):
                if hi == lo:
                    continue
                block = values[ends[lo] - dim[lo] : ends[hi - 1]].reshape(hi - lo, dim[lo])
                if (shard_[lo], dim[lo]) != at:
                    at, ids, rows, answer = (shard_[lo], dim[lo]), [], [], None
                if not asks[lo]:
                    ids.append(vec_id[lo:hi])
                    rows.append(block)
                elif ids:
                    answer = answer or index(np.concatenate(ids), np.concatenate(rows))
                    for k in range(lo, hi, BLOCK):
                        some = slice(k, min(k + BLOCK, hi))
                        q, v, s, n = answer(vec_id[some], block[k - lo : k - lo + BLOCK], bound[some])
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.full(len(q), at[0]), pa.int32()), pa.array(v, pa.int64()), pa.array(s), pa.array(n, pa.int64())], names=["query_id", "shard", "vec_id", "score", "scored"])

    return stream.mapInArrow(task, f"query_id long, shard int, vec_id long, score {kind}, scored long")


def merge(found: DataFrame, shards: int, k: int, largest: bool) -> DataFrame:
    """``query_id, rank, vec_id, score, scored``: the best ``k`` of all shards' answers, merged in a tree."""
    order = -F.col("score") if largest else F.col("score")
    lists = found.select("query_id", "shard", F.array(F.struct(order.alias("o"), "vec_id", "score")).alias("best"), "scored")
    for _ in range(max(1, math.ceil(math.log(max(shards, 2), FAN_IN)))):
        best = F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k)
        lists = lists.groupBy("query_id", F.floor(F.col("shard") / FAN_IN).cast("int").alias("shard")).agg(best.alias("best"), F.sum("scored").alias("scored"))
    return lists.select("query_id", F.posexplode("best").alias("at", "x"), "scored").select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score", "scored")


def asking(rows: DataFrame, every: int) -> DataFrame:
    """The queries: one row for each id that ``every`` divides."""
    return rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def best_of(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Partial selection of a tile (queries by candidates): the largest ``k`` of each row, ties to smaller ids."""
    q, v, s, n = [], [], [], []
    for r in range(len(scores)):
        row = scores[r]
        allowed = np.flatnonzero(ids != own[r])
        n.append(np.zeros(min(k, len(allowed)), np.int64))
        n[-1][:1] = len(allowed)
        if len(allowed) > k:
            edge = -np.partition(-row[allowed], k - 1)[k - 1]
            allowed = allowed[row[allowed] >= edge]
        best = allowed[np.lexsort((ids[allowed], -row[allowed]))][:k]
        q.append(np.full(len(best), own[r]))
        v.append(ids[best])
        s.append(row[best])
    return np.concatenate(q), np.concatenate(v), np.concatenate(s), np.concatenate(n)


def integer_products(k: int) -> Callable[[np.ndarray, np.ndarray], Answer]:
    """Index of exact top-k by integer inner product; components are whole numbers held as doubles."""

    def index(ids: np.ndarray, rows: np.ndarray) -> Answer:
        most = np.abs(rows).max(initial=0)

        def answer(own: np.ndarray, block: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            if most * np.abs(block).max(initial=0) * rows.shape[1] < 2**53:  # exact in doubles
                return best_of((block @ rows.T).astype(np.int64), ids, own, k)
            whole = np.vectorize(int, otypes=[object])
            tile = whole(block) @ whole(rows).T
            if max(map(abs, tile.ravel())) >= 2**63:
                raise OverflowError("an inner product does not fit 64 bits")
            return best_of(tile.astype(np.int64), ids, own, k)

        return answer

    return index


def exact_top_k(embeddings: DataFrame, every: int, k: int, scale: int = 256, shard: int = SHARD) -> DataFrame:
    """Best ``k`` inner products of ``floor(scale * x)`` for the rows whose id is divisible by ``every``."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = cut(embeddings.where(usable() & F.col("vec_id").isNotNull()).select("vec_id", whole.alias("vec")))
    shards = how_many(rows, shard)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asked = asking(rows, every).select("vec_id", "vec", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(None).cast("double").alias("bound"))
    return merge(shard_stream(dealt, asked, shards, integer_products(k), "long"), shards, k, largest=True).drop("scored")


def how_many(rows: DataFrame, shard: int) -> int:
    """Shards for ``rows``: of about ``shard`` vectors, or smaller ones while there are fewer than two tasks a core."""
    count = rows.count()
    return max(ceil_div(count, shard), min(2 * rows.sparkSession.sparkContext.defaultParallelism, ceil_div(count, 1024)))


def chi_square_quantile(p: float, degrees: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom, by bisection."""

    def below(x: float) -> float:
        term, total = 1.0, 0.0
        for i in range(degrees // 2):
            total += term
            term *= x / 2 / (i + 1)
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


class KdTree:
    """A kd-tree by median splits of the widest side; ``order`` holds the points' rows leaf by leaf."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.side, self.value, self.below, self.above, self.low, self.high, self.span = [], [], [], [], [], [], []
        order: list[np.ndarray] = []
        todo, held = [(np.arange(len(points)), -1, False)], 0
        while todo:
            rows, parent, upper = todo.pop()
            me = len(self.side)
            if parent >= 0:
                (self.above if upper else self.below)[parent] = me
            low, high = points[rows].min(axis=0), points[rows].max(axis=0)
            side = int((high - low).argmax())
            x = points[rows, side]
            value = float(np.partition(x, (len(rows) - 1) // 2)[(len(rows) - 1) // 2])
            inner = len(rows) > leaf and high[side] > low[side]
            if inner and value == high[side]:  # more than half are the greatest
                value = float(x[x < value].max())
            for known, new in ((self.side, side), (self.value, value), (self.below, -1), (self.above, -1), (self.low, low), (self.high, high), (self.span, (held, held + len(rows)))):
                known.append(new)
            if inner:
                todo += [(rows[x > value], me, True), (rows[x <= value], me, False)]
            else:
                order.append(rows)
                held += len(rows)
        self.order = np.concatenate(order)
        self.points = points[self.order]
        self.low, self.high = np.asarray(self.low), np.asarray(self.high)

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The leaf (its node's number) that each row of ``x`` falls into."""
        side, value, below, above = map(np.asarray, (self.side, self.value, self.below, self.above))
        node = np.zeros(len(x), np.int64)
        while (inner := below[node] >= 0).any():
            at = node[inner]
            node[inner] = np.where(x[inner, side[at]] > value[at], above[at], below[at])
        return node

    def walk(self, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in ``order`` and squared distances of all points, nearest first, run by run."""
        gap = box_gap(self.low, self.high, p).tolist()
        heap, held, far = [(gap[0], 0)], np.zeros(0, np.int64), np.zeros(0)
        while heap or len(held):
            leaves, size = [held], 0
            while heap and size < STEP:
                _, n = heappop(heap)
                if self.below[n] < 0:
                    leaves.append(np.arange(*self.span[n]))
                    size += len(leaves[-1])
                else:
                    for child in (self.below[n], self.above[n]):
                        heappush(heap, (gap[child], child))
            new = np.concatenate(leaves[1:]) if size else np.zeros(0, np.int64)
            held, far = np.concatenate((held, new)), np.concatenate((far, ((self.points[new] - p) ** 2).sum(axis=1)))
            near = far <= (heap[0][0] if heap else math.inf)
            order = np.argsort(far[near], kind="stable")
            yield held[near][order], far[near][order]
            held, far = held[~near], far[~near]


def box_gap(low: np.ndarray, high: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distance of a point from each box."""
    return (np.maximum(np.maximum(low - p, p - high), 0) ** 2).sum(axis=1)


def projections(width: int, dims: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


def projected_tree(k: int, dims: int, confidence: float, leaf: int = 64) -> Callable[[np.ndarray, np.ndarray], Answer]:
    """Index of nearest neighbours: a kd-tree over a few Gaussian projections, walked point by point.

    The squared length of a projected difference is the true one times a chi-square variable
    with ``dims`` degrees of freedom. Vectors are verified in the order of their projected
    distance, until a neighbour nearer than the k-th so far (or the query's bound) would have
    been projected nearer than the next one with the given confidence.
    """
    limit = chi_square_quantile(confidence, dims)

    def index(ids: np.ndarray, rows: np.ndarray) -> Answer:
        axes = projections(rows.shape[1], dims)
        tree = KdTree(rows @ axes, leaf)
        ids, rows = ids[tree.order], rows[tree.order]

        def one(own: int, query: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, int]:
            best_d, best_v, scored, step = np.zeros(0), np.zeros(0, np.int64), 0, FIRST
            bound = math.inf if bound != bound else bound * bound * (1 + 1e-12)
            for places, near in tree.walk(query @ axes):
                at = 0
                while at < len(places):
                    kth = min(bound, best_d[-1] if len(best_d) == k else math.inf)
                    end = min(at + step, int(np.searchsorted(near, limit * kth, side="right")))
                    if end <= at:
                        return best_v, np.sqrt(best_d), scored
                    some = places[at:end]
                    some = some[ids[some] != own]
                    scored += len(some)
                    d = np.concatenate((best_d, ((rows[some] - query) ** 2).sum(axis=1)))
                    v = np.concatenate((best_v, ids[some]))
                    pick = np.lexsort((v, d))[:k]
                    best_d, best_v, at, step = d[pick], v[pick], end, min(2 * step, STEP)
            return best_v, np.sqrt(best_d), scored

        def answer(own: np.ndarray, block: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            found = [one(*x) for x in zip(own.tolist(), block, bound.tolist(), strict=True)]
            scored = [np.array([n] + [0] * (len(v) - 1), np.int64)[: len(v)] for v, _, n in found]
            return np.repeat(own, [len(v) for v, *_ in found]), np.concatenate([v for v, *_ in found]), np.concatenate([d for _, d, _ in found]), np.concatenate(scored)

        return answer

    return index


def _project(rows: DataFrame, dims: int, tree: KdTree) -> DataFrame:
    """``rows`` (``vec_id, vec``) with their ``cell`` and projected ``point``."""

    @released
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.zeros((batch.num_rows, dims))
            width, values = np.diff(batch.column(1).offsets.to_numpy()), batch.column(1).flatten().to_numpy()
            begin = np.cumsum(width) - width
            for w in np.unique(width):
                own = np.flatnonzero(width == w)
                points[own] = values[begin[own][:, None] + np.arange(w)] @ projections(int(w), dims)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, points.size + 1, dims), pa.int32()), pa.array(points.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.cell(points), pa.int32()), flat], names=["vec_id", "vec", "cell", "point"])

    return rows.select("vec_id", "vec").mapInArrow(task, "vec_id long, vec array<double>, cell int, point array<double>")


def _farther_cells(queries: DataFrame, boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], limit: float) -> DataFrame:
    """``vec_id, vec, bound, cell``: the other cells in which each query's bound leaves something to find. ``boxes``: cells, lows and highs by vector length."""

    @released
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, bound = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            width, points = batch.column(5).to_pylist(), batch.column(3).to_pylist()
            at, cells = [], []
            for i in range(batch.num_rows):
                cell, low, high = boxes[width[i]]
                reach = math.inf if bound[i] is None else limit * bound[i] ** 2 * (1 + 1e-12)
                open_ = cell[(box_gap(low, high, np.array(points[i])) <= reach) & (cell != home[i])]
                at.append(np.full(len(open_), i))
                cells.append(open_)
            at = pa.array(np.concatenate(at) if at else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(4).take(at), pa.array(np.concatenate(cells) if cells else [], pa.int32())], names=["vec_id", "vec", "bound", "cell"])

    return queries.select("vec_id", "vec", "cell", "point", "bound", F.size("vec")).mapInArrow(task, "vec_id long, vec array<double>, bound double, cell int")


def nearest_neighbours(embeddings: DataFrame, every: int, k: int, dims: int = 8, confidence: float = 0.85, shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score, scored``: ``k`` nearest by Euclidean distance for the rows whose id is divisible by ``every``.

    ``scored`` is the number of vectors whose true distance the query has looked at.
    """
    rows = cut(embeddings.where(usable(zero=False) & F.col("vec_id").isNotNull()).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec")))
    cells = min(CELLS, how_many(rows, shard))
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow().column("vec").to_pylist()
    sample = np.array([np.asarray(v) @ projections(len(v), dims) for v in few]).reshape(-1, dims)
    tree = KdTree(sample if len(sample) else np.zeros((1, dims)), leaf=ceil_div(3 * len(sample), 2 * cells))
    placed = cut(_project(rows, dims, tree))
    sides = [f(F.get("point", F.lit(i))).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(dims)]
    known = placed.groupBy("cell", F.size("vec").alias("width")).agg(F.count("*").alias("n"), *sides).collect()  # at most CELLS for each length
    boxes, size = {}, {}
    for w in sorted({r["width"] for r in known}):
        own = [r for r in known if r["width"] == w]
        boxes[w] = (np.array([r["cell"] for r in own]), *(np.array([[r[f"{n}{i}"] for i in range(dims)] for r in own]) for n in ("lo", "hi")))
    for r in known:
        size[r["cell"]] = size.get(r["cell"], 0) + r["n"]
    parts = {c: ceil_div(n, shard) for c, n in sorted(size.items())}
    first = dict(zip(parts, np.cumsum([0, *parts.values()])[:-1].tolist(), strict=True))
    shards = max(1, sum(parts.values()))
    where = F.broadcast(rows.sparkSession.createDataFrame([(c, first[c], parts[c]) for c in parts], "cell int, first int, parts int"))  # at most CELLS rows
    dealt = placed.join(where, "cell").select("vec_id", "vec", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).alias("shard"))
    every_part = F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("shard")
    index = projected_tree(k, dims, confidence)

    queries = cut(_project(asking(rows, every), dims, tree))
    home = queries.join(where, "cell").select("vec_id", "vec", F.lit(None).cast("double").alias("bound"), every_part)
    near = cut(shard_stream(dealt, home, shards, index, "double"))
    bounds = merge(near, shards, k, largest=False).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    farther = _farther_cells(queries.join(bounds, "vec_id", "left"), boxes, chi_square_quantile(confidence, dims))
    farther = farther.join(where, "cell").select("vec_id", "vec", "bound", every_part)
    return merge(near.union(shard_stream(dealt, farther, shards, index, "double")), shards, k, largest=False)

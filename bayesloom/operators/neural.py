"""Neural families: gradients added up in tasks, summed by Spark, one step for each pass.

A network of one hidden layer gives the parameters of a mixture of normals (one of them: a
Gaussian network), or the logits of classes. Every task adds up the loss and the gradient over its
rows; only a vector of the parameters' size leaves it. The optimiser's state has that size, too,
and stays with the model, so that later rows go on from where the fit ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions.draws import normal, uniform
from ..plans.kept import kept
from . import binned

LEAST = 1e-3


@dataclass
class Net:
    """Weights as one vector, what inputs are scaled by, and the optimiser's state."""

    inputs: list[str]
    outputs: int
    hidden: int
    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    momentum: np.ndarray = field(default_factory=lambda: np.zeros(0))
    square: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps: int = 0

    def parts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d, h, o = len(self.inputs), self.hidden, self.outputs
        a, b, c = d * h, d * h + h, d * h + h + h * o
        return w[:a].reshape(d, h), w[a:b], w[b:c].reshape(h, o), w[c:]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.parts(self.weights)
        z = (x - self.center) / self.spread
        h = np.tanh(z @ w1 + b1)
        return z, h, h @ w2 + b2

    def backward(self, z: np.ndarray, h: np.ndarray, d_out: np.ndarray) -> np.ndarray:
        w2 = self.parts(self.weights)[2]
        d_h = (d_out @ w2.T) * (1 - h * h)
        return np.concatenate([(z.T @ d_h).ravel(), d_h.sum(axis=0), (h.T @ d_out).ravel(), d_out.sum(axis=0)])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def mixture_loss(out: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of a mixture of normals, and its gradient by the outputs (logits, means, raw widths)."""
    k = out.shape[1] // 3
    pi, m, raw = _softmax(out[:, :k]), out[:, k : 2 * k], out[:, 2 * k :]
    s = np.logaddexp(raw, 0) + LEAST
    gap = (y[:, None] - m) / s
    log_p = np.log(np.maximum(pi, 1e-300)) - 0.5 * gap**2 - np.log(s) - 0.5 * np.log(2 * np.pi)
    top = log_p.max(axis=1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(log_p - top).sum(axis=1))
    r = np.exp(log_p - total[:, None])
    return float(-total.sum()), np.column_stack([pi - r, -r * gap / s, r * (1 - gap**2) / s / (1 + np.exp(-raw))])


def class_loss(out: np.ndarray, y: np.ndarray, smoothing: float = 0.0) -> tuple[float, np.ndarray]:
    """Cross entropy of classes 0..k-1, each held to be any class with a share of ``smoothing``, and its gradient by the logits."""
    p, at = _softmax(out), (np.arange(len(y)), y.astype(np.int64))
    wanted = np.full_like(p, smoothing / p.shape[1])
    wanted[at] += 1 - smoothing
    loss = float(-(wanted * np.log(np.maximum(p, 1e-300))).sum())
    return loss, p - wanted


def start(df: DataFrame, inputs: list[str], outputs: int, hidden: int, seed: int = 0) -> Net:
    got = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(inputs) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if inputs else {}
    center, spread = (np.array([got[f"{n}{i}"] or 0.0 for i in range(len(inputs))], float) for n in "ms")
    rng = np.random.default_rng(seed)
    size = (len(inputs) + 1) * hidden + (hidden + 1) * outputs
    w = rng.standard_normal(size) * 0.5
    return Net(list(inputs), outputs, hidden, center, np.where(spread > 0, spread, 1.0), w, np.zeros(size), np.zeros(size))


def train(net: Net, df: DataFrame, target: str, loss: str, steps: int, rate: float = 0.05, smoothing: float = 0.0) -> Net:
    """``steps`` Adam steps on the mean loss over all rows of ``df`` (complete, of doubles); each is one pass over a kept table."""
    rows = kept(df.select(*net.inputs, target))
    of = {"mixture": mixture_loss, "class": partial(class_loss, smoothing=smoothing)}[loss]

    for _ in range(steps):
        now = net

        def task(batches: Iterator[pa.RecordBatch], now: Net = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(now.weights) + 2)
            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(batch.num_columns)]
                x = np.column_stack(columns[:-1]) if now.inputs else np.zeros((batch.num_rows, 0))
                z, h, out = now.forward(x)
                value, d_out = of(out, columns[-1])
                total += np.concatenate([[value, batch.num_rows], now.backward(z, h, d_out)])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["at", "x"])

        cells = rows.mapInArrow(task, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # as many rows as weights
        total = np.zeros(len(net.weights) + 2)
        total[cells.column("at").to_numpy()] = cells.column("x").to_numpy()
        if not total[1]:
            return net
        g = total[2:] / total[1]
        k = net.steps + 1
        m, v = 0.9 * net.momentum + 0.1 * g, 0.99 * net.square + 0.01 * g * g
        w = net.weights - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        net = Net(net.inputs, net.outputs, net.hidden, net.center, net.spread, w, m, v, k)
    return net


def outputs(df: DataFrame, net: Net, name: str = "_out") -> DataFrame:
    """``df`` with the network's outputs as an array; null where an input is null."""
    at = [df.columns.index(c) for c in net.inputs]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in at]) if at else np.zeros((batch.num_rows, 0))
            out = net.forward(x)[2]
            rows = [None if np.isnan(r).any() else r.tolist() for r in out]
            yield batch.append_column(name, pa.array(rows, pa.list_(pa.float64())))

    return df.mapInArrow(task, StructType([*df.schema.fields]).add(name, ArrayType(DoubleType())))


def softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, v: a + v))


def pick(probs: Column, u: Column) -> Column:
    """The first place (from 1) at which the summed probabilities exceed ``u``."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(1).alias("k"))
    return F.least(F.aggregate(probs, zero, lambda a, p: F.struct((a["s"] + p).alias("s"), F.when(a["s"] + p <= u, a["k"] + 1).otherwise(a["k"]).alias("k")), lambda a: a["k"]), F.size(probs))


@dataclass
class Mixture:
    """A child given numeric parents as a mixture of normals by a network."""

    child: str
    parents: list[str]
    net: Net
    shift: float
    scale: float
    family = "mdn"

    @staticmethod
    def fit(df: DataFrame, child: str, parents: list[str], components: int = 1, hidden: int = 16, steps: int = 60, rate: float = 0.05, seed: int = 0) -> Mixture:
        rows = df.dropna(subset=[child, *parents]).select(*[F.col(c).cast("double").alias(c) for c in [child, *parents]])
        got = rows.agg(F.avg(child), F.stddev_pop(child)).first()
        shift, scale = got[0] or 0.0, max(got[1] or 0.0, LEAST)
        out = Mixture(child, list(parents), start(rows, list(parents), 3 * components, hidden, seed), shift, scale)
        return out.more(rows, steps, rate)

    def more(self, df: DataFrame, steps: int, rate: float) -> Mixture:
        """Further steps on other rows, with the optimiser's state as it was left."""
        rows = df.dropna(subset=[self.child, *self.parents]).select(*[F.col(c).cast("double").alias(c) for c in self.parents], ((F.col(self.child).cast("double") - self.shift) / self.scale).alias("_y"))
        return Mixture(self.child, self.parents, train(self.net, rows, "_y", "mixture", steps, rate), self.shift, self.scale)

    def _with(self, rows: DataFrame) -> DataFrame:
        k = self.net.outputs // 3
        out = outputs(rows, self.net)
        wide = F.transform(F.slice("_out", 2 * k + 1, k), lambda r: (F.log1p(F.exp(-F.abs(r))) + F.greatest(r, F.lit(0.0)) + LEAST) * self.scale)
        return out.withColumn("_pi", softmax(F.slice("_out", 1, k))).withColumn("_m", F.transform(F.slice("_out", k + 1, k), lambda m: m * self.scale + self.shift)).withColumn("_s", wide)

    def draw(self, rows: DataFrame, seed: int, keys: list) -> DataFrame:
        at = pick(F.col("_pi"), uniform(F.lit(seed), *keys, F.lit(self.child), F.lit("component")))
        rows = self._with(rows).withColumn("_k", at)
        return rows.withColumn(self.child, F.element_at("_m", F.col("_k")) + F.element_at("_s", F.col("_k")) * normal(F.lit(seed), *keys, F.lit(self.child))).drop("_out", "_pi", "_m", "_s", "_k")

    def log_prob(self, rows: DataFrame) -> DataFrame:
        y = F.col(self.child).cast("double")
        each = F.zip_with("_m", "_s", lambda m, s: -0.5 * ((y - m) / s) ** 2 - F.ln(s) - 0.9189385332046727)
        logs = F.zip_with("_pi", each, lambda p, e: F.ln(F.greatest(p, F.lit(1e-300))) + e)
        rows = self._with(rows).withColumn("_l", logs)
        total = F.array_max("_l") + F.ln(F.aggregate(F.transform("_l", lambda x: F.exp(x - F.array_max("_l"))), F.lit(0.0), lambda a, x: a + x))
        return rows.withColumn("log_prob", total).drop("_out", "_pi", "_m", "_s", "_l")

    def size(self) -> dict:
        return {"components": self.net.outputs // 3, "weights": len(self.net.weights)}


@dataclass
class Classes:
    """A child of a few values given parents, numbers or categories (which enter as one sign for each value: a learned embedding)."""

    child: str
    parents: list[str]
    values: list
    categories: dict[str, list]
    net: Net
    family = "softmax_nn"

    @staticmethod
    def _inputs(df: DataFrame, parents: list[str], categories: dict[str, list]) -> tuple[DataFrame, list[str]]:
        columns = {}
        for p in parents:
            if p in categories:
                columns |= {f"_in_{p}_{i}": (F.col(p) == F.lit(v)).cast("double") for i, v in enumerate(categories[p])}
            else:
                columns[f"_in_{p}"] = F.col(p).cast("double")
        return df.withColumns(columns) if columns else df, list(columns)

    @staticmethod
    def categories_of(df: DataFrame, c: str, most: int) -> list:
        """A column's values in order, of which there must not be more than ``most``."""
        found = sorted(r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().limit(most + 1).collect())
        if len(found) > most:
            raise ValueError(f"{c} has more than {most} values")
        return found

    @staticmethod
    def fit(df: DataFrame, child: str, parents: list[str], most: int = 64, hidden: int = 16, steps: int = 60, rate: float = 0.05, seed: int = 0, embed: bool | None = None) -> Classes:
        """Values of the child, and of each parent that is text (or with ``embed`` any), must not be more than ``most``."""

        categories = {p: Classes.categories_of(df, p, most) for p in parents if embed or (embed is None and dict(df.dtypes)[p] in ("string", "boolean"))}
        values = Classes.categories_of(df, child, most)
        rows, inputs = Classes._inputs(df.dropna(subset=[child, *parents]), parents, categories)
        out = Classes(child, list(parents), values, categories, start(rows, inputs, max(len(values), 1), hidden, seed))
        return out.more(df, steps, rate)

    def more(self, df: DataFrame, steps: int, rate: float) -> Classes:
        """Further steps on other rows; a value of the child that the model does not know is an error."""
        rows, inputs = self._inputs(df.dropna(subset=[self.child, *self.parents]), self.parents, self.categories)
        code = F.array_position(F.array(*[F.lit(v) for v in self.values]), F.col(self.child)) - 1
        known = F.when(code >= 0, code.cast("double")).otherwise(F.raise_error(F.lit(f"value of {self.child} outside its classes")).cast("double"))
        net = train(self.net, rows.select(*inputs, known.alias("_y")), "_y", "class", steps, rate)
        return Classes(self.child, self.parents, self.values, self.categories, net)

    def _with(self, rows: DataFrame) -> DataFrame:
        made, inputs = self._inputs(rows, self.parents, self.categories)
        return outputs(made, self.net).drop(*inputs).withColumn("_p", softmax(F.col("_out"))).drop("_out")

    def _array(self) -> Column:
        return F.array(*[F.lit(v) for v in self.values])

    def draw(self, rows: DataFrame, seed: int, keys: list) -> DataFrame:
        at = pick(F.col("_p"), uniform(F.lit(seed), *keys, F.lit(self.child)))
        return self._with(rows).withColumn(self.child, F.element_at(self._array(), at)).drop("_p")

    def log_prob(self, rows: DataFrame) -> DataFrame:
        at = F.array_position(self._array(), F.col(self.child)).cast("int")
        known = F.when(at > 0, F.ln(F.greatest(F.element_at("_p", F.greatest(at, F.lit(1))), F.lit(1e-12)))).otherwise(F.raise_error(F.lit(f"value of {self.child} outside its classes")).cast("double"))
        return self._with(rows).withColumn("log_prob", known).drop("_p")

    def size(self) -> dict:
        return {"classes": len(self.values), "weights": len(self.net.weights)}


def has_few_values(df: DataFrame, column: str, most: int) -> bool:
    """Whether a column counts as discrete: text, truth values or whole numbers, or up to ``most`` different real ones."""
    if dict(df.dtypes)[column] not in ("double", "float") and not dict(df.dtypes)[column].startswith("decimal"):
        return True
    return df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).count() <= most


@dataclass
class BinClasses:
    """A numeric child given parents: a network says the bin, and a density within bins the rest."""

    child: str
    edges: list[float]
    within: str
    clip: bool
    classes: Classes
    smoothing: float = 0.0
    family = "binned_softmax_nn"

    @property
    def parents(self) -> list[str]:
        return self.classes.parents

    def _edges(self) -> Column:
        return F.array(*[F.lit(float(e)) for e in self.edges])

    @staticmethod
    def fit(df: DataFrame, child: str, parents: list[str], bins: int = 8, kind: str = "quantile", within: str = "triangular", clip: bool = False, smoothing: float = 0.0, most: int = 64, hidden: int = 16, steps: int = 60, rate: float = 0.05, seed: int = 0) -> BinClasses:
        rows = df.dropna(subset=[child, *parents])
        edges = binned.bin_edges(rows, child, bins, kind).first()["edges"]
        if edges is None:
            raise ValueError(f"there are no values of {child} to put into bins")
        categories = {p: Classes.categories_of(rows, p, most) for p in parents if dict(df.dtypes)[p] in ("string", "boolean")}
        made, inputs = Classes._inputs(rows, parents, categories)
        classes = Classes(child, list(parents), list(range(bins)), categories, start(made, inputs, bins, hidden, seed))
        return BinClasses(child, edges, within, clip, classes, smoothing).more(df, steps, rate)

    def more(self, df: DataFrame, steps: int, rate: float) -> BinClasses:
        """Further steps on other rows; values outside the edges count for the outer bins."""
        made, inputs = Classes._inputs(df.dropna(subset=[self.child, *self.parents]), self.parents, self.classes.categories)
        code = binned.bin_of(F.col(self.child).cast("double"), self._edges()).cast("double")
        net = train(self.classes.net, made.select(*inputs, code.alias("_y")), "_y", "class", steps, rate, self.smoothing)
        c = self.classes
        return BinClasses(self.child, self.edges, self.within, self.clip, Classes(c.child, c.parents, c.values, c.categories, net), self.smoothing)

    def draw(self, rows: DataFrame, seed: int, keys: list) -> DataFrame:
        own = [F.lit(seed), *keys, F.lit(self.child)]
        at = self.classes._with(rows).withColumn("_b", (pick(F.col("_p"), uniform(*own, F.lit("bin"))) - 1).cast("int"))
        value = binned.draw_within(F.col("_b"), self._edges(), uniform(*own), self.within, normal(*own), self.clip)
        return at.withColumn(self.child, value).drop("_p", "_b")

    def log_prob(self, rows: DataFrame) -> DataFrame:
        x = F.col(self.child).cast("double")
        mass = F.greatest(F.element_at("_p", binned.bin_of(x, self._edges()) + 1), F.lit(1e-12))
        return self.classes._with(rows).withColumn("log_prob", binned.log_density(x, self._edges(), mass, self.within, self.clip)).drop("_p")

    def size(self) -> dict:
        return {"bins": len(self.edges) - 1, "weights": len(self.classes.net.weights)}

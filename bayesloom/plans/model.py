"""The model API: choose methods, fit, update, ask, sample, save and load.

Queries are DataFrames: ``query_id`` and one column for each piece of evidence or intervention,
so that all queries of one signature (target, evidence and intervention names) run as one plan.
Answers are DataFrames of ``query_id, value, weight`` and ``weight_kind`` (``pmf``, ``weight`` or
``density``). Where the reference semantics ignore evidence below the target, ``mode="compat"``
does so too; the default routes such queries to a method that uses it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from copy import deepcopy

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import binned, conditional, cpt, factor, features, gaussian, hmc, kernel, neural, particles, process
from . import stored
from .handle import Handle
from .kept import compact, kept, kept_together

# Method names and their defaults.
CPDS = {
    "categorical_table": {"alpha": 1.0, "smoothing": "total_mass", "prior": "global"},
    "linear_gaussian": {"ridge": 1e-6},
    "conditional_gaussian": {"ridge": 0.0, "least_rows": None, "discrete": None},
    "gaussian_process": {"kernel": "rbf", "max_points": 200, "steps": 40, "rate": 0.1},
    "kde": {"bandwidth": 0.5, "parent_bandwidth": 0.5, "max_points": 2000, "least": 0.0},
    "rff_gaussian": {"features": 64, "length_scale": 1.0, "ridge": 1e-3},
    "binned": {"bins": 16, "kind": "uniform", "within": "uniform", "smoothing": 0.0},
    "gaussian_nn": {"hidden": 16, "steps": 60, "rate": 0.05},
    "mdn": {"components": 3, "hidden": 16, "steps": 60, "rate": 0.05},
    "softmax_nn": {"most": 64, "bins": 8, "kind": "quantile", "within": "triangular", "clip": False, "smoothing": 0.0, "hidden": 16, "steps": 60, "rate": 0.05},
    "categorical_embedded_softmax": {"most": 64, "hidden": 16, "steps": 60, "rate": 0.05},
}
INFERENCE = {
    "monte_carlo_marginalization": {"n_samples": 200},
    "likelihood_weighting": {"n_samples": 512},
    "importance_sampling": {"n_samples": 200, "fraction": 0.1},
    "resampled_importance_sampling": {"n_samples": 200, "ess_threshold": 0.5, "resample": True},
    "rao_blackwellized_marginalization": {"n_samples": 200, "n_particles": None, "width": 4.0, "fallback": "likelihood_weighting"},
    "categorical_exact": {},
    "gaussian_exact": {"n_samples": 200, "width": 4.0},
    "lbp": {"n_samples": 200, "n_iters": 10, "damping": 0.5, "fallback": "importance_sampling", "tol": 1e-4},
    "variable_elimination": {},
}
SAMPLING = {"ancestral": {"n_samples": 200}, "gibbs": {"n_samples": 200, "burn_in": 10, "n_steps": 1, "candidates": 8}, "hmc": {"n_samples": 200, "burn_in": 10, "n_steps": 1, "step_size": 0.05, "n_leapfrog": 8, "scales": None}}
STORED = (particles.Features, particles.Bins, neural.Mixture, neural.Classes, neural.BinClasses, process.Process)
UPDATES = ("merge", "replace", "ema", "replay_buffer", "online_sgd")


def _blend(old: DataFrame, new: DataFrame, family: list[str], alpha: float) -> DataFrame:
    """A table between two, by cell; a cell that only one of them has counts as 0 in the other, and rows are normalised again."""
    a, b = old.select(*family, F.col("n").alias("_n"), F.col("prob").alias("_a")), new.select(*family, F.col("n").alias("_m"), F.col("prob").alias("_b"))
    zero = F.lit(0.0)
    rows = a.join(b, family, "full").select(*family, (F.coalesce("_n", F.lit(0)) + F.coalesce("_m", F.lit(0))).alias("n"), ((1 - alpha) * F.coalesce("_a", zero) + alpha * F.coalesce("_b", zero)).alias("_p"))
    total = F.sum("_p").over(Window.partitionBy(*family[:-1]) if family[:-1] else Window.partitionBy())
    return rows.select(*family, "n", (F.col("_p") / total).alias("prob"))


#: Families and methods of one's own: what fits, answers or samples, by name.
OWN: dict[str, dict[str, Callable]] = {"cpd": {}, "inference": {}, "sampling": {}}


def register(kind: str, name: str, /, **defaults: object) -> Callable:
    """A decorator that makes a family or method known under ``name``, with its settings' defaults.

    ``cpd``: called with data, child, parents and the settings, gives an object with ``draw(rows, seed, keys)``,
    ``log_prob(rows)``, ``size()`` and ``family``. ``inference``: called with the model, queries (``query_id``, ``ev_``
    and ``do_`` columns), target, names of evidence and interventions and the settings, gives ``query_id, value, weight,
    weight_kind``. ``sampling``: the same without a target, gives ``query_id, particle_id`` and all variables.
    """
    known = {"cpd": CPDS, "inference": INFERENCE, "sampling": SAMPLING}
    if kind not in known:
        raise ValueError(f"unknown kind {kind!r}; there are {sorted(known)}")
    if name in known[kind] and name not in OWN[kind]:
        raise ValueError(f"{kind} {name!r} is there already")

    def keep(made: Callable) -> Callable:
        known[kind][name], OWN[kind][name] = dict(defaults), made
        return made

    return keep


def _choose(known: dict, name: str, kind: str, /, **given: object) -> tuple[str, dict]:
    if name not in known:
        raise ValueError(f"unknown {kind} method {name!r}; there are {sorted(known)}")
    return name, {**deepcopy(known[name]), **given}


class BeliefModel:
    """A Bayesian network over the columns of a DataFrame."""

    def __init__(self, parents: dict[str, list[str]], seed: int = 0):
        everyone = {*parents, *(p for ps in parents.values() for p in ps)}
        self.net = particles.Network({v: list(parents.get(v, [])) for v in sorted(everyone)})
        self.net.order()  # raises on a cycle
        self.seed, self.cpds = seed, None
        self.inference, self.sampling = ("likelihood_weighting", deepcopy(INFERENCE["likelihood_weighting"])), ("ancestral", deepcopy(SAMPLING["ancestral"]))
        self.counts: dict[str, DataFrame] = {}
        self.stats: dict[str, dict] = {}
        self.shift: dict[str, float] = {}
        self.mixed: dict[str, DataFrame] = {}
        self.resampled: DataFrame | None = None
        self.points: dict[str, DataFrame] = {}
        self.merges = 0
        self.buffer: DataFrame | None = None
        self.batches = 0
        self.update_method: str | None = None
        self.types: dict[str, str] = {}
        self._mark: str | None = None

    # choosing methods
    def set_learning_method(self, method: str = "node_wise", nodes_cpds: dict[str, dict] | None = None) -> BeliefModel:
        if method != "node_wise":
            raise ValueError(f"unknown learning method {method!r}; there are ['node_wise']")
        missing = set(self.net.parents) - set(nodes_cpds or {})
        if missing:
            raise ValueError(f"no CPD for {sorted(missing)}")
        self.cpds = {}
        for node, conf in (nodes_cpds or {}).items():
            conf = dict(conf)
            name, merged = _choose(CPDS, conf.pop("cpd"), "cpd", **conf)
            self.cpds[node] = {"cpd": name, **merged}
        return self

    def set_inference_method(self, method: str, **settings: object) -> BeliefModel:
        name, conf = _choose(INFERENCE, method, "inference", **settings)
        if name == "lbp" and not 0 <= conf["damping"] <= 1:
            raise ValueError("damping must be in [0, 1]")
        if name == "rao_blackwellized_marginalization" and conf["fallback"] not in ("likelihood_weighting", "none"):
            raise ValueError(f"unknown fallback {conf['fallback']!r}")
        if name == "lbp" and conf["fallback"] not in ("importance_sampling", "monte_carlo_marginalization"):
            raise ValueError(f"unknown fallback {conf['fallback']!r}")
        self.inference = (name, conf)
        return self

    def set_sampling_method(self, method: str, **settings: object) -> BeliefModel:
        self.sampling = _choose(SAMPLING, method, "sampling", **settings)
        return self

    # learning
    def _check(self, data: DataFrame) -> None:
        missing = set(self.net.parents) - set(data.columns)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")

    def fit(self, data: DataFrame) -> BeliefModel:
        """Counts of all tables from one aggregation, moments of all regressions from another."""
        if self.cpds is None:
            raise RuntimeError("choose a learning method first")
        self._check(data)
        self.types = {v: data.schema[v].dataType.simpleString() for v in self.net.parents}
        self._fit_others(data)
        self._statistics(data)
        self._estimate()
        return self

    def _of(self, *families: str) -> list[str]:
        return [v for v, c in (self.cpds or {}).items() if c["cpd"] in families]

    def _statistics(self, data: DataFrame) -> None:
        """Counts of each table, kept in the checkpoint folder: later questions read tables, never the data again.

        Each family leaves out the rows that have a null in it, and only those.
        """
        self.counts = self._counts(data)
        self.shift, self.stats = {}, {}
        linear, mixed = self._of("linear_gaussian"), self._of("conditional_gaussian")
        columns = sorted({c for v in [*linear, *mixed] for c in [v, *self.net.parents[v]] if c not in (self._discrete(v) if v in mixed else [])})
        if columns:
            means = data.select(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
            self.shift = {c: means[c] or 0.0 for c in columns}
        if linear:
            self.stats = self._moments(data)
        self.mixed = {v: kept(self._mixed(data, v)) for v in mixed}

    def _counts(self, data: DataFrame) -> dict[str, DataFrame]:
        """Counts of all tables from one scan."""
        return cpt.count_families(data, {v: self.net.parents[v] for v in self._of("categorical_table")})

    def _discrete(self, v: str) -> list[str]:
        """The discrete parents of a conditional Gaussian: those named, or those whose family has values."""
        named = self.cpds[v].get("discrete")
        valued = self._of("categorical_table", "softmax_nn", "categorical_embedded_softmax")
        numeric = {p for p, f in self.net.others.items() if isinstance(f, neural.BinClasses)}
        return [p for p in self.net.parents[v] if (p in named if named is not None else p in valued and p not in numeric)]

    def _mixed(self, data: DataFrame, v: str) -> DataFrame:
        discrete = self._discrete(v)
        return conditional.statistics(data, v, discrete, [p for p in self.net.parents[v] if p not in discrete], self.shift)

    def _moments(self, data: DataFrame) -> dict[str, dict]:
        """Additive statistics of each regression, all from one scan."""
        linear = self._of("linear_gaussian")
        aggs = []
        for k, v in enumerate(linear):
            columns = [v, *self.net.parents[v]]
            whole = F.lit(True)
            for c in columns:
                whole = whole & F.col(c).isNotNull()
            x = {c: F.when(whole, F.col(c).cast("double") - F.lit(self.shift[c])) for c in columns}
            aggs += [F.count_if(whole).alias(f"{k}|n"), *[F.sum(x[c]).alias(f"{k}|s_{c}") for c in columns]]
            aggs += [F.sum(x[a] * x[b]).alias(f"{k}|q_{a}__{b}") for i, a in enumerate(columns) for b in columns[i:]]
        row = data.agg(*aggs).first().asDict()
        return {v: {n.partition("|")[2]: x or 0 for n, x in row.items() if n.partition("|")[0] == str(k)} for k, v in enumerate(linear)}

    def _fit_others(self, data: DataFrame) -> None:
        """Families that are fitted to rows, not to additive statistics: their parameters are small rows and matrices."""
        self.net.others, self.points, self.merges = {}, {}, 0
        for v in self._of("gaussian_nn", "mdn"):
            conf = self.cpds[v]
            self.net.others[v] = neural.Mixture.fit(data, v, self.net.parents[v], conf.get("components", 1), conf["hidden"], conf["steps"], conf["rate"], self.seed)
        for v in self._of("softmax_nn", "categorical_embedded_softmax"):
            conf = self.cpds[v]
            if conf["cpd"] == "softmax_nn" and not neural.has_few_values(data, v, conf["most"]):  # a numeric child is put into bins
                given = {k: conf[k] for k in ("bins", "kind", "within", "clip", "smoothing", "most", "hidden", "steps", "rate")}
                self.net.others[v] = neural.BinClasses.fit(data, v, self.net.parents[v], **given, seed=self.seed)
                continue
            embed = True if conf["cpd"] == "categorical_embedded_softmax" else None
            self.net.others[v] = neural.Classes.fit(data, v, self.net.parents[v], conf["most"], conf["hidden"], conf["steps"], conf["rate"], self.seed, embed)
        for v in self._of(*OWN["cpd"]):
            settings = {k: x for k, x in self.cpds[v].items() if k != "cpd"}
            self.net.others[v] = OWN["cpd"][self.cpds[v]["cpd"]](data, v, self.net.parents[v], **settings)
        alike: dict[str, list[str]] = {}
        for v in self._of("gaussian_process"):
            alike.setdefault(json.dumps(self.cpds[v], sort_keys=True), []).append(v)
        for nodes in alike.values():  # nodes of the same settings are fitted side by side
            conf = self.cpds[nodes[0]]
            table = kept(process.fit_nodes(data, {v: self.net.parents[v] for v in nodes}, conf["kernel"], conf["max_points"], conf["steps"], conf["rate"], self.seed))
            self.net.others |= {v: process.Process(v, self.net.parents[v], table) for v in nodes}
        for v in self._of("kde", "rff_gaussian", "binned"):
            conf, p = self.cpds[v], self.net.parents[v]
            if conf["cpd"] == "kde":
                self.points[v] = kept(self._points(data, v))
                self._kernel(v)
            elif conf["cpd"] == "rff_gaussian":
                self.net.others[v] = particles.Features(v, p, features.fit(data, v, p, conf["features"], conf["length_scale"], conf["ridge"], self.seed))
            else:
                rows = data.dropna(subset=[v, *p])
                edges = binned.bin_edges(rows, v, conf["bins"], conf["kind"]).first()["edges"]
                if edges is None:
                    raise ValueError(f"there are no values of {v} to put into bins")
                at = rows.withColumn("_bin", binned.bin_of(F.col(v).cast("double"), F.array(*[F.lit(e) for e in edges])))
                probs = kept(binned.frequencies(at, "_bin", conf["bins"], p, conf["smoothing"]))
                self.net.others[v] = particles.Bins(v, p, edges, probs, conf["within"])

    def _points(self, data: DataFrame, v: str) -> DataFrame:
        """A kernel family's sample of one batch, labelled with the batch's number: samples of several batches merge."""
        rows = data.withColumn("_label", F.lit(self.merges))
        return kernel.sample(rows, [v, *self.net.parents[v]], self.cpds[v]["max_points"], self.seed, ["_label"])

    def _kernel(self, v: str) -> None:
        conf, p = self.cpds[v], self.net.parents[v]
        self.net.others[v] = particles.Kernel(v, p, kept(kernel.as_points(self.points[v], v, p)), conf["bandwidth"], conf["parent_bandwidth"], conf["least"])

    def _estimate(self) -> None:
        self._mark = None
        conf_of = {v: self.cpds[v] for v in self._of("categorical_table")}
        self.net.tables = kept_together({v: cpt.fit_cpt(self.counts[v], v, self.net.parents[v], c["alpha"], c["smoothing"], c["prior"], weight="n") for v, c in conf_of.items()})
        self.net.linear = {}
        for v, conf in self.cpds.items():
            if conf["cpd"] == "linear_gaussian":
                self.net.linear[v] = gaussian.solve(self.stats[v], v, self.net.parents[v], self.shift, conf["ridge"])
            elif conf["cpd"] == "conditional_gaussian":
                discrete = self._discrete(v)
                rest = [p for p in self.net.parents[v] if p not in discrete]
                table = kept(conditional.solved(self.mixed[v], v, discrete, rest, self.shift, conf["ridge"], least_rows=conf["least_rows"]))
                self.net.others[v] = conditional.Conditional(v, self.net.parents[v], discrete, compact(table))

    def value_type(self, v: str) -> str:
        """The type of a variable's values: as in the data, or as in its table; else double."""
        if v in self.net.tables:
            return self.net.tables[v].schema[v].dataType.simpleString()
        return self.types.get(v, "double")

    def fingerprint(self) -> str:
        """A digest of structure and parameters: equal for equal models, also after loading; new for families that only rows can fit."""
        if self._mark is None:
            said = [sorted(self.net.parents.items()), sorted((v, list(f)) for v, f in self.net.linear.items())]
            tables = dict(self.net.tables) | {v: m.table for v, m in self.net.others.items() if isinstance(m, conditional.Conditional)}
            for v, t in sorted(tables.items()):
                columns = sorted(set(t.columns) - {"n"})
                row = t.select(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)"))).first()
                said.append([v, columns, str(row[0])])
            said.append([uuid.uuid4().hex for v in self.net.others if v not in tables])
            self._mark = hashlib.sha256(json.dumps(said, sort_keys=True, default=str).encode()).hexdigest()
        return self._mark

    def _fitted(self) -> bool:
        return bool(self.net.tables or self.net.linear or self.net.others)

    def update(self, data: DataFrame, update_method: str | None = None, alpha: float = 0.1, max_size: int = 2000, order: str | None = None, steps: int = 1) -> BeliefModel:
        """New rows: ``merge`` adds their statistics, ``replace`` refits on them, ``ema`` moves the parameters by ``alpha``
        towards those of the new rows, ``replay_buffer`` refits on the newest ``max_size`` rows by
        ``order``, or without it on those of the latest updates.

        ``online_sgd`` takes ``steps`` more gradient steps on them, with the optimiser's state as it was left.
        Other families without additive statistics are refitted by ``replace`` and ``replay_buffer`` only.
        """
        if not self._fitted():
            raise RuntimeError("fit the model before updating it")
        self.update_method = {"streaming_stats": "merge"}.get(update_method, update_method) or self.update_method
        if self.update_method is None:
            raise RuntimeError("the first update needs a method")
        if self.update_method not in UPDATES:
            raise ValueError(f"unknown update method {self.update_method!r}; there are {sorted(UPDATES)}")
        self._check(data)
        if self.update_method == "replay_buffer":
            self.batches += 1
            data = data.withColumn("_batch", F.lit(self.batches))
            rows = data if self.buffer is None else self.buffer.unionByName(data)
            newest = [F.col(order).desc()] if order else [F.col("_batch").desc(), F.xxhash64(*sorted(self.net.parents))]
            self.buffer = data = kept(rows.orderBy(*newest, *sorted(self.net.parents)).limit(max_size))
        if self.update_method in ("replace", "replay_buffer"):
            return self.fit(data)
        if self.update_method == "online_sgd":
            fixed = sorted(set(self.net.parents) - set(self._of("gaussian_nn", "mdn", "softmax_nn", "categorical_embedded_softmax")))
            if fixed:
                raise ValueError(f"online_sgd needs families with gradients; {fixed} have none")
            self.net.others = {v: m.more(data, steps, self.cpds[v]["rate"]) for v, m in self.net.others.items()}
            self._mark = None
            return self
        without = set(self.net.others) - ({*self.mixed, *self.points} if self.update_method == "merge" else set())
        if without:
            raise ValueError(f"{self.update_method} needs additive statistics; {sorted(without)} have none")
        new = BeliefModel(self.net.parents, self.seed)
        new.cpds, new.shift = self.cpds, self.shift
        if self.update_method == "ema":
            self._mark = None
            new.fit(data)
            for v, t in self.net.tables.items():
                self.net.tables[v] = kept(_blend(t, new.net.tables[v], [*self.net.parents[v], v], alpha))
            for v, f in self.net.linear.items():
                g = new.net.linear[v]
                mix = lambda a, b: (1 - alpha) * a + alpha * b
                self.net.linear[v] = gaussian.Linear(v, f.parents, mix(f.intercept, g.intercept), [mix(a, b) for a, b in zip(f.coef, g.coef, strict=True)], mix(f.std, g.std))
            return self
        for v, fresh in self._counts(data).items():
            self.counts[v] = compact(kept(self.counts[v].unionByName(fresh).groupBy(*self.net.parents[v], v).agg(F.sum("n").alias("n"))))
        self.merges += 1
        for v, own in self.points.items():
            self.points[v] = kept(kernel.merge(own, self._points(data, v), self.cpds[v]["max_points"]))
            self._kernel(v)
        self.mixed = {v: kept(conditional.merged(own, self._mixed(data, v), self._discrete(v))) for v, own in self.mixed.items()}
        if self.stats:
            more = self._moments(data)
            self.stats = {v: {k: x + more[v][k] for k, x in own.items()} for v, own in self.stats.items()}
        self._estimate()
        return self

    # asking
    def _signature(self, queries: DataFrame, target: str, evidence: list[str], do: list[str]) -> DataFrame:
        if target not in self.net.parents:
            raise ValueError(f"unknown target {target!r}")
        unknown = {*evidence, *do} - set(self.net.parents)
        if unknown:
            raise ValueError(f"unknown variables in query: {sorted(unknown)}")
        if set(evidence) & set(do):
            raise ValueError(f"in evidence and intervention: {sorted(set(evidence) & set(do))}")
        return queries.select("query_id", *[F.col(v).alias(f"ev_{v}") for v in evidence], *[F.col(v).alias(f"do_{v}") for v in do])

    def infer_posterior(self, queries: DataFrame, target: str, evidence: list[str] = (), do: list[str] = (), mode: str = "correct") -> DataFrame:
        """``query_id, value, weight, weight_kind`` for each query of one signature."""
        evidence, do = list(evidence), list(do)
        q = self._signature(queries, target, evidence, do)
        name, conf = self.inference
        clamped = {v: f"do_{v}" for v in do} | {v: f"ev_{v}" for v in evidence}
        p = self.net.parents[target]
        below = self.net.descendants(target) & {*evidence, *do}
        if target in clamped:
            return q.select("query_id", F.col(clamped[target]).alias("value"), F.lit(1.0).alias("weight"), F.lit("pmf").alias("weight_kind"))
        if name in OWN["inference"]:
            return OWN["inference"][name](self, q, target, evidence, do, **conf)
        n = int(conf.get("n_samples", 200))
        exact = all(x in clamped for x in p) and (mode == "compat" or not below)
        if name == "categorical_exact" and exact and target in self.net.tables:
            rows = cpt.lookup(q.select("query_id", *[F.col(clamped[x]).alias(x) for x in p]), self.net.tables[target], target, p)
            return rows.select("query_id", F.col(target).alias("value"), F.col("prob").alias("weight"), F.lit("pmf").alias("weight_kind"))
        if name == "gaussian_exact" and exact and particles.is_gaussian(self.net, target):
            given = particles.with_params(self.net, q.select("query_id", *[F.col(clamped[x]).alias(x) for x in p]), target)
            rows = gaussian.density_grid(given, F.col("_mean"), F.col("_std"), n, float(conf["width"]))
            return rows.select("query_id", "value", F.col("density").alias("weight"), F.lit("density").alias("weight_kind"))
        if name == "variable_elimination" or (name == "categorical_exact" and not self.net.linear and not self.net.others):
            return self._eliminate(q, target, evidence, do)
        if name == "rao_blackwellized_marginalization" and target in self.net.tables:
            rows = particles.rao_blackwell(self.net, q, n, evidence, do, target, self.seed)
            return rows.select("query_id", F.col(target).alias("value"), F.col("prob").alias("weight"), F.lit("pmf").alias("weight_kind"))
        if name == "rao_blackwellized_marginalization" and not below and particles.is_gaussian(self.net, target):
            rows = particles.rao_blackwell_density(self.net, q, int(conf["n_particles"] or n), evidence, do, target, n, float(conf["width"]), self.seed)
            return rows.select("query_id", "value", F.col("density").alias("weight"), F.lit("density").alias("weight_kind"))
        if name == "rao_blackwellized_marginalization" and conf["fallback"] == "none":
            raise RuntimeError(f"{target!r} cannot be marginalised with what is given, and there is no fallback")
        if name == "resampled_importance_sampling" and conf["resample"]:
            rows, self.resampled = particles.sequential(self.net, q, n, evidence, do, self.seed, [target], float(conf["ess_threshold"]))
            return rows.select("query_id", F.col(target).alias("value"), "weight", F.lit("weight").alias("weight_kind"))
        if name == "lbp":
            rows = self._damped(q, target, evidence, do, conf)
        elif name == "importance_sampling":
            rows = particles.importance_sampling(self.net, q, n, evidence, do, target, self.seed, float(conf["fraction"]))
        else:
            weigh = name != "monte_carlo_marginalization" or mode != "compat"
            rows = particles.with_weights(particles.forward(self.net, q, n, evidence, do, self.seed, [target], weigh=weigh))
        return rows.select("query_id", F.col(target).alias("value"), "weight", F.lit("weight").alias("weight_kind"))

    def _damped(self, q: DataFrame, target: str, evidence: list[str], do: list[str], conf: dict) -> DataFrame:
        """Weights that are renormalised and damped until they settle; drawn anew by importance sampling if they do not."""
        n = int(conf["n_samples"])
        if conf["fallback"] == "importance_sampling":
            rows = particles.importance_sampling(self.net, q, n, evidence, do, target, self.seed)
        else:
            rows = particles.with_weights(particles.forward(self.net, q, n, evidence, do, self.seed, [target]))
        rows, moved = particles.damp(rows, int(conf["n_iters"]), float(conf["damping"]))
        if moved is None or moved < float(conf["tol"]):
            return rows
        return particles.importance_sampling(self.net, q, n, evidence, do, target, self.seed + 1)

    def _eliminate(self, q: DataFrame, target: str, evidence: list[str], do: list[str]) -> DataFrame:
        """Evidence stays a variable until the end: one elimination answers every query of the signature."""
        if self.net.linear or self.net.others:
            raise RuntimeError("elimination needs tables for every variable")
        needed = self.net.ancestors({target, *evidence}, set(do))
        factors = [factor.Factor([*self.net.parents[v], v], t.select(*self.net.parents[v], v, F.col("prob").alias("p"))) for v, t in self.net.tables.items() if v in needed and v not in do]
        for v in do:  # an intervention is a variable without parents
            factors.append(factor.Factor([v], q.select(F.col(f"do_{v}").alias(v)).distinct().withColumn("p", F.lit(1.0))))
        given = [*evidence, *do]
        order = factor.elimination_order([f.scope for f in factors], {target, *given})
        joint = factor.eliminate(factors, [target, *given], order=order).withColumnRenamed("p", "_p")
        keys = q.select("query_id", *[F.col(f"ev_{v}").alias(v) for v in evidence], *[F.col(f"do_{v}").alias(v) for v in do])
        rows = (keys.join(joint, given) if given else keys.crossJoin(joint)).select("query_id", F.col(target).alias("value"), "_p")
        total = rows.groupBy("query_id").agg(F.sum("_p").alias("_t"))
        return rows.join(total, "query_id").select("query_id", "value", (F.col("_p") / F.col("_t")).alias("weight"), F.lit("pmf").alias("weight_kind"))

    def statistics(self, posterior: DataFrame) -> DataFrame:
        return particles.statistics(posterior, "value")

    def infer_relative(self, queries: DataFrame, reference: DataFrame | None, target: str, evidence: list[str] = (), do: list[str] = (), ref_evidence: list[str] = (), ref_do: list[str] = ()) -> DataFrame:
        """Differences of means and standard deviations to a reference: of the same id, or its only query.

        Without a reference the queries are compared to the posterior without evidence and interventions.
        """
        a = self.statistics(self.infer_posterior(queries, target, evidence, do))
        if reference is None:
            reference, ref_evidence, ref_do = queries.sparkSession.range(1).select(F.col("id").alias("query_id")), (), ()
        b = self.statistics(self.infer_posterior(reference, target, ref_evidence, ref_do))
        return particles.relative(a, b)

    def sample(self, queries: DataFrame, evidence: list[str] = (), do: list[str] = (), targets: list[str] | None = None) -> DataFrame:
        """Draws with evidence and interventions clamped, without weights: forward, or by Gibbs sweeps."""
        q = self._signature(queries, (targets or list(self.net.parents))[0], list(evidence), list(do))
        name, conf = self.sampling
        if name in OWN["sampling"]:
            rows = OWN["sampling"][name](self, q, list(evidence), list(do), **conf)
        elif name == "gibbs":
            rows = particles.gibbs(self.net, q, int(conf["n_samples"]), list(evidence), list(do), self.seed, int(conf["burn_in"]), int(conf["n_steps"]), int(conf["candidates"]))
        elif name == "hmc":
            rows = hmc.sample(self.net, q, int(conf["n_samples"]), list(evidence), list(do), self.seed, int(conf["burn_in"]), int(conf["n_steps"]), float(conf["step_size"]), int(conf["n_leapfrog"]), conf["scales"])
        else:
            rows = particles.forward(self.net, q, int(conf["n_samples"]), list(evidence), list(do), self.seed, targets, weigh=False)
        return rows.select("query_id", "particle_id", *(targets or self.net.order()))

    def generate(self, spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
        """``n`` rows drawn from the model, a column for each variable, and ``row_id``: every row depends on its number alone."""
        ids = spark.range(0, n, 1, partitions).select(F.col("id").alias("query_id")) if partitions else spark.range(n).select(F.col("id").alias("query_id"))
        rows = particles.forward(self.net, ids, 1, [], [], self.seed, weigh=False)
        return rows.select(F.col("query_id").alias("row_id"), *self.net.order())

    # parameters
    def cpd(self, node: str) -> DataFrame | gaussian.Linear | particles.Kernel | particles.Features | particles.Bins:
        for fitted in (self.net.tables, self.net.linear, self.net.others):
            if node in fitted:
                return fitted[node]
        raise KeyError(f"no fitted CPD for {node!r}")

    def handle(self, node: str) -> Handle:
        """Draws, densities and conditional distributions of one fitted family."""
        self.cpd(node)
        return Handle(self.net, node, self.seed, (self.cpds or {}).get(node))

    def save(self, path: str) -> None:
        """Counts as Parquet, everything else as one JSON line in the same folder."""
        if self.cpds is None or not self._fitted():
            raise RuntimeError("there is nothing to save before a fit")
        own = {v: f for v, f in self.net.others.items() if v not in {*self.mixed, *self.points}}
        unknown = {v for v in own if not isinstance(own[v], STORED)}
        if unknown:
            raise ValueError(f"families of one's own are not saved: {sorted(unknown)}")
        tables = {"counts": self.counts, "mixed": self.mixed, "points": self.points, "tables": {v: stored.table_of(f) for v, f in own.items()}}
        for what, frames in tables.items():
            for v, t in frames.items():
                if t is not None:
                    t.write.mode("overwrite").parquet(f"{path}/{what}/{v}")
        spark = SparkSession.getActiveSession()
        manifest = {"parents": self.net.parents, "seed": self.seed, "cpds": self.cpds, "inference": self.inference, "sampling": self.sampling, "stats": self.stats, "shift": self.shift, "types": self.types, "merges": self.merges, "others": {v: [type(f).__name__, stored.state_of(f), stored.table_of(f) is not None] for v, f in own.items()}}
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BeliefModel:
        m = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        model = cls(m["parents"], m["seed"])
        model.cpds, model.inference, model.sampling, model.stats, model.shift = m["cpds"], tuple(m["inference"]), tuple(m["sampling"]), m["stats"], m["shift"]
        model.counts = {v: spark.read.parquet(f"{path}/counts/{v}") for v, c in m["cpds"].items() if c["cpd"] == "categorical_table"}
        model.types, model.merges, model.net.others = m["types"], m["merges"], {}
        model.mixed = {v: spark.read.parquet(f"{path}/mixed/{v}") for v in model._of("conditional_gaussian")}
        for v, (kind, state, has_table) in m["others"].items():
            model.net.others[v] = stored.family_from(kind, v, model.net.parents[v], state, spark.read.parquet(f"{path}/tables/{v}") if has_table else None)
        for v in model._of("kde"):
            model.points[v] = spark.read.parquet(f"{path}/points/{v}")
            model._kernel(v)
        model._estimate()
        return model

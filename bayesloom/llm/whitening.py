"""Whitening of embeddings: leading components by Chebyshev-filtered subspace iteration.

The covariance is never built. Each pass multiplies it by a thin block ``Q``: tasks form
``Xc'(Xc Q)`` of their blocks of centred vectors, Spark adds the products up, and only a block of
(dimensions x columns) numbers reaches the driver. A Chebyshev recurrence over such passes damps the
unwanted end of the spectrum; QR and a Rayleigh-Ritz step follow, converged components are locked,
and the iteration ends when the residual of each wanted component certifies it.

Cases: vectors that are null, empty, or hold null or non-finite entries take no part, nor do vectors of another
length than the commonest (of equally common ones, the shortest); repeated vectors count once in the fit and get
a row each; rows of null or repeated ids are kept; components without variance (a single vector, constant
dimensions) are left out, so that fewer than ``k`` may come; a deviation that no long can hold is null; empty
tables give no rows; further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Vectors in one block of the fit list, and bytes of blocks that one task reads.
BLOCK, TASK_BYTES = 4096, 64 << 20


def usable(table: DataFrame, scale: float = 256) -> DataFrame:
    """Rows of ``vec_id`` and ``x``, the vector's entries as ``floor(scale * c)``."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad)
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("x"))


def _common_length(rows: DataFrame) -> int | None:
    r = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return r and r.d


def _fit_blocks(rows: DataFrame) -> DataFrame:
    """The distinct vectors as blocks of little-endian longs, kept in the checkpoint folder."""

    def pack(frames):
        held, n = [], 0
        for frame in frames:
            x = np.array(frame.x.tolist(), dtype="<i8").reshape(len(frame), -1)
            for at in range(0, len(x), BLOCK):
                held.append(x[at : at + BLOCK])
                n += len(held[-1])
                if n >= BLOCK:
                    yield pd.DataFrame({"vectors": [np.concatenate(held).tobytes()]})
                    held, n = [], 0
        if held:
            yield pd.DataFrame({"vectors": [np.concatenate(held).tobytes()]})

    blocks = cut(rows.select("x").distinct().mapInPandas(pack, "vectors binary"))
    size = blocks.agg(F.sum(F.octet_length("vectors"))).first()[0] or 0
    wanted = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
    return blocks.coalesce(wanted)


def _added(blocks: DataFrame, partial, kind: str) -> list:
    """The sum over all tasks of the flat array that ``partial`` makes of a task's blocks."""

    def run(frames):
        total = None
        for frame in frames:
            for v in frame.vectors:
                p = partial(np.frombuffer(v, dtype="<i8"))
                total = p if total is None else total + p
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "v": total})

    found = blocks.mapInPandas(run, f"at int, v {kind}").groupBy("at").agg(F.sum("v").alias("v"))
    return [r.v for r in sorted(found.collect())]


@dataclass
class Whitening:
    """Number of distinct vectors, sums by dimension, components (a column each), eigenvalues, trace and certificates."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residual: float
    passes: int
    identity_error: float


def _chebyshev(apply, q: np.ndarray, degree: int, low: float, high: float, top: float, locked: np.ndarray) -> np.ndarray:
    """``q`` under the scaled Chebyshev polynomial that is small on [low, high] and 1 at ``top``; one pass a degree."""
    half, centre = (high - low) / 2, (high + low) / 2
    first = half / (centre - top)
    sigma, was, now = first, q, (apply(q) - centre * q) * (first / half)
    for _ in range(degree - 1):
        now -= locked @ (locked.T @ now)
        after = 1 / (2 / first - sigma)
        was, now, sigma = now, (apply(now) - centre * now) * (2 * after / half) - sigma * after * was, after
    return now - locked @ (locked.T @ now)


def components(apply, d: int, k: int, trace: float, tolerance: float = 1e-12, guard: int = 20, most: int = 40, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` leading eigenvectors and eigenvalues of the operator ``apply``, and their largest relative residual.

    ``guard`` further columns are iterated along, so that the damped interval ends well under the wanted values. An
    eigenpair counts as certified when its residual is at most ``tolerance`` of the largest eigenvalue: an
    eigenvalue then lies within that distance. Without progress in four rounds rounding is the limit, and the round is the last.
    """
    b = min(d, k + guard)
    locked, values, worst = np.zeros((d, 0)), [], 0.0
    if not trace > 0:
        return locked, np.array(values), worst
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, b)))[0]
    product = apply(q)
    if b < d:  # a second block of the Krylov space: both ends of the spectrum for a start
        both = np.linalg.qr(np.hstack([q, product]))[0][:, : min(d, 2 * b)]
        image = apply(both)
    else:
        both, image = q, product
    theta, u = np.linalg.eigh((both.T @ image + image.T @ both) / 2)
    low = max(0.0, theta[0] - np.linalg.norm(image @ u[:, 0] - theta[0] * (both @ u[:, 0])))
    q, product, theta = both @ u[:, ::-1][:, :b], image @ u[:, ::-1][:, :b], theta[::-1][:b]
    scale, least, stuck = theta[0], math.inf, 0
    for _ in range(most):
        residual = np.linalg.norm(product - q * theta, axis=0) / scale
        want = min(k - len(values), len(theta))
        done = 0
        while done < want and residual[done] <= tolerance:
            done += 1
        worst_now = residual[:want].max()
        stuck = 0 if worst_now < least / 2 else stuck + 1
        least = min(least, worst_now)
        if done == want or stuck >= 4 or d == b:
            worst = max(worst, float(worst_now))
            return np.hstack([locked, q[:, :want]]), np.array([*values, *theta[:want]]), worst
        if done:
            worst = max(worst, float(residual[:done].max()))
            locked, values = np.hstack([locked, q[:, :done]]), [*values, *theta[:done]]
            q, theta = q[:, done:], theta[done:]
            want -= done
            least, stuck = math.inf, 0
        high = theta[-1]
        half, centre = max((high - low) / 2, 1e-300), (high + low) / 2
        grow = lambda t: math.acosh(max((t - centre) / half, 1 + 1e-12))
        need = math.log(max(4 * residual[done : done + want].max() / tolerance, 4)) / max(grow(theta[want - 1]), 1e-3)
        degree = int(min(max(2, need), 24, max(2, math.log(1e9) / max(grow(theta[0]), 1e-3))))
        q = np.linalg.qr(_chebyshev(apply, q, degree, low, high, theta[0], locked))[0]
        q = np.linalg.qr(q - locked @ (locked.T @ q))[0]
        product = apply(q)
        product -= locked @ (locked.T @ product)
        theta, u = np.linalg.eigh((q.T @ product + product.T @ q) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        q, product = q @ u, product @ u
    raise RuntimeError(f"no certificate after {most} rounds: relative residual {least:g}")


def fit(rows: DataFrame, k: int = 4, tolerance: float = 1e-12) -> Whitening | None:
    """Components of the distinct vectors ``x`` of ``rows``, all of one length; None without vectors."""
    d = _common_length(rows)
    if not d:
        return None
    blocks = _fit_blocks(rows)

    def moments(flat: np.ndarray) -> np.ndarray:
        x = flat.reshape(-1, d)
        if int(np.abs(x).max(initial=0)) ** 2 * x.size >= 1 << 62:
            x = x.astype(object)
        return np.array([len(x), int((x * x).sum()), *map(int, x.sum(axis=0))], dtype=object)

    n, squares, *sums = map(int, _added(blocks, moments, "decimal(38,0)"))
    mean = np.array([s / n for s in sums])
    trace = float(squares * n - sum(s * s for s in sums)) / n / n
    passes = 0

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def product(flat: np.ndarray) -> np.ndarray:
            x = flat.reshape(-1, d) - mean
            return (x.T @ (x @ q)).ravel()

        return np.array(_added(blocks, product, "double")).reshape(q.shape) / n

    found, values, residual = components(apply, d, min(k, d), trace, tolerance)
    real = values > 1e-12 * max(trace, 1e-300)
    found, values = found[:, real], values[real]
    error = 0.0
    if len(values):
        project = found / np.sqrt(values)

        def second(flat: np.ndarray) -> np.ndarray:
            w = (flat.reshape(-1, d) - mean) @ project
            return np.vstack([w.sum(axis=0), w.T @ w]).ravel()

        total = np.array(_added(blocks, second, "double")).reshape(-1, len(values)) / n
        error = float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(len(values))).max())
    return Whitening(n, sums, found, values, trace, residual, passes, error)


def whiten(rows: DataFrame, w: Whitening) -> DataFrame:
    """For each row of ``vec_id`` and ``x`` and each component: n, deviation, whitened, explained, identity_error."""
    d, c = len(w.sums), len(w.eigenvalues)
    mean = np.array([s / w.n for s in w.sums])
    project = w.components / np.sqrt(w.eigenvalues) if c else w.components
    explained = w.eigenvalues / w.trace if c else w.eigenvalues
    sums, n, error = w.sums, w.n, w.identity_error
    small = max(map(abs, sums), default=0)

    def run(frames):
        for frame in frames:
            if not len(frame) or not c:
                continue
            x = np.array(frame.x.tolist(), dtype="<i8").reshape(len(frame), d)
            most = n * int(np.abs(x).max(initial=0)) + small
            if most * most * d < 1 << 63:
                deviation = ((n * x - np.array(sums)) ** 2).sum(axis=1)
            else:
                deviation = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
            deviation = pd.Series([v if v < 1 << 63 else None for v in map(int, deviation)], dtype="Int64")
            yield pd.DataFrame(
                {
                    "vec_id": np.repeat(frame.vec_id.to_numpy(), c),
                    "component": np.tile(np.arange(1, c + 1, dtype="int32"), len(x)),
                    "n": n,
                    "deviation": deviation.repeat(c).array,
                    "whitened": ((x - mean) @ project).ravel(),
                    "explained": np.tile(explained, len(x)),
                    "identity_error": error,
                }
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(table: DataFrame, k: int = 4, scale: float = 256, tolerance: float = 1e-12) -> DataFrame:
    """Fit on all usable rows of ``table``, and whiten each of them."""
    rows = usable(table, scale)
    d = _common_length(rows) or 0
    rows = rows.where(F.size("x") == d)
    model = fit(rows, k, tolerance) or Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0, 0.0)
    return whiten(rows, model)

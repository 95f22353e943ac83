"""Families as what is written: tables as Parquet, everything else as JSON. A loaded family answers as the one that was saved."""

from __future__ import annotations

from dataclasses import fields

import numpy as np
from pyspark.sql import DataFrame

from ..operators import features, neural, particles, process

#: Numbers of a network and of random features that are arrays.
_ARRAYS = ("center", "spread", "axes", "phase", "weights", "momentum", "square")


def _plain(value: object) -> object:
    return value.tolist() if isinstance(value, np.ndarray) else value


def _arrays(state: dict) -> dict:
    return {k: np.array(v, dtype=float) if k in _ARRAYS else v for k, v in state.items()}


def _net(net: neural.Net) -> dict:
    return {f.name: _plain(getattr(net, f.name)) for f in fields(net)}


def state_of(family: object) -> dict:
    """The parameters of a family that are not tables, as what JSON can hold."""
    if isinstance(family, particles.Features):
        return {k: _plain(v) for k, v in family.model._asdict().items()} | {"shape": list(family.model.axes.shape)}
    if isinstance(family, neural.Mixture):
        return {"net": _net(family.net), "shift": family.shift, "scale": family.scale}
    if isinstance(family, neural.Classes):
        return {"values": family.values, "categories": family.categories, "net": _net(family.net)}
    if isinstance(family, neural.BinClasses):
        return {"edges": list(family.edges), "within": family.within, "clip": family.clip, "smoothing": family.smoothing, "classes": state_of(family.classes)}
    if isinstance(family, particles.Bins):
        return {"edges": list(family.edges), "within": family.within}
    return {}


def table_of(family: object) -> DataFrame | None:
    """The table of a family whose parameters are one; those with statistics of their own are estimated from them instead."""
    if isinstance(family, particles.Bins):
        return family.probs
    return family.table if isinstance(family, process.Process) else None


def family_from(kind: str, v: str, parents: list[str], state: dict, table: DataFrame | None) -> object:
    """The family ``kind`` (its class name) of ``v`` from its state and table."""
    if kind == "Features":
        rest = _arrays({k: x for k, x in state.items() if k != "shape"})
        rest["axes"] = rest["axes"].reshape(state["shape"])
        return particles.Features(v, parents, features.RandomFeatures(**rest))
    if kind == "Mixture":
        return neural.Mixture(v, parents, neural.Net(**_arrays(state["net"])), state["shift"], state["scale"])
    if kind == "Classes":
        return neural.Classes(v, parents, state["values"], state["categories"], neural.Net(**_arrays(state["net"])))
    if kind == "BinClasses":
        return neural.BinClasses(v, state["edges"], state["within"], state["clip"], family_from("Classes", v, parents, state["classes"], None), state["smoothing"])
    if kind == "Bins":
        return particles.Bins(v, parents, state["edges"], table, state["within"])
    if kind == "Process":
        return process.Process(v, parents, table)
    raise ValueError(f"{kind} families cannot be loaded")

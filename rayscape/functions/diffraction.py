"""Knife-edge diffraction: the Fresnel parameter, its loss, and chains of edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rayscape.constants import WAVELENGTH


def fresnel_loss(v: Column) -> Column:
    """Loss for a diffraction parameter. The formula's five branches; its logarithm is the natural one."""
    ln20 = lambda x: F.lit(20.0) * F.ln(x)
    gain = (
        F.when(v < -1, F.lit(0.0))
        .when(v < 0, ln20(F.lit(0.5) - F.lit(0.62) * v))
        .when(v < 1, ln20(F.lit(0.5) * F.exp(F.lit(-0.95) * v)))
        .when(v < 2.4, ln20(F.lit(0.4) - F.sqrt(F.lit(0.1184) - F.pow(F.lit(0.38) - F.lit(0.1) * v, F.lit(2.0)))))
        .when(v.isNotNull(), ln20(F.lit(0.225) / v))
    )
    return -gain


def _size(start: Column, end: Column) -> Column:
    dx, dy = end["x"] - start["x"], end["y"] - start["y"]
    return F.sqrt(dx * dx + dy * dy)


def _distance(start: Column, end: Column, edge: Column, size: Column) -> Column:
    along = ((edge["x"] - start["x"]) * (end["x"] - start["x"]) + (edge["y"] - start["y"]) * (end["y"] - start["y"])) / F.nullif(size, F.lit(0.0))
    return F.nullif(F.greatest(F.lit(0.0), F.least(size, along)), F.lit(0.0))


def _parameter(start: Column, end: Column, edge: Column, size: Column, d: Column) -> Column:
    straight = start["z"] + d / size * (end["z"] - start["z"])
    return (edge["z"] - straight) * F.sqrt(F.lit(2.0) / (F.lit(WAVELENGTH) * d))


def fresnel_parameter(start: Column, end: Column, edge: Column) -> Column:
    """Parameter of an edge between two ends (structs of x, y, z), with the distance from the start in x and y; NULL for an edge at the start."""
    size = _size(start, end)
    return _parameter(start, end, edge, size, _distance(start, end, edge, size))


def _chain(nodes: Column) -> Column:
    """Losses of all nodes but the first and the last; each step's values are bound before the next one uses them."""
    inner = F.slice(nodes, 2, F.size(nodes) - 2)
    three = F.transform(inner, lambda edge, i: F.struct(F.get(nodes, i).alias("p"), F.get(nodes, i + 2).alias("q"), edge.alias("e")))
    sized = F.transform(three, lambda t: F.struct(t.alias("t"), _size(t["p"], t["q"]).alias("size")))
    placed = F.transform(sized, lambda k: F.struct(k["t"].alias("t"), k["size"].alias("size"), _distance(k["t"]["p"], k["t"]["q"], k["t"]["e"], k["size"]).alias("d")))
    parameters = F.transform(placed, lambda k: _parameter(k["t"]["p"], k["t"]["q"], k["t"]["e"], k["size"], k["d"]))
    return F.transform(parameters, lambda v: F.coalesce(fresnel_loss(v), F.lit(0.0)))


def chain_loss(start: Column, end: Column, edges: Column) -> Column:
    """Sum of the losses of edges in their order, each between its neighbours (Epstein-Peterson); 0 without edges."""
    losses = F.transform(F.array(F.concat(F.array(start), edges, F.array(end))), _chain)[0]
    return F.coalesce(F.aggregate(losses, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))

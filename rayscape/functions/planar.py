"""Plane geometry on rings (closed arrays of corners) and rays, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(ring: Column, of) -> Column:
    """of(corner, next corner) for each side of a ring."""
    return F.when(F.size(ring) >= 2, F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: of(F.element_at(ring, i), F.element_at(ring, i + 1))))


def crossings(ring: Column, r: Column, s: Column) -> Column:
    """(z, t) of each place where the ray from r to s meets the ring, t running from 0 to 1 along the ray.

    A side that lies along the ray gives the lower end of what they share. Holes have no rings here.
    """
    dx, dy, dz = s["x"] - r["x"], s["y"] - r["y"], s["z"] - r["z"]

    # generated code has no part in functions of arrays: what is used more than once is bound by a step of its own
    def side(a: Column, b: Column) -> Column:
        from_r = {"px": a["x"] - r["x"], "py": a["y"] - r["y"], "qx": b["x"] - r["x"], "qy": b["y"] - r["y"]}
        return F.struct(*[v.alias(k) for k, v in ({"dx": dx, "dy": dy, "ex": b["x"] - a["x"], "ey": b["y"] - a["y"]} | from_r).items()])

    def meet(k: Column) -> Column:
        over_t, over_u = k["px"] * k["ey"] - k["py"] * k["ex"], k["px"] * k["dy"] - k["py"] * k["dx"]
        return F.struct(k.alias("k"), over_t.alias("t"), over_u.alias("u"), F.nullif(k["dx"] * k["ey"] - k["dy"] * k["ex"], F.lit(0.0)).alias("den"))

    def place(m: Column) -> Column:
        k, t, u = m["k"], m["t"] / m["den"], m["u"] / m["den"]
        size = F.nullif(k["dx"] * k["dx"] + k["dy"] * k["dy"], F.lit(0.0))
        ta, tb = (k["px"] * k["dx"] + k["py"] * k["dy"]) / size, (k["qx"] * k["dx"] + k["qy"] * k["dy"]) / size
        low, high = F.greatest(F.lit(0.0), F.least(ta, tb)), F.least(F.lit(1.0), F.greatest(ta, tb))
        along = F.when(m["den"].isNull() & (m["u"] == 0) & (low <= high), F.when(dz < 0, high).otherwise(low))
        return F.when(t.between(0, 1) & u.between(0, 1), t).otherwise(along)

    places = F.filter(F.transform(F.transform(_edges(ring, side), meet), place), lambda at: at.isNotNull())
    return F.transform(places, lambda at: F.struct((r["z"] + at * dz).alias("z"), at.alias("t")))


def lowest_crossing(ring: Column, r: Column, s: Column) -> Column:
    """The crossing of the least height, as struct (z, t); NULL without one."""
    return F.array_min(crossings(ring, r, s))


def crossing_height(ring: Column, r: Column, s: Column) -> Column:
    return lowest_crossing(ring, r, s)["z"]


def hits(ring: Column, height: Column, r: Column, s: Column) -> Column:
    """Whether the ray meets a building's outline at or below its height."""
    return F.coalesce(crossing_height(ring, r, s) <= height, F.lit(False))


def _on_edge(x: Column, y: Column):
    def of(a: Column, b: Column) -> Column:
        straight = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return straight & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return of


def on_boundary(ring: Column, x: Column, y: Column) -> Column:
    return F.coalesce(F.exists(_edges(ring, _on_edge(x, y)), lambda e: e), F.lit(False))


def contains(ring: Column, x: Column, y: Column, boundary: bool = False) -> Column:
    """Whether a point is inside a ring, by counting sides to its right; its boundary is outside if not said otherwise."""

    def right(a: Column, b: Column) -> Column:
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    odd = F.size(F.filter(_edges(ring, right), lambda e: e)) % 2 == 1
    edge = on_boundary(ring, x, y)
    return F.coalesce((odd | edge) if boundary else (odd & ~edge), F.lit(False))


def area2(ring: Column) -> Column:
    """Twice the signed area."""
    return F.aggregate(_edges(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda acc, v: acc + v)


def centroid(ring: Column) -> tuple[Column, Column]:
    """Centre of a ring's area, taken about its first corner to keep digits."""
    o = F.element_at(ring, 1)
    moved = F.transform(ring, lambda c: F.struct((c["x"] - o["x"]).alias("x"), (c["y"] - o["y"]).alias("y")))
    total = F.nullif(area2(moved), F.lit(0.0)) * 3
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    add = lambda acc, v: acc + v
    sx = F.aggregate(_edges(moved, lambda a, b: (a["x"] + b["x"]) * cross(a, b)), F.lit(0.0), add)
    sy = F.aggregate(_edges(moved, lambda a, b: (a["y"] + b["y"]) * cross(a, b)), F.lit(0.0), add)
    return o["x"] + sx / total, o["y"] + sy / total


def bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda c: c["x"]), F.transform(ring, lambda c: c["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """A rectangle's ring."""
    corners = ((maxx, maxy), (maxx, miny), (minx, miny), (minx, maxy), (maxx, maxy))
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))

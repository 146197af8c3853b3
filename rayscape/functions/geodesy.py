"""Coordinate systems as Column expressions.

Geocentric and geodetic WGS 84 (EPSG:4978, 4979), UTM zones (326xx, 327xx), British
National Grid (27700, 7405) through the published seven-parameter shift, and web Mercator (3857). Heights pass through
unchanged where a system has its own: no geoid is applied.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rayscape.constants import ECEF, LLA


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    b: float

    @property
    def e2(self) -> float:
        return 1 - (self.b / self.a) ** 2


# Ellipsoids and projections as their authorities publish them.
WGS84 = Ellipsoid(6378137.0, 6378137.0 * (1 - 1 / 298.257223563))
AIRY = Ellipsoid(6377563.396, 6356256.909)
OSGB_SHIFT = (-446.448, 125.157, -542.060)  # m, from WGS 84
OSGB_TURN = (-0.1502, -0.2470, -0.8421)  # seconds of arc
OSGB_SCALE = 20.4894e-6

Point = tuple[Column, Column, Column]


def let(values: dict[str, Column], body) -> Column:
    """body(names), with each value computed once however often the body names it."""
    bound = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.transform(F.array(bound), lambda s: body(*[s[k] for k in values]))[0]


def packed(point: Point) -> Column:
    return F.struct(*[v.alias(k) for k, v in zip("xyz", point)])


def through(point: Point, *steps) -> Point:
    """A point taken through functions from points to points, one after another."""
    def bound(step):
        return lambda s: packed(step(s["x"], s["y"], s["z"]))

    out = packed(point)
    for step in steps:
        out = F.transform(F.array(out), bound(step))[0]
    return tuple(out[c] for c in "xyz")


def to_ecef(lon: Column, lat: Column, h: Column, on: Ellipsoid = WGS84) -> Point:
    sin, cos = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = F.lit(on.a) / F.sqrt(F.lit(1.0) - F.lit(on.e2) * sin * sin)
    return (n + h) * cos * F.cos(F.radians(lon)), (n + h) * cos * F.sin(F.radians(lon)), (n * F.lit(1 - on.e2) + h) * sin


def from_ecef(x: Column, y: Column, z: Column, on: Ellipsoid = WGS84) -> Point:
    """Longitude, latitude and height; a closed first approximation and refinements."""
    second = on.a**2 / on.b**2 - 1

    def latitude(p: Column, z: Column, u: Column) -> Column:
        return F.atan2(z + F.lit(second * on.b) * F.pow(F.sin(u), F.lit(3.0)), p - F.lit(on.e2 * on.a) * F.pow(F.cos(u), F.lit(3.0)))

    def refined(p: Column, z: Column, u: Column, left: int) -> Column:
        if not left:
            return let({"p": p, "z": z, "lat": latitude(p, z, u)}, place)
        again = {"p": p, "z": z, "lat": latitude(p, z, u)}
        return let(again, lambda p, z, lat: let({"p": p, "z": z, "u": F.atan2(F.lit(on.b) * F.sin(lat), F.lit(on.a) * F.cos(lat))}, lambda p, z, u: refined(p, z, u, left - 1)))

    def place(p: Column, z: Column, lat: Column) -> Column:
        n = F.lit(on.a) / F.sqrt(F.lit(1.0) - F.lit(on.e2) * F.sin(lat) * F.sin(lat))
        return F.struct(F.degrees(lat).alias("lat"), (p * F.cos(lat) + z * F.sin(lat) - F.lit(on.a**2) / n).alias("h"))

    found = let({"p": F.sqrt(x * x + y * y), "z": z}, lambda p, z: let({"p": p, "z": z, "u": F.atan2(z * F.lit(on.a), p * F.lit(on.b))}, lambda p, z, u: refined(p, z, u, 2)))
    return F.degrees(F.atan2(y, x)), found["lat"], found["h"]


@dataclass(frozen=True)
class TransverseMercator:
    on: Ellipsoid
    lat0: float
    lon0: float
    scale: float
    east0: float
    north0: float

    @property
    def _n(self) -> float:
        return (self.on.a - self.on.b) / (self.on.a + self.on.b)

    def _series(self) -> tuple[float, list[float], list[float]]:
        """(radius of the rectifying sphere, coefficients forward, coefficients back), to the fourth order."""
        n = self._n
        radius = self.on.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        return radius, forward, back

    def _north_of_origin(self) -> float:
        radius, forward, _ = self._series()
        e = math.sqrt(self.on.e2)
        s = math.sin(math.radians(self.lat0))
        xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
        return radius * (xi + sum(c * math.sin(2 * k * xi) for k, c in enumerate(forward, 1)))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        radius, series, _ = self._series()
        e = math.sqrt(self.on.e2)

        def conformal(s: Column, lam: Column) -> Column:
            return let({"t": F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s)), "lam": lam}, sphere)

        def sphere(t: Column, lam: Column) -> Column:
            return let({"xi": F.atan2(t, F.cos(lam)), "eta": F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))}, plane)

        def plane(xi: Column, eta: Column) -> Column:
            north, east = xi, eta
            for k, c in enumerate(series, 1):
                north = north + F.lit(c) * F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k))
                east = east + F.lit(c) * F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k))
            x = F.lit(self.east0) + F.lit(self.scale * radius) * east
            return F.struct(x.alias("x"), (F.lit(self.north0 - self.scale * self._north_of_origin()) + F.lit(self.scale * radius) * north).alias("y"))

        out = let({"s": F.sin(F.radians(lat)), "lam": F.radians(lon - F.lit(self.lon0))}, conformal)
        return out["x"], out["y"]

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        radius, _, series = self._series()
        e = math.sqrt(self.on.e2)

        def sphere(xi0: Column, eta0: Column) -> Column:
            xi, eta = xi0, eta0
            for k, c in enumerate(series, 1):
                xi = xi - F.lit(c) * F.sin(xi0 * (2 * k)) * F.cosh(eta0 * (2 * k))
                eta = eta - F.lit(c) * F.cos(xi0 * (2 * k)) * F.sinh(eta0 * (2 * k))
            return let({"xi": xi, "eta": eta}, conformal)

        def conformal(xi: Column, eta: Column) -> Column:
            chi = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(xi) / F.cosh(eta))))
            lon = F.lit(self.lon0) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))
            return let({"lon": lon, "q": F.atanh(F.sin(chi)), "lat": chi}, lambda lon, q, lat: latitude(lon, q, lat, 6))

        def latitude(lon: Column, q: Column, lat: Column, left: int) -> Column:
            if not left:
                return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))
            return let({"lon": lon, "q": q, "lat": F.asin(F.tanh(q + F.lit(e) * F.atanh(F.lit(e) * F.sin(lat))))}, lambda lon, q, lat: latitude(lon, q, lat, left - 1))

        north = (y - F.lit(self.north0) + F.lit(self.scale * self._north_of_origin())) / F.lit(self.scale * radius)
        out = let({"xi": north, "eta": (x - F.lit(self.east0)) / F.lit(self.scale * radius)}, sphere)
        return out["lon"], out["lat"]


BRITISH = TransverseMercator(AIRY, 49.0, -2.0, 0.9996012717, 400000.0, -100000.0)


def _shift(point: Point, sign: int) -> Point:
    """The seven-parameter shift to the British datum (sign 1) or, inverted to first order and refined, from it (sign -1)."""

    def forward(x: Column, y: Column, z: Column) -> Point:
        tx, ty, tz = OSGB_SHIFT
        rx, ry, rz = (math.radians(s / 3600) for s in OSGB_TURN)
        k = 1 + OSGB_SCALE
        return F.lit(tx) + F.lit(k) * x - F.lit(rz) * y + F.lit(ry) * z, F.lit(ty) + F.lit(rz) * x + F.lit(k) * y - F.lit(rx) * z, F.lit(tz) - F.lit(ry) * x + F.lit(rx) * y + F.lit(k) * z

    if sign > 0:
        return forward(*point)

    def back(x: Column, y: Column, z: Column) -> Column:
        def closer(gx: Column, gy: Column, gz: Column, left: int) -> Column:
            if not left:
                return packed((gx, gy, gz))
            made = forward(gx, gy, gz)
            return let(dict(zip(("gx", "gy", "gz"), (g + p - m for g, p, m in zip((gx, gy, gz), (x, y, z), made)))), lambda a, b, c: closer(a, b, c, left - 1))

        return closer(x, y, z, 3)

    out = let(dict(zip("xyz", point)), back)
    return out["x"], out["y"], out["z"]


def code(crs: str) -> int:
    return int(str(crs).upper().removeprefix("EPSG:"))


def is_2d(crs: str) -> bool:
    """Whether a system has no height of its own."""
    return code(crs) not in (4978, 4979, 7405)


def _utm(n: int) -> TransverseMercator | None:
    zone = n % 100
    if n // 100 in (326, 327) and 1 <= zone <= 60:
        return TransverseMercator(WGS84, 0.0, 6.0 * zone - 183, 0.9996, 500000.0, 0.0 if n // 100 == 326 else 10000000.0)
    return None


def _steps_to_lla(crs: str) -> list:
    n = code(crs)
    if n in (4979, 4326):
        return []
    if n == 4978:
        return [from_ecef]
    if n == 3857:
        r = F.lit(WGS84.a)
        return [lambda x, y, z: (F.degrees(x / r), F.degrees(F.atan(F.sinh(y / r))), z)]
    if n in (27700, 7405):
        # the height is the map's own all along, so it stands aside while the datum changes
        return [lambda x, y, z: (*BRITISH.inverse(x, y), z), lambda lon, lat, h: (*through((lon, lat, F.lit(0.0)), _airy_ecef, _to_wgs, from_ecef)[:2], h)]
    if utm := _utm(n):
        return [lambda x, y, z: (*utm.inverse(x, y), z)]
    raise ValueError(f"EPSG:{n} is not a known coordinate system")


def _steps_from_lla(crs: str) -> list:
    n = code(crs)
    if n in (4979, 4326):
        return []
    if n == 4978:
        return [to_ecef]
    if n == 3857:
        r = F.lit(WGS84.a)
        return [lambda lon, lat, h: (F.radians(lon) * r, F.asinh(F.tan(F.radians(lat))) * r, h)]
    if n in (27700, 7405):
        return [lambda lon, lat, h: (*through((lon, lat, F.lit(0.0)), to_ecef, _to_osgb, _airy_lla)[:2], h), lambda lon, lat, h: (*BRITISH.forward(lon, lat), h)]
    if utm := _utm(n):
        return [lambda lon, lat, h: (*utm.forward(lon, lat), h)]
    raise ValueError(f"EPSG:{n} is not a known coordinate system")


def _airy_ecef(lon: Column, lat: Column, h: Column) -> Point:
    return to_ecef(lon, lat, h, AIRY)


def _airy_lla(x: Column, y: Column, z: Column) -> Point:
    return from_ecef(x, y, z, AIRY)


def _to_osgb(x: Column, y: Column, z: Column) -> Point:
    return _shift((x, y, z), 1)


def _to_wgs(x: Column, y: Column, z: Column) -> Point:
    return _shift((x, y, z), -1)


def to_crs(x: Column, y: Column, z: Column, source: str, target: str) -> Point:
    """A point in another coordinate system; unchanged if it is the same one."""
    if code(source) == code(target):
        return x, y, z
    steps = _steps_to_lla(source) + _steps_from_lla(target)
    return through((x, y, z), *steps) if steps else (x, y, z)


def up(r: Point) -> Point:
    """The unit vector that points away from the ground at a geocentric place."""
    return up_at(*from_ecef(*r)[:2])


def up_at(lon: Column, lat: Column) -> Point:
    """The same at a geodetic place."""
    known = let({"lon": F.radians(lon), "lat": F.radians(lat)}, lambda lon, lat: packed((F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))))
    return tuple(known[c] for c in "xyz")


def elevation_over(up: Point, r: Point, s: Point) -> Column:
    """Degrees at which ``s`` stands above the plane through ``r`` that ``up`` is square to."""
    d = [b - a for a, b in zip(r, s)]
    size = F.nullif(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), F.lit(0.0))
    sine = (d[0] * up[0] + d[1] * up[1] + d[2] * up[2]) / size
    return F.when(sine.isNotNull(), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine)))))


def elevation(r: Point, s: Point) -> Column:
    """Degrees above the horizon of ``r`` at which ``s`` stands; both geocentric."""
    names = [f"{n}{c}" for n in "urs" for c in "xyz"]
    return let(dict(zip(names, (*up(r), *r, *s))), lambda *v: elevation_over(v[:3], v[3:6], v[6:]))


def cut_ray(r: Point, s: Point, length: float, three_d: bool = False) -> Point:
    """End of the ray from r to s after ``length``, measured in x and y (or in space); s itself if it is nearer."""
    d = [b - a for a, b in zip(r, s)]
    far = F.sqrt(d[0] * d[0] + d[1] * d[1] + (d[2] * d[2] if three_d else F.lit(0.0)))
    t = F.when(far > length, F.lit(float(length)) / far).otherwise(F.lit(1.0))
    return tuple(a + t * b for a, b in zip(r, d))


__all__ = ["ECEF", "LLA", "cut_ray", "elevation", "from_ecef", "is_2d", "to_crs", "to_ecef"]

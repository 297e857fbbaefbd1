"""Points that are even over the surface of a solid, from three uniforms each."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.rotation import Vector
from lattica.functions.shapes import Cone, Cylinder, Ellipsoid, Parallelepiped, Shape, Sphere, _frame, _minus, _norm

#: Bands, and parts of a band, into which the surface of an ellipsoid is cut.
BANDS = 32


def ellipsoid_areas(sides: tuple[float, float, float], bands: int = BANDS) -> list[list[float]]:
    """The areas of the cells of a grid of angles, band by band from the pole of the third axis, by each cell's middle.

    What a cell's area is off by falls with the square of its width.
    """
    a, b, c = sides
    out = []
    for i in range(bands):
        phi = math.pi * (i + 0.5) / bands
        row = []
        for j in range(bands):
            theta = 2 * math.pi * (j + 0.5) / bands
            s, k = math.sin(phi), math.cos(phi)
            row.append(math.sqrt((b * c * s * s * math.cos(theta)) ** 2 + (a * c * s * s * math.sin(theta)) ** 2 + (a * b * s * k) ** 2) * 2 * math.pi**2 / bands**2)
        out.append(row)
    return out


def _accumulated(values: list[float]) -> list[float]:
    out, so_far = [0.0], 0.0
    for v in values:
        so_far += v
        out.append(so_far)
    return out


def _inverse(table: Column, size: int, u: Column) -> Column:
    """Where u, in [0, 1), of the last entry lies in an accumulated table: the number of the stretch and the part of it before."""
    def found(row: Column) -> Column:
        at = u * row[size]
        i = F.least(F.lit(size), F.size(F.filter(row, lambda x: x <= at))) - 1
        low, high = F.element_at(row, i + 1), F.element_at(row, i + 2)
        return F.struct(i.alias("i"), F.when(high > low, (at - low) / (high - low)).otherwise(0.0).alias("part"))

    return F.transform(F.array(table), found)[0]


def _ellipsoid(solid: Ellipsoid, u: Vector) -> Vector:
    areas = ellipsoid_areas(solid.lambdas)
    bands = F.lit(_accumulated([sum(row) for row in areas]))
    rows = F.array(*(F.lit(_accumulated(row)) for row in areas))

    def point(band: Column) -> Column:
        # Within a band the cosine is even, as it is on a sphere.
        low, high = F.cos(band["i"] * F.lit(math.pi / BANDS)), F.cos((band["i"] + 1) * F.lit(math.pi / BANDS))
        cos = low + (high - low) * band["part"]
        around = _inverse(F.element_at(rows, band["i"] + 1), BANDS, u[1])
        return F.transform(F.array(around), lambda t: F.struct(cos.alias("cos"), ((t["i"] + t["part"]) * F.lit(2 * math.pi / BANDS)).alias("theta"), band["i"].alias("band")))[0]

    at = F.transform(F.array(_inverse(bands, BANDS, u[0])), point)[0]
    sin = F.sqrt(F.greatest(F.lit(0.0), 1 - at["cos"] * at["cos"]))
    a, b, c = solid.lambdas
    along = [a * sin * F.cos(at["theta"]), b * sin * F.sin(at["theta"]), c * at["cos"]]
    return [F.lit(float(o)) + sum((k * float(v[i]) for k, v in zip(along, (solid.v0, solid.v1, solid.v2), strict=True)), F.lit(0.0)) for i, o in enumerate(solid.origin)]


def _round(bottom, top, u: Vector, radius_low: float, radius_high: float, parts: list[tuple[str, float]]) -> Vector:
    """A part of a cylinder's or cone's surface by its area, then a point of it. The axis runs from bottom to top."""
    axis, p, q = _frame(tuple(_minus(top, bottom)))
    total, before, r, h = sum(a for _, a in parts), 0.0, None, None
    for name, area in parts:
        own = (u[0] * total - before) / area  # even over [0, 1) where this part is met
        if name == "side" and radius_low == radius_high:
            radius, height = F.lit(float(radius_low)), own
        elif name == "side":  # from the tip, at the top: area grows with the square of the distance
            radius, height = radius_low * F.sqrt(own), 1 - F.sqrt(own)
        else:
            radius, height = (radius_low if name == "bottom" else radius_high) * F.sqrt(own), F.lit(0.0 if name == "bottom" else 1.0)
        met = u[0] * total >= before
        r, h = (radius, height) if r is None else (F.when(met, radius).otherwise(r), F.when(met, height).otherwise(h))
        before += area
    t, long = u[1] * (2 * math.pi), _norm(_minus(top, bottom))
    return [F.lit(float(bottom[i])) + h * (long * axis[i]) + r * (F.cos(t) * float(p[i]) + F.sin(t) * float(q[i])) for i in range(3)]


def surface_point(solid: Shape, u: Vector) -> Vector:
    """A point of the solid's surface, equal areas being equally likely, from three uniforms in [0, 1).

    Exact but for ellipsoids, whose areas come from an accumulated table of BANDS by BANDS cells.
    """
    if isinstance(solid, Sphere):
        z, t = 2 * u[0] - 1, u[1] * (2 * math.pi)
        flat = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
        return [F.lit(float(o)) + v * float(solid.radius) for o, v in zip(solid.origin, (flat * F.cos(t), flat * F.sin(t), z), strict=True)]
    if isinstance(solid, Ellipsoid):
        return _ellipsoid(solid, u)
    if isinstance(solid, Cylinder):
        r, long = solid.radius, _norm(_minus(solid.top, solid.bottom))
        return _round(solid.bottom, solid.top, u, r, r, [("side", 2 * math.pi * r * long), ("bottom", math.pi * r * r), ("top", math.pi * r * r)])
    if isinstance(solid, Cone):
        r, long = solid.radius, _norm(_minus(solid.origin, solid.apex))
        return _round(solid.origin, solid.apex, u, r, 0.0, [("side", math.pi * r * math.hypot(r, long)), ("bottom", math.pi * r * r)])
    if isinstance(solid, Parallelepiped):
        cross = lambda s, t: (s[1] * t[2] - s[2] * t[1], s[2] * t[0] - s[0] * t[2], s[0] * t[1] - s[1] * t[0])
        faces = [(k, far, _norm(cross(*(s for i, s in enumerate(solid.sides) if i != k)))) for k in range(3) for far in (0.0, 1.0)]
        total, before, at = sum(f[2] for f in faces), 0.0, None
        for k, far, area in faces:
            own, free = [None] * 3, iter(((u[1]), (u[2])))
            for i in range(3):
                own[i] = F.lit(far) if i == k else next(free)
            at = own if at is None else [F.when(u[0] * total >= before, new).otherwise(old) for new, old in zip(own, at, strict=True)]
            before += area
        return [F.lit(float(o)) + sum((at[k] * float(s[i]) for k, s in enumerate(solid.sides)), F.lit(0.0)) for i, o in enumerate(solid.corner)]
    raise ValueError(f"no surface of {type(solid).__name__}")

"""Solids as column expressions: containment, volume, bounding box, and points from three uniforms each."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.rotation import Vector

Point = tuple[float, float, float]
#: What round solids and cylinders count as inside beyond their surface.
EPSILON = 1e-3


def _dot(a: Vector | Point, b: Vector | Point):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _minus(a, b) -> list:
    return [x - y for x, y in zip(a, b, strict=True)]


def _norm(a: Point) -> float:
    return math.sqrt(_dot(a, a))


@dataclass(frozen=True)
class Shape:
    """A solid. Subclasses say what is inside, how large it is and what box holds it."""

    def inside(self, p: Vector) -> Column:
        raise NotImplementedError

    def volume(self) -> float:
        raise NotImplementedError

    def box(self) -> tuple[Point, Point]:
        raise NotImplementedError

    def reach(self) -> tuple[Point, Point]:
        """A box that holds all that counts as inside: the bounding box and EPSILON beyond it."""
        low, high = self.box()
        return tuple(v - EPSILON for v in low), tuple(v + EPSILON for v in high)

    def point(self, u: Vector) -> Vector:
        raise NotImplementedError

    #: Fields that are places, and those that are directions: a move changes the first, a turn both.
    PLACES, DIRECTIONS = (), ()

    def translated(self, by: Point) -> Shape:
        return replace(self, **{n: tuple(a + b for a, b in zip(getattr(self, n), by, strict=True)) for n in self.PLACES})

    def rotated(self, rx: float, ry: float, rz: float, about: Point = (0.0, 0.0, 0.0)) -> Shape:
        """Turned about fixed x, then y, then z, in degrees, around a point."""
        (cx, sx), (cy, sy), (cz, sz) = ((math.cos(math.radians(a)), math.sin(math.radians(a))) for a in (rx, ry, rz))

        def turn(v: Point) -> Point:
            x, y, z = v
            y, z = cx * y - sx * z, sx * y + cx * z
            x, z = cy * x + sy * z, cy * z - sy * x
            return cz * x - sz * y, sz * x + cz * y, z

        places = {n: tuple(a + b for a, b in zip(turn(tuple(_minus(getattr(self, n), about))), about, strict=True)) for n in self.PLACES}
        directions = {n: tuple(map(turn, getattr(self, n))) if isinstance(getattr(self, n)[0], tuple) else turn(getattr(self, n)) for n in self.DIRECTIONS}
        return replace(self, **places, **directions)

    def inside_box(self, p: Vector) -> Column:
        """Strictly within the bounding box."""
        low, high = self.box()
        return reduce(lambda a, b: a & b, [(c > lo) & (c < hi) for c, lo, hi in zip(p, low, high, strict=True)])

    def n_points(self, voxel: float) -> int:
        return int(self.volume() // voxel**3)


@dataclass(frozen=True)
class Sphere(Shape):
    origin: Point
    radius: float
    PLACES, DIRECTIONS = ("origin",), ()

    def inside(self, p):
        d = _minus(p, self.origin)
        return F.sqrt(_dot(d, d)) < self.radius + EPSILON

    def volume(self):
        return 4 / 3 * math.pi * self.radius**3

    def box(self):
        return tuple(o - self.radius for o in self.origin), tuple(o + self.radius for o in self.origin)

    def point(self, u):
        """Even over the volume."""
        r, z, a = F.cbrt(u[0]) * self.radius, 2 * u[1] - 1, 2 * math.pi * u[2]
        flat = F.sqrt(F.lit(1.0) - z * z)
        return [F.lit(o) + r * d for o, d in zip(self.origin, (flat * F.cos(a), flat * F.sin(a), z), strict=True)]


@dataclass(frozen=True)
class Ellipsoid(Shape):
    """Axes v0, v1, v2 are unit vectors at right angles; lambdas are the half lengths along them."""

    origin: Point
    lambdas: Point
    v0: Point = (1.0, 0.0, 0.0)
    v1: Point = (0.0, 1.0, 0.0)
    v2: Point = (0.0, 0.0, 1.0)
    PLACES, DIRECTIONS = ("origin",), ("v0", "v1", "v2")

    def inside(self, p):
        d = _minus(p, self.origin)
        return sum((F.pow(_dot(d, v) / s, F.lit(2.0)) for v, s in zip((self.v0, self.v1, self.v2), self.lambdas, strict=True)), F.lit(0.0)) < 1

    def volume(self, exact: bool = False):
        """pi a b c, the value that tests of this data model fix; with exact=True times 4/3."""
        return math.prod(self.lambdas) * math.pi * (4 / 3 if exact else 1)

    def box(self):
        half = [math.sqrt(sum((s * v[i]) ** 2 for v, s in zip((self.v0, self.v1, self.v2), self.lambdas, strict=True))) for i in range(3)]
        return tuple(o - h for o, h in zip(self.origin, half, strict=True)), tuple(o + h for o, h in zip(self.origin, half, strict=True))

    def point(self, u):
        unit = Sphere((0.0, 0.0, 0.0), 1.0).point(u)
        return [F.lit(o) + sum((unit[k] * (s * v[i]) for k, (v, s) in enumerate(zip((self.v0, self.v1, self.v2), self.lambdas, strict=True))), F.lit(0.0)) for i, o in enumerate(self.origin)]


def _frame(axis: Point) -> tuple[Point, Point, Point]:
    """axis as a unit vector, and two unit vectors at right angles to it and each other."""
    n = _norm(axis)
    w = tuple(c / n for c in axis)
    help_ = (1.0, 0.0, 0.0) if abs(w[0]) < 0.9 else (0.0, 1.0, 0.0)
    u = (w[1] * help_[2] - w[2] * help_[1], w[2] * help_[0] - w[0] * help_[2], w[0] * help_[1] - w[1] * help_[0])
    u = tuple(c / _norm(u) for c in u)
    return w, u, (w[1] * u[2] - w[2] * u[1], w[2] * u[0] - w[0] * u[2], w[0] * u[1] - w[1] * u[0])


def _disc_box(centres: list[tuple[Point, float]], w: Point) -> tuple[Point, Point]:
    half = [math.sqrt(max(0.0, 1 - c * c)) for c in w]
    return tuple(min(p[i] - r * half[i] for p, r in centres) for i in range(3)), tuple(max(p[i] + r * half[i] for p, r in centres) for i in range(3))


@dataclass(frozen=True)
class Cylinder(Shape):
    bottom: Point
    radius: float
    top: Point
    PLACES, DIRECTIONS = ("bottom", "top"), ()

    def inside(self, p):
        w, height = _frame(_minus(self.top, self.bottom))[0], _norm(_minus(self.top, self.bottom))
        d = _minus(p, self.bottom)
        along = _dot(d, w)
        return (_dot(d, d) - along * along < self.radius**2 + EPSILON) & (along > -EPSILON) & (along < height + EPSILON)

    def volume(self):
        return math.pi * self.radius**2 * _norm(_minus(self.top, self.bottom))

    def box(self):
        return _disc_box([(self.bottom, self.radius), (self.top, self.radius)], _frame(_minus(self.top, self.bottom))[0])

    def reach(self):
        """A thin cylinder counts points up to the root of EPSILON beyond its side."""
        return Shape.reach(replace(self, radius=math.sqrt(self.radius**2 + EPSILON)))

    def point(self, u):
        axis = _minus(self.top, self.bottom)
        _, a, b = _frame(axis)
        r, t = F.sqrt(u[0]) * self.radius, 2 * math.pi * u[1]
        return [F.lit(o) + u[2] * axis[i] + r * (F.cos(t) * a[i] + F.sin(t) * b[i]) for i, o in enumerate(self.bottom)]


@dataclass(frozen=True)
class Cone(Shape):
    """The round base has its centre at origin; the tip is at apex."""

    apex: Point
    origin: Point
    radius: float
    PLACES, DIRECTIONS = ("apex", "origin"), ()

    def inside(self, p):
        axis = _minus(self.origin, self.apex)
        height, w = _norm(axis), _frame(axis)[0]
        d = _minus(p, self.apex)
        along = _dot(d, w)
        return (along >= 0) & (along <= height) & (_dot(d, d) - along * along <= F.pow(along * (self.radius / height), F.lit(2.0)))

    def volume(self):
        return math.pi * self.radius**2 * _norm(_minus(self.origin, self.apex)) / 3

    def box(self):
        return _disc_box([(self.apex, 0.0), (self.origin, self.radius)], _frame(_minus(self.origin, self.apex))[0])

    def point(self, u):
        axis = _minus(self.origin, self.apex)
        _, a, b = _frame(axis)
        h = F.cbrt(u[0])
        r, t = F.sqrt(u[1]) * h * self.radius, 2 * math.pi * u[2]
        return [F.lit(o) + h * axis[i] + r * (F.cos(t) * a[i] + F.sin(t) * b[i]) for i, o in enumerate(self.apex)]


@dataclass(frozen=True)
class Parallelepiped(Shape):
    """One corner and the three edges from it."""

    corner: Point
    sides: tuple[Point, Point, Point]
    PLACES, DIRECTIONS = ("corner",), ("sides",)

    def inside(self, p):
        """By the coordinates of p in the edges' frame, each in (0, 1); edges needn't be at right angles."""
        a, b, c = self.sides
        cross = lambda s, t: (s[1] * t[2] - s[2] * t[1], s[2] * t[0] - s[0] * t[2], s[0] * t[1] - s[1] * t[0])
        d, det = _minus(p, self.corner), _dot(a, cross(b, c))
        return reduce(lambda x, y: x & y, [(_dot(d, n) / det > 0) & (_dot(d, n) / det < 1) for n in (cross(b, c), cross(c, a), cross(a, b))])

    def volume(self):
        a, b, c = self.sides
        v = _dot(a, (b[1] * c[2] - b[2] * c[1], b[2] * c[0] - b[0] * c[2], b[0] * c[1] - b[1] * c[0]))
        return F.abs(v) if isinstance(v, Column) else abs(v)

    def box(self):
        low = tuple(self.corner[i] + sum(min(0.0, s[i]) for s in self.sides) for i in range(3))
        return low, tuple(self.corner[i] + sum(max(0.0, s[i]) for s in self.sides) for i in range(3))

    def point(self, u):
        return [F.lit(o) + sum((u[k] * s[i] for k, s in enumerate(self.sides)), F.lit(0.0)) for i, o in enumerate(self.corner)]


def cuboid(bottom: Point, top: Point, length: float, width: float) -> Parallelepiped:
    """A box whose axis runs from the centre of its bottom to that of its top; length and width are full sides."""
    axis = tuple(_minus(top, bottom))
    if axis[0] == axis[1] == 0:
        u, v = (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)
    else:
        _, u, v = _frame(axis)
    corner = tuple(b - length / 2 * p - width / 2 * q for b, p, q in zip(bottom, u, v, strict=True))
    return Parallelepiped(corner, (tuple(length * c for c in u), tuple(width * c for c in v), axis))


@dataclass(frozen=True)
class Composition:
    """Labelled solids that are tested together."""

    shapes: tuple[Shape, ...]
    labels: tuple[tuple[str, ...], ...] = field(default=())

    def only(self, wanted: list[str]) -> Composition:
        keep = [i for i, x in enumerate(self.labels) if set(x) & set(wanted)]
        return Composition(tuple(self.shapes[i] for i in keep), tuple(self.labels[i] for i in keep))

    def inside(self, p: Vector) -> Column:
        return reduce(lambda a, b: a | b, [s.inside_box(p) & s.inside(p) for s in self.shapes], F.lit(False))

    def translated(self, by: Point) -> Composition:
        return Composition(tuple(s.translated(by) for s in self.shapes), self.labels)

    def rotated(self, rx: float, ry: float, rz: float, about: Point = (0.0, 0.0, 0.0)) -> Composition:
        return Composition(tuple(s.rotated(rx, ry, rz, about) for s in self.shapes), self.labels)

    def box(self) -> tuple[Point, Point]:
        boxes = [s.box() for s in self.shapes]
        return tuple(min(b[0][i] for b in boxes) for i in range(3)), tuple(max(b[1][i] for b in boxes) for i in range(3))

    def reach(self) -> tuple[Point, Point]:
        return Shape.reach(self)

    def volumes(self) -> list[float]:
        return [s.volume() for s in self.shapes]

"""Rotations as 3x3 matrices of columns, row by row; angles are Euler angles about fixed x, y, z in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[Column]]
Vector = list[Column]


def times(m: Matrix, v: Vector) -> Vector:
    return [r[0] * v[0] + r[1] * v[1] + r[2] * v[2] for r in m]


def transpose(m: Matrix) -> Matrix:
    return [list(r) for r in zip(*m, strict=True)]


def product(a: Matrix, b: Matrix) -> Matrix:
    return transpose([times(a, c) for c in transpose(b)])


def euler_matrix(rx: Column, ry: Column, rz: Column) -> Matrix:
    """About x first, then y, then z."""
    (cx, sx), (cy, sy), (cz, sz) = ((F.cos(F.radians(a)), F.sin(F.radians(a))) for a in (rx, ry, rz))
    return [[cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx], [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx], [-sy, cy * sx, cy * cx]]


def matrix_euler(m: Matrix) -> Vector:
    """The angles of a matrix; at the poles of y, z is 0."""
    sy = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m[2][0]))
    pole = F.abs(sy) > 1 - 1e-12
    x = F.when(pole, F.atan2(-m[1][2], m[1][1])).otherwise(F.atan2(m[2][1], m[2][2]))
    z = F.when(pole, F.lit(0.0)).otherwise(F.atan2(m[1][0], m[0][0]))
    return [F.degrees(a) for a in (x, F.asin(sy), z)]


def aligning_matrix(a: Vector, b: Vector) -> Matrix:
    """The rotation that takes direction a to direction b, by Rodrigues' formula.

    Identity for parallel directions, opposite ones included. Null or zero vectors raise.
    """
    def unit(v: Vector) -> Vector:
        n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        n = F.when(n > 0, n).otherwise(F.raise_error(F.lit("a direction must be a finite vector other than 0")).cast("double"))
        return [c / n for c in v]

    a, b = unit(a), unit(b)
    v = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    c = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    square = v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    k = [[F.lit(0.0), -v[2], v[1]], [v[2], F.lit(0.0), -v[0]], [-v[1], v[0], F.lit(0.0)]]
    kk = product(k, k)
    factor = F.when(square > 1e-24, (F.lit(1.0) - c) / square)
    eye = lambda i, j: F.lit(1.0 if i == j else 0.0)
    return [[F.when(square > 1e-24, eye(i, j) + k[i][j] + kk[i][j] * factor).otherwise(eye(i, j)) for j in range(3)] for i in range(3)]

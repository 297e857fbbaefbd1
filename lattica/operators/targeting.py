"""Which cells and which places on them a device or a model takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.keyed import keyed_bits
from lattica.functions.labels import has_all, has_any


def by_id(cells: DataFrame, ids: dict[str, list[int]]) -> DataFrame:
    """Cells of the given ids of each type."""
    wanted = [F.col("cell_type").eqNullSafe(t) & F.col("id").isin(i) for t, i in ids.items()]
    out = F.lit(False)
    for w in wanted:
        out = out | w
    return cells.where(out)


def by_type(cells: DataFrame, types: list[str]) -> DataFrame:
    return cells.where(F.col("cell_type").isin(types))


def by_label(cells: DataFrame, labels: list[str]) -> DataFrame:
    return cells.where(has_any(F.col("labels"), labels))


def in_sphere(cells: DataFrame, origin: tuple[float, float, float], radius: float) -> DataFrame:
    d2 = sum((F.pow(F.col(c) - o, F.lit(2.0)) for c, o in zip("xyz", origin, strict=True)), F.lit(0.0))
    return cells.where(d2 < radius * radius)


def in_cylinder(cells: DataFrame, origin: tuple[float, float], radius: float, axis: str = "y") -> DataFrame:
    """Cells around a line along `axis` through origin in the plane of the other axes."""
    plane = [c for c in "xyz" if c != axis]
    d2 = sum((F.pow(F.col(c) - o, F.lit(2.0)) for c, o in zip(plane, origin, strict=True)), F.lit(0.0))
    return cells.where(d2 < radius * radius)


def sample(cells: DataFrame, count: int | None = None, fraction: float | None = None, group: str = "cell_type", seed: int = 0) -> DataFrame:
    """`count` cells of each group, or floor(fraction * n), without replacement, by keyed numbers of their ids."""
    w = Window.partitionBy(group)
    ranked = cells.withColumn("_r", F.row_number().over(w.orderBy(keyed_bits(seed, group, "id"), "id")))
    if count is None:
        ranked = ranked.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_r") <= F.floor(F.col("_n") * F.lit(float(fraction)))).drop("_n")
    else:
        ranked = ranked.where(F.col("_r") <= count)
    return ranked.drop("_r")


def locations(points: DataFrame, labels: list[str]) -> DataFrame:
    """Morphology points that have all of the labels."""
    return points.where(has_all(F.col("labels"), labels))


def somata(points: DataFrame) -> DataFrame:
    return locations(points, ["soma"])


def branch_locations(points: DataFrame, x: float, keys: list[str], above: bool = False) -> DataFrame:
    """One point of each branch: the last whose arc is at most x, in [0, 1], or with above=True the first whose arc is at least x.

    points have `arc` (see morphology.arcs).
    """
    w = Window.partitionBy(*keys, "branch_id").orderBy(*((F.col("arc"), F.col("point_id")) if above else (F.desc("arc"), F.desc("point_id"))))
    return points.where(F.col("arc") >= x if above else F.col("arc") <= x).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

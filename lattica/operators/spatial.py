"""Spatial joins as equi-joins on grid cells.

Both sides are put into the cells that they touch, joined on the cell, and tested exactly. A pair that shares several
cells is kept in one of them only, the cell of the greater low corner, so no distinct is needed. The cell size sets the cost:
about the reach of a join for points, the typical box for boxes. Dense cells are split by AQE's skew join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def _and(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size)))


def squared_distance(a: str, b: str) -> Column:
    return sum((F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), F.lit(2.0)) for c in AXES), F.lit(0.0))


def distance_join(left: DataFrame, right: DataFrame, radius: float, least: float = 0.0) -> DataFrame:
    """Pairs with least <= distance <= radius, as structs a and b of the sides' columns, and distance.

    Both sides need x, y, z. The right side goes to one cell of the size of the radius, the left side to the 27
    around its own.
    """
    near = left
    for c in AXES:
        near = near.withColumn(f"_c{c}", F.explode(F.array(*(_cell(F.col(c), radius) + d for d in (-1, 0, 1)))))
    near = near.select(F.struct(*left.columns).alias("a"), *(F.col(f"_c{c}").alias(f"c{c}") for c in AXES))
    own = right.select(F.struct("*").alias("b"), *(_cell(F.col(c), radius).alias(f"c{c}") for c in AXES))
    d2 = squared_distance("a", "b")
    return near.join(own, [f"c{c}" for c in AXES]).where((d2 <= radius * radius) & (d2 >= least * least)).select("a", "b", F.sqrt(d2).alias("distance"))


def overlaps(a: str, b: str) -> Column:
    """Whether closed boxes (lx, ly, lz, hx, hy, hz) of two aliases meet."""
    return _and([(F.col(f"{a}.l{c}") <= F.col(f"{b}.h{c}")) & (F.col(f"{b}.l{c}") <= F.col(f"{a}.h{c}")) for c in AXES])


def _in_cells(df: DataFrame, name: str, size: float) -> DataFrame:
    out = df
    for c in AXES:
        out = out.withColumn(f"_c{c}", F.explode(F.sequence(_cell(F.col(f"l{c}"), size), _cell(F.col(f"h{c}"), size))))
    return out.select(F.struct(*df.columns).alias(name), *(F.col(f"_c{c}").alias(f"c{c}") for c in AXES))


def box_join(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes that overlap, as structs a and b. Boxes are columns lx, ly, lz, hx, hy, hz; touching counts."""
    both = _in_cells(left, "a", size).join(_in_cells(right, "b", size), [f"c{c}" for c in AXES])
    home = _and([F.col(f"c{c}") == _cell(F.greatest(F.col(f"a.l{c}"), F.col(f"b.l{c}")), size) for c in AXES])
    return both.where(overlaps("a", "b") & home).select("a", "b")


def _levelled(df: DataFrame, name: str, base: float, own_kinds: list[int], levels: list[int], kind: int, part: float = 1.0) -> DataFrame:
    """Rows of a box, the kind of a meeting, and each cell that it touches on its own level, for some kinds, and on each of the given
    ones above it, for one.

    On its own level cells are as wide as the box or wider, so it touches eight at most, and no more on those above. With a part
    below 1 cells are that much narrower, so it touches more.
    """
    reach = F.greatest(*(F.col(f"h{c}") - F.col(f"l{c}") for c in AXES))
    own = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(reach / F.lit(float(base)), F.lit(1e-300))))).cast("int")
    out = df.select(*(F.col(c).alias(f"{name}_{c}") for c in df.columns), own.alias("_own"))
    meeting = lambda k, level: F.struct(F.lit(k).alias("kind"), level.cast("int").alias("level"))
    met = F.array(*(meeting(k, F.col("_own")) for k in own_kinds))
    if levels:
        met = F.concat(met, F.filter(F.array(*(meeting(kind, F.lit(x)) for x in levels)), lambda m: m["level"] > F.col("_own")))
    out = out.withColumn("_m", F.explode(met))
    out = out.select("*", "_m.kind", "_m.level").withColumn("_size", F.pow(F.lit(2.0), F.col("level")) * F.lit(float(base * part)))
    for c in AXES:
        out = out.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"{name}_l{c}") / F.col("_size")), F.floor(F.col(f"{name}_h{c}") / F.col("_size")))))
    return out.select(*(f"{name}_{c}" for c in df.columns), "kind", "level", "_size", *(f"c{c}" for c in AXES))


def any_box_join(left: DataFrame, right: DataFrame, base: float, part: float = 1.0, partitions: int | None = None) -> DataFrame:
    """Pairs of boxes that overlap, as structs a and b, for boxes of any sizes; touching counts.

    A hierarchical grid: cells double from level to level, from `base` on, and a box lies on the level of its size. Two boxes meet in
    cells of the larger one's level, where the larger lies and the smaller is looked up: kind 1 if that is the left one's level, 2 if
    only the right one's. So one huge box touches eight cells, not a cell a `base`, and small boxes meet it only
    where they touch these; levels are as many as there are doublings between the sizes. A part below 1 makes cells that much
    narrower: 27 a box at one half, but smaller groups where boxes crowd. With a number of partitions the cells are dealt into
    so many, which AQE then doesn't merge.
    """
    levels = [sorted(r[0] for r in _levelled(df, "a", base, [1], [], 1).select("level").distinct().collect()) for df in (left, right)]  # 60 or so at most
    a, b = _levelled(left, "a", base, [1], levels[1], 2, part), _levelled(right, "b", base, [1, 2], levels[0], 1, part)
    keys = ["kind", "level", *(f"c{c}" for c in AXES)]
    if partitions:
        a, b = a.repartition(partitions, *keys), b.repartition(partitions, *keys)
    both = a.join(b.drop("_size"), keys)
    home = _and([F.col(f"c{c}") == F.floor(F.greatest(F.col(f"a_l{c}"), F.col(f"b_l{c}")) / F.col("_size")) for c in AXES])
    meet = _and([(F.col(f"a_l{c}") <= F.col(f"b_h{c}")) & (F.col(f"b_l{c}") <= F.col(f"a_h{c}")) for c in AXES])
    return both.where(meet & home).select(*(F.struct(*(F.col(f"{n}_{c}").alias(c) for c in df.columns)).alias(n) for n, df in (("a", left), ("b", right))))


def box_query(boxes: DataFrame, queries: DataFrame, size: float, unique: bool = False) -> DataFrame:
    """Hits of query boxes among boxes: (query, box) pairs of their `id`s, or with unique=True each box hit once."""
    hits = box_join(queries, boxes, size).select(F.col("a.id").alias("query_id"), F.col("b.id").alias("box_id"))
    return hits.select("box_id").distinct() if unique else hits


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, partitions: int | None = None) -> DataFrame:
    """Pairs of points a and half-open boxes b that hold them. Partitions as in any_box_join."""
    own = points.select(F.struct("*").alias("a"), *(_cell(F.col(c), size).alias(f"c{c}") for c in AXES))
    held = _and([(F.col(f"a.{c}") >= F.col(f"b.l{c}")) & (F.col(f"a.{c}") < F.col(f"b.h{c}")) for c in AXES])
    keys, boxed = [f"c{c}" for c in AXES], _in_cells(boxes, "b", size)
    if partitions:
        own, boxed = own.repartition(partitions, *keys), boxed.repartition(partitions, *keys)
    return own.join(boxed, keys).where(held).select("a", "b")


def colliding(spheres: DataFrame, largest_radius: float) -> DataFrame:
    """Pairs (a.id < b.id) of spheres (id, x, y, z, radius) that overlap, with the depth of the overlap."""
    pairs = distance_join(spheres, spheres, 2 * largest_radius).where("a.id < b.id")
    depth = F.col("a.radius") + F.col("b.radius") - F.col("distance")
    return pairs.where(depth > 0).select("a", "b", depth.alias("overlap"))

"""Voxel sets: boxes with data, as tables (voxel_id, lx, ly, lz, sx, sy, sz, data MAP<STRING, DOUBLE>)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.chunks import chunk_coordinates, chunk_of
from lattica.operators.spatial import AXES, points_in_boxes


def as_boxes(voxels: DataFrame) -> DataFrame:
    """With corners lx..hz; a negative size counts towards the other side."""
    ends = {}
    for c in AXES:
        ends[f"l{c}"], ends[f"h{c}"] = F.least(F.col(f"l{c}"), F.col(f"l{c}") + F.col(f"s{c}")), F.greatest(F.col(f"l{c}"), F.col(f"l{c}") + F.col(f"s{c}"))
    return voxels.withColumns(ends)


def volume_of(voxels: DataFrame) -> DataFrame:
    return voxels.withColumn("volume", F.abs(F.col("sx") * F.col("sy") * F.col("sz")))


def bounds(boxes: DataFrame) -> DataFrame:
    return boxes.agg(*(F.min(f"l{c}").alias(f"l{c}") for c in AXES), *(F.max(f"h{c}").alias(f"h{c}") for c in AXES))


def size_flags(voxels: DataFrame) -> DataFrame:
    """n, volume, of_equal_size (one size for all) and equilateral (each as wide as high as deep)."""
    return voxels.agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("sx") * F.col("sy") * F.col("sz"))).alias("volume"),
                      (F.count_distinct("sx", "sy", "sz") <= 1).alias("of_equal_size"), F.coalesce(F.bool_and((F.col("sx") == F.col("sy")) & (F.col("sy") == F.col("sz"))), F.lit(True)).alias("equilateral"))


def fill(points: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    """The occupied cells of a grid."""
    return points.select(*(keys or []), *(F.floor(F.col(c) / size).alias(f"i{c}") for c in AXES)).distinct()


def snap_to_grid(voxels: DataFrame, size: float, unique: bool = False) -> DataFrame:
    """Voxels by the grid cell of their origin; with unique, the first of each cell by voxel_id keeps its data."""
    out = voxels.withColumns({f"i{c}": F.floor(F.col(f"l{c}") / size) for c in AXES})
    if unique:
        w = Window.partitionBy("ix", "iy", "iz").orderBy("voxel_id")
        out = out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return out


def crop(voxels: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Voxels whose origin is in [low, high)."""
    return voxels.where(reduce(lambda a, b: a & b, [(F.col(f"l{c}") >= lo) & (F.col(f"l{c}") < hi) for c, lo, hi in zip(AXES, low, high, strict=True)]))


def crop_chunk(voxels: DataFrame, chunk: int, size: float) -> DataFrame:
    own = chunk_of(*(F.col(f"l{c}") for c in AXES), size)
    return voxels.where(own == chunk)


def inside(points: DataFrame, voxels: DataFrame, size: float) -> DataFrame:
    """The points that some voxel holds, each once; points need an `id`."""
    held = points_in_boxes(points.select("id", *AXES), as_boxes(voxels), size).select(F.col("a.id").alias("id")).distinct()
    return points.join(held, "id", "left_semi")


def index_of(points: DataFrame, voxels: DataFrame, size: float) -> DataFrame:
    """points with the voxel_id of their cell of a regular set (ix, iy, iz), null where there is none."""
    at = [F.floor(F.col(c) / size).alias(f"i{c}") for c in AXES]
    return points.select("*", *at).join(voxels.select("ix", "iy", "iz", "voxel_id"), ["ix", "iy", "iz"], "left")


def concatenate(*sets: DataFrame) -> DataFrame:
    """All rows of all sets; columns that a set lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)


def mask_union(volumes: list[DataFrame], mask_value: float | None = None) -> DataFrame:
    """Cells (ix, iy, iz) of dense volumes (.., value) that one of them marks: by the value given, 0 too, else by any but 0."""
    marked = F.col("value") == mask_value if mask_value is not None else F.col("value") != 0
    return reduce(lambda a, b: a.union(b), [v.where(marked).select("ix", "iy", "iz") for v in volumes]).distinct()


def with_sources(mask: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """The mask's cells with a column of each dense volume's values."""
    out = mask
    for key, v in sources.items():
        out = out.join(v.select("ix", "iy", "iz", F.col("value").alias(key)), ["ix", "iy", "iz"], "left")
    return out


def box_chunks(boxes: DataFrame, size: float) -> DataFrame:
    """The chunks of each box with the part of the box in each: chunk_id, lx..hz, volume, area (in xy)."""
    cells = boxes
    for c in AXES:
        last = F.greatest(F.floor(F.col(f"l{c}") / size), F.ceil(F.col(f"h{c}") / size) - 1)
        cells = cells.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"l{c}") / size), last)))
    parts = {}
    for c in AXES:
        parts[f"l{c}"], parts[f"h{c}"] = F.greatest(F.col(f"l{c}"), F.col(f"c{c}") * size), F.least(F.col(f"h{c}"), (F.col(f"c{c}") + 1) * size)
    out = cells.withColumns(parts)
    side = {c: F.col(f"h{c}") - F.col(f"l{c}") for c in AXES}
    middle = [F.col(f"c{c}") * F.lit(float(size)) for c in AXES]
    return out.withColumn("volume", side["x"] * side["y"] * side["z"]).withColumn("area", side["x"] * side["y"]).withColumn("chunk_id", chunk_of(*middle, size)).drop("cx", "cy", "cz")


def chunk_corners(chunks: DataFrame, size: float) -> DataFrame:
    at = chunk_coordinates(F.col("chunk_id"))
    return chunks.withColumns({f"l{c}": a * F.lit(float(size)) for c, a in zip(AXES, at, strict=True)} | {f"h{c}": (a + 1) * F.lit(float(size)) for c, a in zip(AXES, at, strict=True)})


def rotated_boxes(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each cell's box: the corners of its morphology's box, turned by the cell's angles and moved to it.

    cells: id, x, y, z, rx, ry, rz, morph_name; boxes: morph_name, lx..hz.
    """
    from lattica.functions.rotation import euler_matrix, times

    both = cells.join(boxes, "morph_name")
    m = euler_matrix(F.col("rx"), F.col("ry"), F.col("rz"))
    corners = [times(m, [F.col(f"{e}{c}") for e, c in zip(ends, AXES, strict=True)]) for ends in [(a, b, c) for a in "lh" for b in "lh" for c in "lh"]]
    out = {}
    for i, c in enumerate(AXES):
        out[f"l{c}"], out[f"h{c}"] = F.col(c) + F.least(*(k[i] for k in corners)), F.col(c) + F.greatest(*(k[i] for k in corners))
    return both.select("id", *(v.alias(k) for k, v in out.items()))


def equal_sides(sides: tuple[float, float, float], n: int) -> tuple[int, int, int]:
    """Voxels on each axis of a box of these sides, so that their product is about n and voxels are about cubes."""
    full = [s for s in sides if s > 0]
    if not full:
        return (1, 1, 1)
    edge = (n / reduce(lambda a, b: a * b, full)) ** (1 / len(full))
    return tuple(max(1, round(s * edge)) if s > 0 else 1 for s in sides)


def divisions(sides: list[Column], n: int) -> list[Column]:
    """Into how many parts each side of a box is cut, so that about n parts arise that are about cubes; sides of no length into one.

    The least side is cut first, rounded down; what then remains is shared by the others in the same way, and the last is rounded to the nearest.
    """
    full = F.array_sort(F.filter(F.array(*(F.struct(s.alias("side"), F.lit(i).alias("axis")) for i, s in enumerate(sides))), lambda x: x["side"] > 1e-8))
    k = F.size(full)
    side = lambda i: F.get(full, k - 3 + i)["side"]  # the sides from the least; fewer than three begin later
    least, middle, most = side(0), side(1), side(2)
    total = F.lit(float(n))
    a = F.when(k == 3, F.greatest(F.lit(1.0), F.floor(least / most * F.pow(total / (least / most * (middle / most)), F.lit(1 / 3))))).otherwise(1.0)
    b = F.when(k >= 2, F.greatest(F.lit(1.0), F.floor(middle / most * F.sqrt(total / a / (middle / most))))).otherwise(1.0)
    c = F.when(k >= 2, F.rint(total / a / b)).otherwise(total)
    place = lambda i: F.array_position(F.transform(full, lambda x: x["axis"]), i) - 1 + 3 - k
    thin = lambda i: F.coalesce(F.array_position(F.transform(full, lambda x: x["axis"]), i), F.lit(0)) == 0
    return [F.when(thin(i), 1.0).when(place(i) == 0, a).when(place(i) == 1, b).otherwise(c) for i in range(3)]


def numbered_voxels(points: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """About n voxels for each keys' points (branch_id, point_id, x, y, z), those that hold any: keys, ix, iy, iz, their box, and the points in them.

    The box around the points is cut by `divisions`; voxels lie on the grid of multiples of their size, so those at the
    ends may reach out of it. Along an axis of no length they are as thin as the points.
    """
    box = points.groupBy(*keys).agg(*(F.min(c).alias(f"_l{c}") for c in AXES), *(F.max(c).alias(f"_h{c}") for c in AXES))
    sides = [F.col(f"_h{c}") - F.col(f"_l{c}") for c in AXES]
    box = box.select(*keys, *(F.when(s > 1e-8, s / d).alias(f"s{c}") for c, s, d in zip(AXES, sides, divisions(sides, n), strict=True)))
    return voxel_boxes(points.join(box, keys), keys)


def voxel_boxes(points: DataFrame, keys: list[str], size: float | None = None) -> DataFrame:
    """Voxels of a size, or of the points' own sx, sy, sz, as in numbered_voxels."""
    if size is not None:
        points = points.withColumns({f"s{c}": F.lit(float(size)) for c in AXES})
    at = points.select(*keys, *(F.coalesce(F.floor(F.col(c) / F.col(f"s{c}")), F.lit(0)).cast("long").alias(f"i{c}") for c in AXES), *AXES, *(f"s{c}" for c in AXES), F.struct("branch_id", "point_id").alias("at"))
    edges = {}
    for c in AXES:
        thin = F.col(f"s{c}").isNull()
        edges[f"l{c}"], edges[f"h{c}"] = F.when(thin, F.col(c)).otherwise(F.col(f"i{c}") * F.col(f"s{c}")), F.when(thin, F.col(c)).otherwise((F.col(f"i{c}") + 1) * F.col(f"s{c}"))
    held = at.withColumns(edges).groupBy(*keys, *(f"i{c}" for c in AXES))
    return held.agg(*(F.min(f"l{c}").alias(f"l{c}") for c in AXES), *(F.max(f"h{c}").alias(f"h{c}") for c in AXES), F.array_sort(F.collect_list("at")).alias("at"))

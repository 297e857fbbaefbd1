"""How many cells go where, and cells made accordingly."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.chunks import chunk_of
from lattica.functions.keyed import cdf_column, inverse_cdf, keyed_bits, keyed_uniform, stochastic_round
from lattica.functions.rotation import aligning_matrix, matrix_euler
from lattica.operators.connectivity import ranked
from lattica.operators.spatial import AXES


class IndicatorError(ValueError):
    """Nothing says how many cells there are, or what is said is incomplete."""


@dataclass(frozen=True)
class Indicator:
    """What may be said of the number of cells of a type. Later fields win over earlier ones."""

    count: float | None = None
    density: float | None = None
    planar_density: float | None = None
    relative_to: Indicator | None = None
    count_ratio: float | None = None
    local_count_ratio: float | None = None
    density_ratio: float | None = None
    density_key: str | None = None
    radius: float | None = None

    def over(self, default: Indicator) -> Indicator:
        """This one's fields, and the default's where they are unset."""
        return Indicator(**{k: getattr(self, k) if getattr(self, k) is not None else getattr(default, k) for k in self.__dataclass_fields__})

    def estimate(self, chunk_volume: Column, chunk_area: Column, total_volume: Column, data: Column | None = None, voxel_volume: Column | None = None) -> Column:
        """The expected number in a chunk, or with density_key in a voxel whose `data` map is given."""
        if self.density_key is not None:
            if data is None or voxel_volume is None:
                raise IndicatorError("a density key needs voxels with data")
            none = F.raise_error(F.lit(f"no density {self.density_key} in a voxel's data")).cast("double")
            return F.when(F.map_contains_key(data, self.density_key), F.element_at(data, self.density_key)).otherwise(none) * voxel_volume
        out = None
        if self.count is not None:
            out = F.lit(float(self.count)) * chunk_volume / total_volume
        if self.density is not None:
            out = F.lit(float(self.density)) * chunk_volume
        if self.planar_density is not None:
            out = F.lit(float(self.planar_density)) * chunk_area
        if self.relative_to is not None:
            other = self.relative_to
            if self.count_ratio is not None or self.local_count_ratio is not None:
                ratio = self.count_ratio if self.count_ratio is not None else self.local_count_ratio
                out = other.estimate(chunk_volume, chunk_area, total_volume) * ratio
            elif self.density_ratio is not None:
                if other.density is None and other.planar_density is None:
                    raise IndicatorError("a density ratio needs the density of the other type")
                out = F.lit(float(other.density)) * chunk_volume if other.density is not None else F.lit(float(other.planar_density)) * chunk_area
                out = out * self.density_ratio
            else:
                raise IndicatorError("relative_to needs a ratio")
        if out is None:
            raise IndicatorError("no indication of the number of cells")
        return out


def chunk_counts(chunks: DataFrame, indicators: dict[str, Indicator], seed: int = 0) -> DataFrame:
    """cell_type, chunk_id, estimate and n from chunks (chunk_id, volume, area); fractions are rounded by chance."""
    total = chunks.agg(F.sum("volume").alias("total_volume"))
    base = chunks.join(F.broadcast(total))  # one row
    out = None
    for name, indicator in indicators.items():
        part = base.select(F.lit(name).alias("cell_type"), "chunk_id", indicator.estimate(F.col("volume"), F.col("area"), F.col("total_volume")).alias("estimate"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("n", stochastic_round(F.col("estimate"), keyed_uniform(seed, "cell_type", "chunk_id")))


def voxel_counts(voxels: DataFrame, indicators: dict[str, Indicator], seed: int = 0) -> DataFrame:
    """The same by voxel, for density keys: voxels have voxel_id, volume and a map `data`."""
    out = None
    for name, indicator in indicators.items():
        part = voxels.select(F.lit(name).alias("cell_type"), "voxel_id", indicator.estimate(F.col("volume"), F.lit(0.0), F.lit(1.0), F.col("data"), F.col("volume")).alias("estimate"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("n", stochastic_round(F.col("estimate"), keyed_uniform(seed, "cell_type", "voxel_id")))


#: Points of a box that a task makes at once.
POINTS = 4096


def random_points(boxes: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """`n` points, numbered from 1 as `k`, even over each box (lx, ly, lz, hx, hy, hz); keys name the box.

    Numbers come in blocks, which are dealt to tasks, so the points of a dense box are no one task's.
    """
    n = F.col("n").cast("long")
    blocks = boxes.where("n > 0").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / POINTS)))).hint("rebalance", *keys, "_b")
    rows = blocks.withColumn("k", F.explode(F.sequence(F.col("_b") * POINTS + 1, F.least(n, (F.col("_b") + 1) * POINTS))))
    at = [(F.col(f"l{c}") + keyed_uniform(f"{seed}{c}", *keys, "k") * (F.col(f"h{c}") - F.col(f"l{c}"))).alias(c) for c in AXES]
    return rows.select(*keys, "k", *at)


def random_points_in_voxels(voxels: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """`count` points over voxels (voxel_id, lx, ..., hz): a voxel by its rank (see connectivity.ranked) with equal chance, then a point in it."""
    places = ranked(voxels.select(F.col("voxel_id").alias("id")), seed).select(F.col("id").alias("voxel_id"), F.col("rank").alias("r"))
    n = voxels.count()
    draws = voxels.sparkSession.range(1, count + 1).select(F.col("id").alias("k")).withColumn("r", F.pmod(keyed_bits(f"{seed}v", "k"), F.lit(n)))
    at = [(F.col(f"l{c}") + keyed_uniform(f"{seed}{c}", "k") * (F.col(f"h{c}") - F.col(f"l{c}"))).alias(c) for c in AXES]
    return draws.join(places, "r").join(voxels, "voxel_id").select("voxel_id", "k", *at)


def fixed_points(spark: SparkSession, points: list[tuple[float, float, float]] | DataFrame, cell_types: list[str], size: float) -> DataFrame:
    """Given points, a list or rows (k, x, y, z), all of them for each cell type."""
    at = points if isinstance(points, DataFrame) else spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "k long, x double, y double, z double")
    types = spark.createDataFrame([(t,) for t in cell_types], "cell_type string")
    return at.crossJoin(types).withColumn("chunk_id", chunk_of(F.col("x"), F.col("y"), F.col("z"), size))


def entities(spark: SparkSession, cell_type: str, count: int) -> DataFrame:
    """Cells without a place; all are in chunk 0."""
    none = F.lit(None).cast("double")
    return spark.range(count).select(F.lit(cell_type).alias("cell_type"), F.lit(0).cast("long").alias("chunk_id"), F.col("id").cast("int").alias("local_id"), *(none.alias(c) for c in AXES))


def entities_of(counts: DataFrame) -> DataFrame:
    """The same for rows (cell_type, n): so many cells of each type, numbered in blocks that are dealt to tasks."""
    n = F.col("n").cast("long")
    blocks = counts.where("n > 0").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / POINTS)))).hint("rebalance", "cell_type", "_b")
    rows = blocks.withColumn("local_id", F.explode(F.sequence(F.col("_b") * POINTS, F.least(n, (F.col("_b") + 1) * POINTS) - 1)))
    none = F.lit(None).cast("double")
    return rows.select("cell_type", F.lit(0).cast("long").alias("chunk_id"), F.col("local_id").cast("int").alias("local_id"), *(none.alias(c) for c in AXES))


def lattice_in_boxes(boxes: DataFrame, keys: list[str], spacing: float, angle: float, radius: float, density: float, jitter: float = 0.0, seed: int = 0, chunk: float = 100.0) -> DataFrame:
    """lattice_points in many boxes (keys, lx, ly, lz, hx, hy, hz) at once: keys, row, column, x, y, z and the chunk of each point.

    A row of points is a row of the table before its points are, so a large box is many tasks'.
    """
    if abs(math.cos(math.radians(angle))) < 1e-9:
        raise ValueError("rows at a right angle never cross the layer")
    apart, tan = 1.0 / (density * spacing), math.tan(math.radians(angle))
    if apart < 2 * radius:
        raise ValueError("rows are closer than the cells are wide")
    dy = F.col("hy") - F.col("ly")
    many = lambda side, step: F.greatest(F.lit(1), F.floor((F.col(f"h{side}") - F.col(f"l{side}")) / step)).cast("long")
    rows = boxes.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), many("y", apart) - 1))).hint("rebalance", *keys, "row")
    grid = rows.withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), many("x", spacing) - 1)))
    u = lambda c: keyed_uniform(f"{seed}{c}", *keys, "row", "column")
    x = F.col("lx") + F.col("column") * spacing + (u("x") - 0.5) * jitter
    y = F.col("ly") + F.pmod(F.col("row") * apart + F.col("column") * (spacing * tan), dy) + (u("y") - 0.5) * jitter
    z = F.col("lz") + u("z") * (F.col("hz") - F.col("lz"))
    out = grid.withColumns({"x": x, "y": y, "z": z}).where((F.col("x") <= F.col("hx") - radius) & (F.col("y") <= F.col("hy") - radius))
    return out.select(*keys, "row", "column", *AXES, chunk_of(F.col("x"), F.col("y"), F.col("z"), chunk).alias("chunk_id"))


def lattice_points(spark: SparkSession, low: tuple[float, float, float], high: tuple[float, float, float], spacing: float, angle: float, radius: float, density: float, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """Rows of points in xy, tilted by `angle` degrees, `spacing` apart along x; z is anywhere; points near the far side go.

    The distance of the rows follows from the planar density. Raises where rows would be closer than a cell, or never cross.
    """
    if abs(math.cos(math.radians(angle))) < 1e-9:
        raise ValueError("rows at a right angle never cross the layer")
    dx, dy = high[0] - low[0], high[1] - low[1]
    apart = 1.0 / (density * spacing)
    if apart < 2 * radius:
        raise ValueError("rows are closer than the cells are wide")
    tan = math.tan(math.radians(angle))
    rows, columns = max(1, int(dy // apart)), max(1, int(dx // spacing))
    grid = spark.range(rows).select(F.col("id").alias("row")).crossJoin(spark.range(columns).select(F.col("id").alias("column")))
    x = F.lit(low[0]) + F.col("column") * spacing + (keyed_uniform(f"{seed}x", "row", "column") - 0.5) * jitter
    y = F.lit(low[1]) + F.pmod(F.col("row") * apart + F.col("column") * (spacing * tan), F.lit(dy)) + (keyed_uniform(f"{seed}y", "row", "column") - 0.5) * jitter
    z = F.lit(low[2]) + keyed_uniform(f"{seed}z", "row", "column") * (high[2] - low[2])
    out = grid.select("row", "column", x.alias("x"), y.alias("y"), z.alias("z"))
    return out.where((F.col("x") <= high[0] - radius) & (F.col("y") <= high[1] - radius))


#: Packing of spheres: above WARN it is dense, above FAIL random placement can't do it; MOST is what random packing reaches.
WARN, FAIL, MOST = 0.2, 0.4, 0.64


def packing_factor(cells: DataFrame, volume: float) -> DataFrame:
    """factor and state ('ok', 'dense', 'too dense', 'impossible') of cells (radius, n) in a volume."""
    factor = F.sum(F.col("n") * (4 / 3 * math.pi) * F.pow("radius", F.lit(3.0))) / F.lit(float(volume))
    out = cells.agg(F.coalesce(factor, F.lit(0.0)).alias("factor"))
    state = F.when(F.col("factor") > MOST, "impossible").when(F.col("factor") > FAIL, "too dense").when(F.col("factor") > WARN, "dense").otherwise("ok")
    return out.withColumn("state", state)


def choose_morphology(cells: DataFrame, names: list[str], keys: list[str], how: str = "random", seed: int = 0) -> DataFrame:
    """cells with morph_name: at random by their keys, or in turn by local_id (how='round_robin')."""
    if not names:
        raise ValueError("there is no morphology to choose")
    pick = keyed_bits(seed, *keys) if how == "random" else F.col("local_id")
    return cells.withColumn("morph_name", F.element_at(F.array(*(F.lit(n) for n in names)), (F.pmod(pick, F.lit(len(names))) + 1).cast("int")))


def random_rotations(cells: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    return cells.withColumns({f"r{c}": keyed_uniform(f"{seed}r{c}", *keys) * 360.0 for c in AXES})


def distributed_points(boxes: DataFrame, keys: list[str], axis: str, name: str, seed: int = 0, **parameters: float) -> DataFrame:
    """Like random_points, but along one axis, from a box's low side, as a distribution says, cut off at the box's end."""
    u = keyed_uniform(f"{seed}d{axis}", *keys, "k")
    made = random_points(boxes, keys, seed).join(boxes.select(*keys, F.col(f"l{axis}").alias("_low"), (F.col(f"h{axis}") - F.col(f"l{axis}")).alias("_long")), keys)
    low, span = cdf_column(name, F.lit(0.0), **parameters), cdf_column(name, F.col("_long"), **parameters)
    return made.withColumn(axis, F.col("_low") + inverse_cdf(name, low + u * (span - low), **parameters)).drop("_low", "_long")


def no_rotations(cells: DataFrame) -> DataFrame:
    return cells.withColumns({f"r{c}": F.lit(0.0) for c in AXES})


def field_rotations(cells: DataFrame, field: DataFrame, size: float, default: tuple[float, float, float] = (0.0, -1.0, 0.0)) -> DataFrame:
    """Rotations that take the default direction to that of an orientation field (ix, iy, iz, vx, vy, vz).

    Cells outside the field, and those in voxels with a null, NaN or zero vector, aren't rotated.
    """
    at = [F.floor(F.col(c) / size).alias(f"i{c}") for c in AXES]
    v = [F.col(f"v{c}") for c in AXES]
    sound = F.coalesce(~F.isnan(v[0] + v[1] + v[2]) & (v[0] * v[0] + v[1] * v[1] + v[2] * v[2] > 0), F.lit(False))
    use = [F.when(sound, c).otherwise(F.lit(float(d))) for c, d in zip(v, default, strict=True)]
    angles = matrix_euler(aligning_matrix([F.lit(float(d)) for d in default], use))
    joined = cells.select("*", *at).join(field, ["ix", "iy", "iz"], "left")
    return joined.withColumns({f"r{c}": a for c, a in zip(AXES, angles, strict=True)}).drop("ix", "iy", "iz", "vx", "vy", "vz")

"""Regions and partitions: small driver-side trees that are laid out into boxes, which Spark then cuts into chunks."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators.voxels import box_chunks

Point = tuple[float, float, float]
AXIS = {"x": 0, "y": 1, "z": 2}


@dataclass(frozen=True)
class Box:
    name: str
    low: Point
    high: Point

    def translate(self, by: Point) -> Box:
        return replace(self, low=tuple(a + b for a, b in zip(self.low, by, strict=True)), high=tuple(a + b for a, b in zip(self.high, by, strict=True)))

    def scale(self, by: Point) -> Box:
        """The low corner stays."""
        return replace(self, high=tuple(lo + (hi - lo) * f for lo, hi, f in zip(self.low, self.high, by, strict=True)))

    @property
    def size(self) -> Point:
        return tuple(b - a for a, b in zip(self.low, self.high, strict=True))


@dataclass(frozen=True)
class Rhomboid:
    """A box of its own size at its origin."""

    name: str
    dimensions: Point
    origin: Point = (0.0, 0.0, 0.0)

    def layout(self, hint: Box) -> list[Box]:
        low = tuple(a + b for a, b in zip(hint.low, self.origin, strict=True))
        return [Box(self.name, low, tuple(a + b for a, b in zip(low, self.dimensions, strict=True)))]


@dataclass(frozen=True)
class Layer:
    """As wide as its region, `thickness` along its axis."""

    name: str
    thickness: float
    axis: str = "z"

    def layout(self, hint: Box) -> list[Box]:
        k = AXIS[self.axis]
        return [Box(self.name, hint.low, tuple(hint.low[i] + self.thickness if i == k else hint.high[i] for i in range(3)))]


@dataclass(frozen=True)
class Group:
    """Children in the same space."""

    name: str
    children: tuple = field(default=())

    def layout(self, hint: Box) -> list[Box]:
        return [b for c in self.children for b in c.layout(hint)]


@dataclass(frozen=True)
class Stack:
    """Children on top of each other along the axis; with `anchor`, that child starts at the region's low corner."""

    name: str
    children: tuple = field(default=())
    axis: str = "z"
    anchor: str | None = None

    def layout(self, hint: Box) -> list[Box]:
        k, at, out, shift = AXIS[self.axis], 0.0, [], 0.0
        for child in self.children:
            boxes = child.layout(hint)
            low, high = min(b.low[k] for b in boxes), max(b.high[k] for b in boxes)
            move = tuple(hint.low[k] + at - low if i == k else 0.0 for i in range(3))
            if child.name == self.anchor:
                shift = at
            out += [b.translate(move) for b in boxes]
            at += high - low
        return [b.translate(tuple(-shift if i == k else 0.0 for i in range(3))) for b in out]

    def height(self, hint: Box) -> float:
        boxes = self.layout(hint)
        return max(b.high[AXIS[self.axis]] for b in boxes) - min(b.low[AXIS[self.axis]] for b in boxes)


def is_region(part: object) -> bool:
    """Regions have children; everything else that has a layout is a partition."""
    return hasattr(part, "children")


def below(part: object) -> list:
    """All that hangs below a region, each once, parents before children."""
    out, todo = [], list(getattr(part, "children", ()))
    while todo:
        one = todo.pop(0)
        if all(one is not x for x in out):
            out.append(one)
            todo += getattr(one, "children", ())
    return out


def root_regions(regions: list) -> list:
    """The regions that hang below none of the others, in their order."""
    managed = [x for r in regions for x in below(r)]
    return [r for r in regions if all(r is not x for x in managed)]


def partitions_of(regions: list) -> list:
    """The partitions at and below the regions, each once."""
    out = []
    for part in [x for r in regions for x in (r, *below(r))]:
        if not is_region(part) and all(part is not x for x in out):
            out.append(part)
    return out


def topology_of(regions: list) -> object:
    """The one root region, or a group of all roots if there are several or none."""
    roots = root_regions(list(regions))
    return roots[0] if len(roots) == 1 else Group("topology", tuple(roots))


def boxes_frame(spark: SparkSession, boxes: list[Box]) -> DataFrame:
    return spark.createDataFrame([(b.name, *map(float, b.low), *map(float, b.high)) for b in boxes], "partition string, lx double, ly double, lz double, hx double, hy double, hz double")


def chunks_of(spark: SparkSession, boxes: list[Box], size: float) -> DataFrame:
    """The chunks of all boxes, with the part of each box in them."""
    return box_chunks(boxes_frame(spark, boxes), size)


def stacked(boxes: DataFrame, keys: list[str], order: list[str], axis: str = "z", anchor: Column | None = None) -> DataFrame:
    """Boxes (lx, ly, lz, hx, hy, hz) of many stacks at once, each moved along the axis onto the one before it.

    keys name the stack. Its first box stays where it is; with `anchor`, the box for which that holds starts there instead, and those before
    it lie below. Like Stack, for stacks that are rows of a table.
    """
    along = Window.partitionBy(*keys).orderBy(*order)
    thick = F.col(f"h{axis}") - F.col(f"l{axis}")
    out = boxes.withColumns({"_base": F.first(f"l{axis}").over(along), "_start": F.coalesce(F.sum(thick).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_thick": thick})
    if anchor is not None:
        shift = F.coalesce(F.max(F.when(anchor, F.col("_start"))).over(Window.partitionBy(*keys)), F.lit(0.0))
        out = out.withColumn("_start", F.col("_start") - shift)
    return out.withColumn(f"l{axis}", F.col("_base") + F.col("_start")).withColumn(f"h{axis}", F.col(f"l{axis}") + F.col("_thick")).select(boxes.columns)

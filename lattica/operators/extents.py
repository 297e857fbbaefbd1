"""Regions of interest from what cells reach: boxes of cells make boxes of chunks, and chunks whose boxes meet are read together.

A two-level index: the boxes of a side's cells, its morphologies' turned with them or its solids', are summed up to one box a chunk;
these are few, and join first. The chunk pairs then say which chunks of either side a cell join must read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.shapes import Composition, Shape
from lattica.operators.morphology import bounds
from lattica.operators.spatial import AXES, any_box_join
from lattica.operators.voxels import rotated_boxes

BOX = [f"{side}{c}" for side in "lh" for c in AXES]


def morphology_extents(cells: DataFrame, points: DataFrame) -> DataFrame:
    """cells (id, chunk_id, x, y, z, morph_name, and rx, ry, rz where they are turned) as id, chunk_id and the box of their morphology."""
    turned = cells.withColumns({c: F.lit(0.0) for c in ("rx", "ry", "rz") if c not in cells.columns})
    return rotated_boxes(turned, bounds(points)).join(cells.select("id", "chunk_id"), "id")


def solid_extents(cells: DataFrame, shape: Shape | Composition) -> DataFrame:
    """The same for cells with a solid, given about their place."""
    low, high = shape.box()
    return cells.select("id", "chunk_id", *((F.col(c) + float(v)).alias(f"l{c}") for c, v in zip(AXES, low, strict=True)), *((F.col(c) + float(v)).alias(f"h{c}") for c, v in zip(AXES, high, strict=True)))


def chunk_extents(boxes: DataFrame) -> DataFrame:
    """The box of each chunk's cells: what they reach, mostly beyond the chunk itself."""
    return boxes.groupBy("chunk_id").agg(*(F.min(f"l{c}").alias(f"l{c}") for c in AXES), *(F.max(f"h{c}").alias(f"h{c}") for c in AXES))


def region_of_extents(pre: DataFrame, post: DataFrame, base: float) -> DataFrame:
    """Pairs (pre_chunk, post_chunk) of chunks whose boxes (see chunk_extents) meet. base is about the size of the least of them."""
    return any_box_join(pre, post, base).select(F.col("a.chunk_id").alias("pre_chunk"), F.col("b.chunk_id").alias("post_chunk"))


def meeting_cells(pre: DataFrame, post: DataFrame, region: DataFrame | None, base: float) -> DataFrame:
    """(pre_id, post_id) of cells whose boxes meet; with a region, only those of its chunks are looked at. The pairs are the same either way."""
    if region is not None:
        pre = pre.join(region.select(F.col("pre_chunk").alias("chunk_id")).distinct(), "chunk_id", "left_semi")
        post = post.join(region.select(F.col("post_chunk").alias("chunk_id")).distinct(), "chunk_id", "left_semi")
    pairs = any_box_join(pre.select("id", *BOX), post.select("id", *BOX), base)
    return pairs.select(F.col("a.id").alias("pre_id"), F.col("b.id").alias("post_id"))
